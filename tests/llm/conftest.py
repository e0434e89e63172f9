import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with exact and near copies, shared passages, repeats, nulls, ties, odd characters and extra columns."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    passage = sentence(rng, 90, "klmnopé")
    texts = [base, base, base.replace(base.split()[60], "changed", 1), base + " one more", sentence(rng, 150), None, "", "   ", "a", "two words"]
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 20) for _ in range(6)]
    texts += ["ab" * 500, "ßİé ▁▁x  y\n\n\tz ", "12345 !!! 678", "x " * 900, passage[:200], sentence(rng, 4000), "é" * 450, "one line\ntwo lines\n\nfour"]
    out = []
    for i, t in enumerate(texts):
        lang = [None, "en", "fr"][i % 3]
        out.append((i * 3 - 4, t, lang, [None, "s1", "s2", "s1", "ab"][i % 5], None, "clash", "clash"))
    out.append(out[4])  # a repeated row
    out.append((out[3][0], "same id, other text", "en", "s1", 3, None, None))
    out.append((None, base + " null id", None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
