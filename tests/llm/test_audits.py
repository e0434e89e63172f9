"""Source divergence, licence scans and filter interactions against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tablefit.llm import divergence, interactions, licenses
from tests.check_queries import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_divergence(rows, least, top):
    docs = [(r[2] or "", r[3] or "", Counter(TERM.findall(lower(r[1])))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in seen.items() if n >= least)
        v = len(kept)

        def shares(group):
            count = Counter()
            for d in group:
                count.update({t: d[2][t] for t in kept})
            total = sum(count[t] for t in kept)
            return count, {t: 1 + 1000000000 * (count[t] + 5) // (total + 5 * v) for t in kept}

        whole = shares(own)[1]
        groups = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (count, p) in groups.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), o.encode()) for o, (_, q) in groups.items() if o != s]
            terms = [(whole[t] - p[t], t.encode()) for t in kept if count[t] > 0 and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -f, i + 1) for i, (f, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(1, 50), (3, 2), (30, 50)])
def test_divergence(docs, rows, least, top):
    got = divergence.audit(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, top)


def test_divergence_in_tiles_and_blocks(spark, rows):
    """More sources than a tile, more terms than a block, flushes in the middle of a task."""
    many = [(i, r[1], "en" if i % 9 else None, f"s{i % 23}", None, None, None) for i, r in enumerate(rows * 4)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long, score string, size string")
    assert sorted(map(tuple, divergence.audit(df, 2, 7, room=100, tile=4, block=50).collect())) == brute_divergence(many, 2, 7)


def test_shares_are_exact(spark):
    big = 4_000_000_000_000_000_000
    df = spark.createDataFrame([(big, big + 11, 3), (0, 7, 1), (0, 0, 1)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in [(big, big + 11, 3), (0, 7, 1), (0, 0, 1)]]


def test_divergence_edges(spark, none):
    assert divergence.audit(none).count() == 0
    lone = spark.createDataFrame([(1, None, None, None), (2, "", "", "")], "doc_id long, text string, lang string, source string")
    assert divergence.audit(lone).count() == 0
    two = spark.createDataFrame([("", "x", "b", 1), (None, "x", "a", 2), (None, "x", None, 3)], "text string, lang string, source string, value int")
    assert sorted(map(tuple, divergence.audit(two).collect())) == [
        ("x", "", "pair", "a", 0, 1), ("x", "", "pair", "b", 0, 2), ("x", "a", "pair", "", 0, 1), ("x", "a", "pair", "b", 0, 2), ("x", "b", "pair", "", 0, 1), ("x", "b", "pair", "a", 0, 2)]
    with pytest.raises(ValueError):
        divergence.audit(two.drop("lang"))


@pytest.mark.parametrize("name, sql", [("op11_divergence", divergence.DIVERGENCE_SQL), ("op13_interactions", interactions.AUDIT_SQL)])
def test_given_tables(spark, name, sql):
    from tablefit.llm.queries import QUERIES

    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), oracle_connection(SF_DIR).execute(sql).fetchdf()) is None


# ---- licences ----------------------------------------------------------------------------------
LINES = [
    "Released under the MIT License.", "under the MIT license under the mit-license, UNDER THE MIT\tLICENSEE", "Apache License, Version 2.0", "cc-by-nc 4.0 and CC BY NC", "CC BY-NC-SA",
    "under the mit", "license under\n\nthe mit license", "This work is licensed under the GNU General Public License, version 3.", "cc by ncé", "écc by nc", None, "", "  ", "x" * 3000 + " cc by nc",
    "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nnext line", "SPDX-License-Identifier: ", "License-Expression: MIT and the rest",
    "cc by nc " * 2000,
]


def test_licences(spark):
    df = spark.createDataFrame(list(enumerate(LINES)) + [(None, LINES[0]), (0, LINES[0])], "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = licenses.scanned_documents(df).collect()
    assert len(got) == len(LINES) + 2
    for r in got:
        text = LINES[r["doc_id"] or 0]
        words = TOKEN.findall(lower(text))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    by = {r["doc_id"]: r for r in got}
    assert by[7]["labels"] == "gpl-3" and by[7]["rights"] == "copyleft"
    assert by[4]["labels"] == "cc-by-nc,cc-by-nc-sa"
    assert by[14]["labels"] == "apache-2,gpl-3,mit" and by[14]["rights"] == "permissive"
    assert by[15]["labels"] == "gpl-2" and by[15]["rights"] == "weak copyleft"
    assert by[16]["labels"] == "" and by[17]["expressions"] == ["mit"]
    assert by[10]["n_words"] == 0 and by[10]["score"] == 0.0 and by[10]["rights"] is None


def test_licences_on_every_document(spark):
    from tablefit.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_licenses"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    hits = 0
    for r in got:
        words = TOKEN.findall(lower(docs[r["doc_id"]]))
        line = " " + " ".join(words) + " "
        places = sorted(line[: m.start()].count(" ") for p in licenses.BASE_PHRASES for m in re.finditer(f"(?= {p} )", line))
        hits += len(places)
        assert (r["n_words"], r["n_base"], r["first_word"]) == (len(words), len(places), places[0] if places else None)
    assert hits > 0


@pytest.mark.parametrize("text, tokens, rights", [
    ("mit", ["mit"], "permissive"), ("mit or gpl-3.0+ and apache-2.0", ["mit", "or", "gpl-3.0+", "and", "apache-2.0"], "permissive"),
    ("(mit or gpl-3.0) and agpl-3.0-only", ["(", "mit", "or", "gpl-3.0", ")", "and", "agpl-3.0-only"], "network copyleft"),
    ("gpl-2.0-or-later with gcc-exception-3.1 or cc-by-nc-4.0", ["gpl-2.0-or-later", "with", "gcc-exception-3.1", "or", "cc-by-nc-4.0"], "weak copyleft"),
    ("mit.", ["mit"], "permissive"), ("mit */", ["mit"], "permissive"), ("mit and", ["mit"], "permissive"), ("((mit)", [], None), (")", [], None), ("or mit", [], None), ("with mit", [], None),
    ("nonsense", [], None), ("mit with", ["mit"], "permissive"), ("(mit) with x-exception", ["(", "mit", ")"], "permissive"), ("licenseref-own or mit", ["licenseref-own", "or", "mit"], "permissive"),
    ("mit mit", ["mit"], "permissive"), ("(" * 5000 + "mit" + ")" * 5000, ["("] * 5000 + ["mit"] + [")"] * 5000, "permissive"), ("", [], None),
])
def test_expressions(text, tokens, rights):
    assert licenses.leading_expression(text) == tokens
    if tokens:
        assert licenses.RIGHTS[licenses.evaluate(licenses.postfix(tokens))[0]] == rights


def test_chunks_keep_the_state(monkeypatch):
    whole = licenses.Scanner(licenses.NOTICE_PHRASES).scan(b"a b under the mit license c SPDX-License-Identifier: MIT")
    for size in (1, 3, 7):
        monkeypatch.setattr(licenses, "CHUNK", size)
        assert licenses.Scanner(licenses.NOTICE_PHRASES).scan(b"a b under the mit license c SPDX-License-Identifier: MIT") == whole
    assert whole["labels"] == ["mit"] and len(whole["places"]) == 1 and whole["expressions"] == ["mit"]


def test_own_phrases_and_odd_columns(spark):
    df = spark.createDataFrame([(1, "see the house rules today", {"a": 1})], "`my col-x` long, text string, m map<string,int>")
    r = licenses.scan(df, phrases={"house rules": "house"}).first()
    assert r["labels"] == ["house"] and r["rights"] == "unknown" and r["my col-x"] == 1 and r["m"] == {"a": 1}


# ---- filters -----------------------------------------------------------------------------------
def brute_masks(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and r[0] > least[t],
        }
        out.append((r[3] or "", {x for x, f in fails.items() if f}, r[0] in good, r[0] in toxic))
    return out


def brute_audit(rows, labels):
    out, shapley = {}, Counter()
    docs = brute_masks(rows, labels)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            total = len(left)
            for i, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), i + 1] = [
                    len(left), len(gone), len(every) - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
            assert total >= len(left)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions(spark, docs, rows):
    labels = [(-4, 1, 0), (-1, 1, 1), (2, 0, 1), (5, 1, None), (5, 0, 1), (8, None, None), (None, 1, 1), (32, 1, 1), (60, 1, 0), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    extra = rows + [(500 + i, t, "en", ["s1", None][i % 2], None, None, None) for i, t in enumerate(["AAA " * 60, "a#b", "Aa " * 80 + "|", None, "a#b"])] + [rows[0]] * 3
    df = spark.createDataFrame(extra, docs.schema)
    got = interactions.audited_documents(df, marks).collect()
    want = brute_audit(extra, labels)
    assert len(got) == len(want) == 600 * len({r[3] or "" for r in extra})
    for r in got:
        assert tuple(r[3:]) == want[r["part"], r["filter_order"], r["step"]], r


def test_interactions_edges(none, docs, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audited_documents(none, empty).count() == 0
    got = interactions.audited_documents(docs, empty)
    assert got.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shapley_weights(n):
    """Against marginal contributions over all orders, for unit games."""
    got = interactions.shapley_weights(n)
    want = defaultdict(int)
    for order in permutations(range(n)):
        before = 0
        for i in order:
            want[i, before | 1 << i] += 1
            want[i, before] -= 1
            before |= 1 << i
    assert all(got[i][s] == (want[i, s] if s else 0) for i in range(n) for s in range(1 << n))
