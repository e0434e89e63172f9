"""Operators on a small table with every edge, against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import sentence
from tablefit.llm import fingerprints, jaccard, katz, language, mixing, pieces, repeats, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def crc(doc_id, of):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


def test_sharding(docs, none, rows, spark):
    got = sharding.sharded_documents(docs).collect()
    assert len(got) == len(rows)
    want = sorted((((r[1] or "").encode()) for r in rows))
    assert sorted((g["size"], g["text_crc32"]) for g in got) == sorted((len(b) + 8, zlib.crc32(b)) for b in want)
    slots, place = defaultdict(list), {}
    for g in got:
        slots[g["shard"]].append(g["slot"])
        assert g["grown_shard"] in (g["shard"], 24) and 0 <= g["shard"] < 24
        assert place.setdefault(g["doc_id"], g["shard"]) == g["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = sharding.shard(spark.range(40000), "id", 10).collect()
    moved = sum(r["grown_shard"] != r["shard"] for r in many)
    assert 0.07 < moved / len(many) < 0.11
    assert max(Counter(r["shard"] for r in many).values()) < 4400
    assert sharding.sharded_documents(none).count() == 0


def test_shard_files(docs, rows, tmp_path, spark):
    sharding.write_shards(docs.select("doc_id", "text"), "doc_id", 4, str(tmp_path / "out"), cuts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_pieces(docs, none, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    want = []
    for r in rows:
        ids = model.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert table(pieces.encoded_documents(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    full = pieces.encode(docs, pieces.public_model(), keep=["doc_id", "score"]).collect()
    assert sorted(repr((f["doc_id"], f["ids"], f["decoded"])) for f in full) == sorted(
        repr((r[0], model.encode(r[1] or "", add_eos=True), model.decode(model.encode(r[1] or "", add_eos=True)))) for r in rows
    )
    assert pieces.encoded_documents(none).count() == 0


def brute_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,local", [(400, 1000), (400, 1), (37, 1000), (37, 2), (5, 1000)])
def test_repeats(docs, rows, length, local):
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_repeats(texts, length))), key=repr)
    got = table(repeats.deduplicated_documents(docs, length, local), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want


def test_repeats_text(docs, none):
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert repeats.without_repeats(none).count() == repeats.deduplicated_documents(none).count() == 0


def shingle_set(text):
    ws = WORD.findall(text or "")
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute_classes(rows):
    sets = [shingle_set(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return [(r[0], low.get(root(i)), links[i]) for i, r in enumerate(rows)]


def test_jaccard(docs, none, rows):
    assert table(jaccard.joined_documents(docs), "doc_id", "class_id", "n_links") == sorted(brute_classes(rows), key=repr)
    kept = jaccard.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert len({c for _, c, _ in brute_classes([r for r in rows if shingle_set(r[1])])}) == kept.where("trim(translate(text, '\n\t', '')) <> ''").count()
    assert jaccard.joined_documents(none).count() == jaccard.one_of_each_class(none).count() == 0


def test_one_of_each_class_with_shared_ids(spark):
    """Classes whose smallest ids are equal, or all null, each keep a row; so does every row without words."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    three, four = " ".join(f"c{i}" for i in range(40)), " ".join(f"d{i}" for i in range(40))
    rows = [(None, one), (None, one), (None, two), (7, three), (9, three + " end"), (7, four), (8, four), (None, four)]
    bare = [(None, None), (None, ""), (None, " \t"), (3, None), (3, ""), (3, ""), (3, "\n\x0b")]
    df = spark.createDataFrame(rows + bare, "doc_id long, text string").repartition(3)
    want = [(None, one), (None, two), (7, three), (7, four)] + bare
    assert table(jaccard.one_of_each_class(df), "doc_id", "text") == sorted(want, key=repr)
    wide = df.withColumn("n", F.length("text"))
    assert table(jaccard.one_of_each_class(wide), "doc_id", "text") == sorted(want, key=repr)
    assert jaccard.joined_documents(df).columns == ["doc_id", "class_id", "n_links"]


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randint(0, 5)):
            ws[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(ws)))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(jaccard.joined_documents(df), "doc_id", "class_id", "n_links") == sorted(brute_classes(rows), key=repr)


def test_pruning_bound():
    import random

    for n, least in jaccard.keep_from(0.8, 160):
        assert 0 < least < 0.8 * n  # a pair at the threshold is far from being dropped
    rng = random.Random(1)
    bounds = jaccard.keep_from(0.8, 160)
    for _ in range(2000):
        hits, last, ok = 0, 0, True
        for n, least in bounds:
            hits += sum(rng.random() < 0.8 for _ in range(n - last))
            last = n
            ok = ok and hits >= least
        assert ok


def test_mixing(docs, none, rows):
    got = mixing.mixed_documents(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    by_size = {(sizes[s], round(t, 6)) for s, t in target.items()}
    assert {(g["source_size"], round(g["target"], 6)) for g in got} == by_size
    assert len(got) == len(rows) and all(g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0) for g in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs).collect()))
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert words == sum(g["taken"] for g in got)
    assert mixing.mixed_documents(none).count() == mixing.emit_mix(none).count() == 0


def test_fingerprints(docs, none, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.fingerprinted_documents(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for g in got:
        by_id[g["doc_id"]].append(g)
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    single = Counter(r[0] for r in rows)
    texts = {}
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)]
        fp = by_id[r[0]]
        if single[r[0]] == 1 and single[nxt[0]] == 1:
            cut = len(t) // 4
            edited = t[: len(t) - cut] + (nxt[1] or "")[:cut]
            assert fp[0]["n_chars"] == len(t)
            assert fp[0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (fp[0]["fingerprint"] == fp[0]["edited_fingerprint"]) == (t == edited)
        if single[r[0]] == 1:
            assert texts.setdefault(fp[0]["fingerprint"], t) == t
    assert fingerprints.fingerprinted_documents(none).count() == 0
    one = fingerprints.fingerprinted_documents(docs.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0


def test_roots_come_from_whole_digests(monkeypatch):
    """Names of one byte clash among 2,000 texts of one section; their roots do not."""
    import numpy as np

    monkeypatch.setattr(fingerprints, "NAME", 1)
    texts = [f"text number {i} of many".encode() for i in range(2000)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = [fp for fp, _ in fingerprints.trees(np.frombuffer(b"".join(texts), np.uint8), offsets)]
    parsed = [fingerprints.parse(fp) for fp in got]
    assert len({sections[0][0] for _, sections in parsed}) <= 256 and len({root for root, _ in parsed}) == 2000


def test_locate_edits(spark):
    ws = [f"word{i}" for i in range(300)]
    new = ws[:150] + ["changed"] + ws[151:]
    fps = [r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame([(0, " ".join(ws)), (1, " ".join(new))], "doc_id int, text string")).orderBy("doc_id").collect()]
    edits = fingerprints.locate_edits(*fps)
    assert edits and all(lo <= 150 + 24 and hi >= 150 - 24 for lo, hi in edits) and any(lo <= 150 < hi for lo, hi in edits)
    assert fingerprints.locate_edits(fps[0], fps[0]) == []
    assert 0.8 < fingerprints.likeness(*map(fingerprints.leaf_weights, fps)) < 1


def brute_language(rows, ranks=300):
    def grams(text):
        low, out = "".join(c if c.isalpha() else " " for c in (text or "").lower()), Counter()
        for w in low.split():
            m = "_" + w + "_"
            out.update(w)
            out.update(m[i : i + 2] for i in range(len(m) - 1))
            out.update(m[i : i + 3] for i in range(len(m) - 2))
        return out

    profiles = defaultdict(Counter)
    for r in rows:
        if r[2] is not None and crc(r[0], 4) != 2:
            profiles[r[2]] += grams(r[1])
    return profiles, grams


def test_language(docs, none, rows):
    got = language.identified_documents(docs).collect()
    assert len(got) == len(rows)
    letters = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    for g in got:
        assert g["held_out"] == (crc(g["doc_id"], 4) == 2) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (g["doc_id"] in letters) and g["lang_pred"] in ("und", "en", "fr")
    assert language.identified_documents(none).count() == 0


def test_language_ranks(spark):
    rows = [(0, "the cat and the hat the end", "en", None), (1, "le chat et la fin de la rue", "fr", None), (2, "la rue de la fin", None, None), (3, "the hat", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    profiles = language.train(df)
    counts, grams = brute_language([r for r in rows], 300)
    sizes = {k: len(v) for k, v in counts.items() if v}
    for lang in sizes:
        whole = Counter()
        for r in rows:
            if r[2] == lang:
                whole += grams(r[1])
        assert len(profiles.ranked[lang]) == len(whole)
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(df.select("doc_id", "text"), profiles).collect()}
    assert out == {0: "en", 1: "fr", 2: "fr", 3: "en"}


def test_language_is_the_brute_force_one(spark):
    """Predictions and scores in scripts with thousands of letters, with ties and odd characters."""
    import random

    rng = random.Random(4)
    han, kana = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)], [chr(0x3041 + i) for i in range(80)]
    make = {
        "en": lambda n: sentence(rng, n // 5 + 1, "etaoinshrdlu"), "zh": lambda n: "".join(rng.choice(han) for _ in range(n)),
        "ja": lambda n: "".join(rng.choice(kana + han[:40]) for _ in range(n)), "none": lambda n: "123 ...",
    }
    rows = [(i, make[lang](rng.choice([3, 40, 900])), lang, None) for i, lang in enumerate([*make] * 12)]
    rows += [(900 + i, t, None, None) for i, t in enumerate(["İstanbul ı ẞ", "日本語 and English", "", None, "!!!", "a", "テスト" * 50, han[0] * 3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    ranks = 50
    counts, grams = brute_language([], ranks)
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), [0 if ch == "_" else ord(ch) for ch in x[0]]))[:ranks]]
    profiles = {}
    for lang in make:
        whole = Counter()
        for r in rows:
            if r[2] == lang:
                whole += grams(r[1])
        profiles[lang] = {g: i for i, g in enumerate(order(whole))}
    want = {}
    for r in rows:
        own = order(grams(r[1] or ""))
        far = {lang: sum(abs(p[g] - i) if g in p else ranks for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[r[0]] = (best, 1 - far[best] / (ranks * len(own))) if own else ("und", 0.0)
    learned = language.train(df, ranks=ranks)
    assert {k: len(v) for k, v in learned.ranked.items()} == {k: len(v) for k, v in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df.select("doc_id", "text"), learned).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    right = [r for r in rows if r[2] in ("en", "zh", "ja") and len(r[1]) > 20]
    assert all(got[r[0]][0] == r[2] for r in right)


def test_language_of_two_hundred(spark):
    """Two hundred languages: the places of all their n-grams stay small."""
    rows = [(i, "".join(chr(0x4E00 + 97 * i % 20000 + j) for j in range(60)), f"l{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(df.select("doc_id", "text"), language.train(df)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in got)


def test_language_merges_in_parts(rows):
    """Counts handed on in several parts add up to those made at once."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array(["x"] * len(rows))], ["text", "lang"])

    def total():
        out = Counter()
        for part in language._gram_counts([batch, batch]):
            for g, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                out[g] += n
        return out

    whole, held = total(), language.HELD
    try:
        language.HELD = 50
        assert total() == whole
    finally:
        language.HELD = held


def odd_columns(docs):
    """Names that are no plain words, a map and a struct."""
    return docs.select("*", F.lit(1).alias("my col-x"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.struct(F.lit("a").alias("b c")).alias("s.t"))


def test_stages_take_odd_columns(spark, docs):
    odd = odd_columns(docs.where("text is not null"))
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources):
        kept = stage(spark, odd, "")
        assert kept.columns == odd.columns and kept.count() > 0
    encoded = pieces.encode(odd, pieces.public_model())
    assert encoded.columns == [*odd.columns, "n_tokens", "ids", "decoded"] and encoded.count() == odd.count()


def test_pieces_in_a_small_room(docs, rows):
    """A table that starts afresh after every slice changes no result."""
    small = pieces.encode(docs, pieces.public_model(), keep=["doc_id"], digest=True, room=1)
    assert table(small, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == table(pieces.encoded_documents(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_taken_names_are_refused(docs):
    clash = docs.withColumn("__text", F.lit("x"))
    with pytest.raises(ValueError):
        language.predict(clash, language.Profiles({}, 5))
    assert pieces.encode(clash, pieces.public_model()).select("__text").distinct().count() == 1


def test_language_stage_rejects_other_latin_texts(spark):
    """Random letters, base64 and languages without labels go; clean texts of any length stay."""
    import base64
    import random

    rng = random.Random(11)
    words = {
        "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei".split(),
    }
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    clean = [(lang, say(lang, rng.choice([3, 6, 12, 40, 150, 400]))) for lang in words for _ in range(150)]
    clean += [(None, say(lang, n)) for lang in words for n in (4, 20, 100, 600)]
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (150, 600, 3000)]
    coded = [base64.b64encode(rng.randbytes(n)).decode() for n in (120, 500, 2000)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(clean)] + [(-1 - i, t, None) for i, t in enumerate(letters + coded + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.identify_language(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(clean)))


@pytest.mark.parametrize("order", [2, 3])
def test_katz_sums_to_one(spark, order):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "e", "f", f"rare{i}"]) for _ in range(30)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, __text string").select("__text")
    schema = "".join(f"g{j} long, " for j in range(1, order)) + "w long, n long"
    grams = df.mapInArrow(katz._grams(order), schema)
    model = katz.fit(grams, order)
    total = model.words.agg(F.sum("p")).first()[0] + model.unknown
    assert abs(total - 1) < 1e-9
    context = [f"g{j}" for j in range(1, order)]
    some = grams.select(*context).distinct().limit(12)
    vocabulary = model.words.select("w")
    everything = some.crossJoin(vocabulary).withColumn("n", F.lit(1))
    unknown = some.withColumn("w", F.lit(-1).cast("long")).withColumn("n", F.lit(1))
    probs = katz.score_grams(everything.unionByName(unknown), model).groupBy(*context).agg(F.sum(F.pow(F.lit(10.0), "lp")).alias("p")).collect()
    assert len(probs) == some.count() and all(abs(r["p"] - 1) < 1e-9 for r in probs)


def test_katz_documents(docs, none, rows):
    import math

    got = katz.scored_documents(docs).collect()
    assert len(got) == len(rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*WORD.findall((r[1] or "").translate(low)), None] for r in rows]
    c = Counter(t for r, ts in zip(rows, tokens) if crc(r[0], 5) != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r[0]), len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for r, ts in zip(rows, tokens))
    assert sorted((repr(g["doc_id"]), g["n_tokens"], g["n_known"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["train_tokens"] == n and g["held_out"] == (crc(g["doc_id"], 5) == 1) and math.isfinite(g["score"]) for g in got)
    assert katz.scored_documents(none).count() == 0


def test_good_turing_falls_back():
    assert katz.good_turing({}) == {}
    assert katz.good_turing({1: 10, 2: 10, 3: 10}) == {}
    full = katz.good_turing({1: 100, 2: 40, 3: 22, 4: 14, 5: 10, 6: 7})
    assert set(full) == {1, 2, 3, 4, 5} and all(0 < d < 1 for d in full.values())


def test_pipeline(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert docs.columns == columns
        if name == "language":
            assert docs.where("lang = 'und'").count() == 0
        if name == "near_duplicates":
            kept = [tuple(r) for r in before.collect()]
            assert docs.count() == len({c if c is not None else object() for _, c, _ in brute_classes(kept)})
        if name == "repeats":
            assert docs.count() == before.count()
        if name == "mixture":
            ids = Counter(r["doc_id"] for r in docs.collect())
            assert all(n <= 3 * Counter(x["doc_id"] for x in before.collect())[i] for i, n in ids.items())
        if name == "pieces":
            assert docs.count() == before.count()
            # the decoded text is the text; the model only takes literal marks for spaces
            assert sorted(r["decoded"] for r in docs.collect()) == sorted((r["text"] or "").replace("▁", " ") for r in before.collect())
    end = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, end.collect())) == sorted(map(str, docs.collect()))


def brute_katz(rows, k=5):
    """Log10 probabilities of whole texts by a bigram Katz model with Good-Turing discounts, with plain dictionaries."""
    import math

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*WORD.findall((r[1] or "").translate(low)), None] for r in rows]
    pairs = [list(zip(["<s>", *(("w", t) for t in ts[:-1])], ts)) for ts in tokens]
    trained = [p for r, p in zip(rows, pairs) if crc(r[0], 5) != 1]
    one, two = Counter(w for p in trained for _, w in p), Counter(x for p in trained for x in p)
    d1, d2 = katz.good_turing(Counter(one.values()), k), katz.good_turing(Counter(two.values()), k)
    n = sum(one.values())
    whole = n if d1 else n + 1
    p1 = {w: c * d1.get(c, 1.0) / whole for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    after = {}
    for (g, w), c in two.items():
        after.setdefault(g, {})[w] = c

    def lp(g, w):
        if g not in after:
            return math.log10(p1.get(w, unknown))
        total, kept = sum(after[g].values()), sum(c * d2.get(c, 1.0) for c in after[g].values())
        total += 0 if kept < total else 1
        if w in after[g]:
            c = after[g][w]
            return math.log10(c * d2.get(c, 1.0) / total)
        return math.log10((1 - kept / total) / (1 - sum(p1[x] for x in after[g]))) + math.log10(p1.get(w, unknown))

    return [sum(lp(g, w) for g, w in p) for p in pairs]


@pytest.mark.parametrize("size, passes", [(3_000_000, 2), (50, 3)])
def test_katz_scores(spark, docs, rows, size, passes):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    more = [(100 + i, " ".join(rng.choice(words[: rng.choice([3, 30, 300])]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    more += [(300 + i, t) for i, t in enumerate([None, "", "never seen", more[0][1]])] + [more[1]]
    for given in ([(r[0], r[1]) for r in rows], more):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        got = katz.scored_documents(df, rows=size, passes=passes).collect()
        assert sorted((repr(g["doc_id"]), round(g["score"], 6)) for g in got) == sorted((repr(r[0]), round(x, 6)) for r, x in zip(given, brute_katz(given)))


def _texts(n, size):
    rng = random.Random(3)
    passage = sentence(rng, 100)
    return [sentence(rng, size // 5) + (passage if i % 3 == 0 else "") for i in range(n)]


def _arrow(texts):
    spans = [[{"lo": 1, "hi": 4}, {"lo": i % 50, "hi": i % 50 + 9}] if i % 2 else None for i in range(len(texts))]
    ids = pa.array(range(len(texts)), pa.int64())
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    return pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts, pa.string()), pa.array(spans, kind)], names=["__i", "__a", "__b", "__text", "__spans"])


@pytest.mark.parametrize(
    "stage",
    [
        repeats._positions(400), repeats._finish(True), repeats._finish(False), jaccard._sketch(5, 4, 2), jaccard._signed_sets(5, 8),
        language._predict(language.Profiles({"en": [97, 98, 99], "fr": [100, 97]}, 3), True),
    ],
)
def test_a_batch_leaves_in_parts(stage):
    """A batch of several megabytes gives several small ones, with the rows that it gives text by text."""
    whole = _arrow(_texts(300, 5000))
    out = list(stage(iter([whole])))
    assert len(out) >= 4 and max(b.num_rows for b in out) < sum(b.num_rows for b in out) / 2
    alone = [r for i in range(0, 300, 7) for b in stage(iter([whole.slice(i, 1)])) for r in b.to_pylist()]
    every = [r for b in out for r in b.to_pylist()]
    assert [r for r in every if r["__i"] % 7 == 0] == alone


def test_many_classes_of_one_rank_take_little_memory():
    """Strings of 1,000 contexts around one passage: what repeats is found, at a few bytes a string."""
    rng, half, n = random.Random(4), 50, 1000
    make = lambda k: bytes(rng.choice(b"ab") for _ in range(k))
    core, ends = make(half), [make(half) for _ in range(100)]
    contexts = [make(half) + core + (ends[i % 100] if i % 4 == 0 else make(half)) for i in range(n)]
    sizes = [2 if i % 50 == 0 else 1 for i in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * n), pa.array(range(n)), pa.array(sizes), pa.array([half] * n), pa.array(contexts, pa.binary())], names=["k", "c", "n", "before", "context"]
    )
    refine = repeats._refine(2 * half)
    tracemalloc.start()
    out = list(refine(iter([batch.slice(i, 300) for i in range(0, n, 300)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = Counter()
    for c, m in zip(contexts, sizes):
        for d in range(half + 1):
            places[d, c[d : d + 2 * half]] += m
    want = []
    for x, c in enumerate(contexts):
        again = [d for d in range(half + 1) if places[d, c[d : d + 2 * half]] > 1]
        want.append((7, x, sorted({p - half for d in again for p in range(d, d + 2 * half)})))
    found = [r for b in out for r in b.to_pylist()]
    assert [(r["k"], r["c"], sorted({p for s in r["spans"] for p in range(s["lo"], s["hi"])})) for r in found] == want
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    assert peak < 60 * (half + 1) * n
