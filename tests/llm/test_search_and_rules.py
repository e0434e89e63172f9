"""Top-k search and the rule classifier."""

import random

import pytest
from pyspark.sql import functions as F

from tablefit.llm import rules, topk
from tablefit.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(6)], 0, "x") for i in range(400)]
    rows += [(400 + i, rows[100][1], 1, None) for i in range(30)]  # ties
    rows += [(900, None, 0, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, None), (902, [float("nan")] * 6, 0, None), (903, [float("inf")] * 6, 0, None)]
    rows += [(1000, [0.0] * 6, 0, None), (None, [1.0] * 6, 0, None), rows[100], (1100, [1.0, 1.0], 0, None), (1200, [], 0, None)]
    return rows


def brute(rows, k):
    import math

    import numpy as np

    good = {}
    for r in rows:
        v = r[1]
        if r[0] is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[r[0]] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q, a in good.items():
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 50])
def test_top_k(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", min(block, 512))
    df = spark.createDataFrame(vectors, VECTORS).repartition(2)
    got = sorted(tuple(r) for r in topk.embeddings_top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(vectors, 10)
    assert topk.embeddings_top_k(df.limit(0)).count() == 0


def test_search_stops_early():
    import numpy as np

    ids = np.arange(5000)
    vecs = np.zeros((5000, 2), np.int64)
    vecs[:20] = 1000 - np.arange(20)[:, None]
    found, scores = topk.threshold_search(ids, vecs, np.array([3, 1]), -1, 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and scores[0] == 4000


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    from tests.check_queries import compare, oracle_connection

    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, sf).toPandas(), oracle_connection(sf).execute(ORACLES[name]).fetchdf()) is None


def test_rules_are_paths():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 1.0
     Else (feature 1 > 2.0)
      Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 0.0
"""
    assert rules.tree_rules(text, ["a", "b"]) == [
        (("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)), (("a", ">", 0.5),)
    ]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = rules.scored_documents(docs, labels)
    row = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["a"] > 0.95 and 0 <= row["lo"] <= row["hi"] <= 1 and out.count() == docs.count()


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(-4, 1, 0), (2, 0, 0), (2, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = rules.scored_documents(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (1 if r["score"] >= 0.7 else 0) for r in out)
    assert rules.scored_documents(none, labels).count() == 0
    assert rules.scored_documents(docs, labels.limit(0)).count() == docs.count()


def brute_pairs(ids, vecs, q_ids, queries, k):
    out = []
    for own, q in zip(q_ids, queries):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q, v)), int(i)) for i, v in zip(ids, vecs) if i != own]
        out += [(int(own), i, -s) for s, i in sorted(scores)[:k]]
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "ties", "steep", "large", "few"])
def test_blocks_one_after_another(kind):
    """Queries keep what they found in earlier blocks; ties, own ids, shallow walks and numbers beyond doubles."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, dim, k = 700, 6, 10
    vecs = rng.integers(-2000, 2000, (n, dim))
    if kind == "ties":
        vecs[rng.random(n) < 0.7] = vecs[0]
    if kind == "steep":
        vecs, dim = (np.arange(n)[:, None] ** 3 // 1000 * np.array([[1, 1]])), 2
    if kind == "large":
        vecs = vecs * 500_000
    if kind == "few":
        vecs, n = vecs[:7], 7
    ids = rng.permutation(len(vecs) * 3)[: len(vecs)]
    own, queries = ids[:40], vecs[:40].copy()
    queries[1] = 0
    asked = topk._Asked([(own[:25], np.arange(25), queries[:25]), (own[25:], np.arange(25, 40)[: max(0, len(own) - 25)], queries[25:])] if n > 25 else [(own, np.arange(len(own)), queries)], k)
    for part in np.array_split(np.arange(n), 3):
        asked.meet(ids[part], vecs[part])
    got = asked.result().to_pydict()
    assert sorted(zip(got["query_id"], got["vec_id"], got["score"])) == brute_pairs(ids, vecs, own, queries, k)


def test_blocks_are_dealt_out_once(spark, vectors):
    """A vector block is not copied for every query block: no join, and many query blocks share a task."""
    df = spark.createDataFrame(vectors, VECTORS).repartition(2)
    found = topk.embeddings_top_k(df)
    assert "Join" not in found._jdf.queryExecution().toString()


def test_groups_of_queries(spark, vectors, monkeypatch):
    """Queries beyond the bytes of a task form groups that meet every block."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "BLOCK", 60)
    df = spark.createDataFrame(vectors, VECTORS).repartition(2)
    assert sorted(tuple(r) for r in topk.embeddings_top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == brute(vectors, 10)
