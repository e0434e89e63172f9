"""Flat forests against MLlib's own predictions and brute-force coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablefit.operators import training as TR
from tablefit.operators.forest import FlatForest, explain_rows, permuted_scores

COLS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)).round(2), columns=COLS)
    pdf["id"] = np.arange(400).astype(str)
    pdf["y"] = 2 * pdf.f0 + pdf.f1 * pdf.f2
    pdf["two"] = (pdf.y > 0).astype(float)
    pdf["three"] = pd.cut(pdf.y, [-99, -1, 1, 99], labels=False).astype(float)
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(spark.createDataFrame(pdf))


def fitted(table, label, depth=4, trees=5):
    kind = RandomForestRegressor if label == "y" else RandomForestClassifier
    return kind(numTrees=trees, maxDepth=depth, seed=1, labelCol=label).fit(table)


def expected(flat, t, x, known):
    """What one tree expects of a row of which only the features ``known`` are known."""
    def walk(at):
        f = flat.feature[at]
        if f < 0:
            return flat.value[at]
        left, right = flat.left[at], flat.right[at]
        if f in known:
            return walk(left if x[f] <= flat.threshold[at] else right)
        return (flat.weight[left] * walk(left) + flat.weight[right] * walk(right)) / flat.weight[at]
    return walk(flat.roots[t])


def brute(flat, x):
    n = flat.features
    v = lambda s: sum(expected(flat, t, x, s) for t in range(flat.trees)) / flat.trees
    out = np.zeros((n, flat.classes))
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(rest, k):
                out[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (v({*s, i}) - v({*s}))
    return out


@pytest.mark.parametrize("label, depth", [("y", 4), ("two", 7), ("three", 4), ("two", 0)])
def test_predictions_and_values(table, label, depth):
    model = fitted(table, label, depth)
    flat = FlatForest.of(model, 4)
    x = np.array([[r[c] for c in COLS] for r in table.select(*COLS).collect()])
    said = flat.predict(x)
    out = F.array("prediction") if label == "y" else vector_to_array("probability")
    want = np.array([r[0] for r in model.transform(table).select(out).collect()])
    assert np.allclose(said, want)
    values = flat.attribute(x)
    assert np.allclose(values.sum(axis=1), said - flat.base())
    for i in (0, 17, 399):
        assert np.allclose(values[i], brute(flat, x[i]))


def test_missing_numbers_go_right(table):
    flat = FlatForest.of(fitted(table, "y"), 4)
    x = np.array([[np.nan, 0.3, np.nan, -1.0]])
    assert np.allclose(flat.attribute(x)[0], brute(flat, x[0])) and np.allclose(flat.attribute(x).sum(axis=1), flat.predict(x) - flat.base())
    assert flat.attribute(np.zeros((0, 4))).shape == (0, 4, 1) and flat.predict(np.zeros((0, 4))).shape == (0, 1)


@pytest.mark.parametrize("label", ["y", "two", "three"])
def test_explained_rows(table, label):
    flat = FlatForest.of(fitted(table, label), 4)
    rows = explain_rows(table, flat, COLS, "id").collect()
    assert len(rows) == 400
    for r in rows[:20]:
        x = np.array([r["inputs"]])
        if label == "three":
            assert np.allclose(r["values"], np.abs(flat.attribute(x)[0]).mean(axis=1)) and r["base"] is None
        else:
            assert np.isclose(sum(r["values"]), r["output"] - r["base"])
            assert np.isclose(r["output"], flat.predict(x)[0, -1])


@pytest.mark.parametrize("label", ["y", "two"])
def test_permuted_scores_are_those_of_a_loop(table, label):
    model = fitted(table, label)
    flat = FlatForest.of(model, 4)
    ordered = table.withColumn("h", F.md5("id"))
    got = {(r["feature"], r["rep"]): r for r in permuted_scores(ordered, flat, COLS, label, "h", 3, 400, block=100).collect()}
    assert len(got) == 13
    spot = F.conv(F.substring(F.md5("h"), 1, 8), 16, 10).cast("long") % 4
    pdf = ordered.select(spot.alias("block"), "h", label, *COLS).toPandas().sort_values(["block", "h"]).reset_index(drop=True)
    shuffled = {}
    for b, part in pdf.groupby("block"):
        rng = np.random.default_rng([42, int(b)])
        for rep in range(3):
            shuffled.setdefault(rep, []).append(part.index.to_numpy()[rng.permutation(len(part))])
    for j in range(-1, 4):
        for rep in range(3 if j >= 0 else 1):
            swapped = pdf.copy()
            if j >= 0:
                swapped[COLS[j]] = pdf[COLS[j]].to_numpy()[np.concatenate(shuffled[rep])]
            frame = VectorAssembler(inputCols=COLS, outputCol="features").transform(table.sparkSession.createDataFrame(swapped))
            e = F.col(label) - F.col("prediction")
            want = model.transform(frame).agg(F.sum(e * e).alias("sse"), F.count_if(e == 0).alias("hit"), F.count("*").alias("n")).first()
            r = got[j, rep]
            assert r["n"] == want["n"] == 400 and np.isclose(r["sse"], want["sse"]) and (label == "y" or r["hit"] == want["hit"])


def test_attribution_tables(table):
    data = table.select("id", "y", *COLS)
    found = TR.attribution(data, "y", ["id"], trees=8)
    assert found.features == COLS
    top = found.summary().orderBy(F.col("mean_abs").desc()).first()
    assert top["feature"] == "f0"
    rows = found.top(3).collect()
    assert len(rows) == 400 and all(len(r["top_features"]) == 3 for r in rows)
    for r in rows[:50]:
        sizes = [abs(t["value"]) for t in r["top_features"]]
        assert sizes == sorted(sizes, reverse=True) and all(t["increases"] == (t["value"] > 0) for t in r["top_features"] if t["value"])
    wide = found.rows.select(*[F.col("values")[i].alias(c) for i, c in enumerate(COLS)]).toPandas()
    want = wide.corr().abs().where(np.triu(np.ones((4, 4)), k=1).astype(bool)).stack().sort_values(ascending=False)
    got = found.interactions().toPandas()
    assert len(got) == 5 and np.allclose(got["interaction_strength"], want.to_numpy()[:5], atol=1e-4)
    assert "Generate" not in found.top(3)._sc._jvm.PythonSQLUtils.explainString(found.top(3)._jdf.queryExecution(), "simple")


def test_importance_finds_the_signal(table):
    t = {r["feature"]: r for r in TR.importance(table.select("id", "y", *COLS), "y", ["id"], repeats=2, trees=8).collect()}
    assert t["f0"]["permutation"] > t["f3"]["permutation"] and t["f0"]["tier"] == "HIGH" and t["f0"]["permutation_std"] >= 0
    constant = table.select("id", F.lit(1.0).alias("same"), *COLS)
    assert TR.importance(constant, "same", ["id"], repeats=1, trees=2).count() == 4


def test_values_by_tables_and_cells(table):
    """Tables of met features and one evaluation per cell give what every row by itself gives."""
    x = np.array([[r[c] for c in COLS] for r in table.select(*COLS).collect()])
    x[3, 1], x[4, 2], x[5, 0] = np.nan, np.inf, -np.inf
    for label in ("y", "three"):
        flat = FlatForest.of(fitted(table, label, 6), 4)
        alone = np.concatenate([flat.attribute(x[i : i + 1]) for i in range(len(x))])
        assert np.allclose(flat.attribute(x), alone, atol=1e-12)
        first, cell = flat.cells(x)
        assert np.allclose(flat.attribute(x[first])[cell], alone, atol=1e-12) and np.array_equal(flat.predict(x[first])[cell], flat.predict(x))
        twice = np.tile(x, (3, 1))
        assert len(flat.cells(twice)[0]) == len(first)
