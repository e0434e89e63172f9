"""The whole model search, importances and comparison of tables."""

import threading
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from tablefit.operators import encode as E
from tablefit.operators import training as TR
from tablefit.plans.plan import Plan, fit_plan


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": np.arange(240), "a": rng.normal(size=240), "b": np.exp(2 * rng.normal(size=240))})
    pdf["y"] = (pdf.a + np.log(pdf.b) + rng.normal(size=240) * 0.3 > 0).astype(int)
    pdf["z"] = 3 * pdf.a + rng.normal(size=240)
    pdf.loc[::17, "a"] = np.nan
    return spark.createDataFrame(pdf)


def test_search_of_classes(spark, table):
    data = table.select("id", "a", "b", "y")
    found = TR.search(data, "y", ["id"], folds=2, boost=3).toPandas()
    assert len(found) == 33 and found["is_ensemble"].sum() == 1
    single = found[~found["is_ensemble"]]
    assert single.groupby("model").size().to_dict() == {"LR": 8, "RF_shallow": 8, "RF_deep": 8, "GB": 8}
    assert single[single["model"] != "LR"].groupby(["model", "impute", "log_transform"])["score"].nunique().max() == 1
    # one branch by hand
    frame = TR.Frame(data, "y", ["id"], folds=2)
    filled = [f"{x}_i" for x in frame.cols]
    stages = [Imputer(strategy="mean", inputCols=frame.cols, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=500)]
    want = []
    for i in range(2):
        model = Pipeline(stages=stages).fit(frame.data.where(F.col("fold") != i))
        want.append(frame.score(model.transform(frame.data.where(F.col("fold") == i))))
    got = single[(single["model"] == "LR") & (single["impute"] == "mean") & ~single["log_transform"] & (single["scaler"] == "StandardScaler")]["score"].iloc[0]
    assert got == pytest.approx(np.mean(want), abs=1e-4)
    best = TR.search_report(spark.createDataFrame(found), 3).collect()
    assert [r["position"] for r in best] == [1, 2, 3] and best[0]["score"] == found["score"].max()


def test_search_of_numbers(table):
    found = TR.search(table.select("id", "a", "b", "z"), "z", ["id"], folds=2, boost=2).toPandas()
    assert len(found) == 41 and set(found["model"]) == {"Ridge_low", "Ridge_high", "RF_shallow", "RF_deep", "GB", "Voting Ensemble"}


def test_search_shares_fits_of_equal_tables(spark, table, monkeypatch):
    """Fills of no gap give one table, and so do logarithms where no column is skewed."""
    made, keep = [], TR.settle
    monkeypatch.setattr(TR, "settle", lambda df: made.append(df.columns) or keep(df))
    whole = table.select("id", F.coalesce("a", F.lit(0.0)).alias("a"), "b", "z")
    for data, tables in ((whole, 2 * 2 + 2), (whole.withColumn("b", F.col("a") - 2), 2 + 2)):
        made.clear()
        found = TR.search(data, "z", ["id"], folds=2, boost=2).toPandas()
        assert len([c for c in made if "scaled" in c]) == tables and len(found) == 41
        single = found[~found["is_ensemble"]]
        by = single.groupby(["model", "scaler", "log_transform"])["score"]
        assert by.nunique().max() == 1 and by.size().min() == 2


def test_folds_of_all_models_run_side_by_side(spark):
    meet = threading.Barrier(4, timeout=60)  # broken unless four fits run at once

    class Fake:
        copy = lambda self: Fake()
        hasParam = lambda self, name: False

        def fit(self, data):
            meet.wait()
            self.rows = data.count()
            return self

        def transform(self, data):
            return data.count() + self.rows / 1000

    data = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("fold"))
    frame = SimpleNamespace(k=2, vectors=data, data=data, score=float)
    got = TR.fold_scores(frame, {"one": Fake(), "two": Fake()}).drop("seconds").collect()
    assert [tuple(r) for r in got] == [(n, i, 20.02, 20.02) for n in ("one", "two") for i in (0, 1)]


def test_importances_and_winner(table):
    t = TR.train_importances(table.select("id", "a", "b", "z"), "z", ["id"], trees=5, folds=2).collect()
    assert [r["position"] for r in t] == [1, 2] and t[0]["feature"] == "a" and t[0]["importance"] > 0.5
    noise = table.withColumn("z", F.rand(3))
    r = TR.compare_models(noise.select("id", "a", "b", "z"), table.select("id", "a", "b", "z"), "z", ["id"], trees=5).first()
    assert r["winner"] == "table_2" and r["delta"] > 0


def test_quick_score_fits_folds_once_and_scores_held_out_rows(table, monkeypatch):
    data = table.select("id", "a", "b", "z")
    frame = TR.Frame(data, "z", ["id"], "regression", folds=3)
    every = TR.fold_scores(frame, {"Random Forest": TR.catalogue(frame, 5)["Random Forest"]}).agg({"score": "avg"}).first()[0]
    scored, keep = [], TR.Frame.score
    monkeypatch.setattr(TR.Frame, "score", lambda self, pred: scored.append(pred.select("fold").distinct().count()) or keep(self, pred))
    assert TR.quick_score(data, "z", ["id"], "regression", 5) == pytest.approx(every, abs=1e-12)
    assert scored == [1, 1, 1]


def test_too_many_categories_for_columns(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 20).cast("string").alias("many"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("few"))
    out = E.one_hot(df, ["many", "few"], most=10)
    assert set(out.columns) == {"id", "many", "few_y"} and {r["many"] for r in out.select("many").distinct().collect()} == {0.05}
    assert E.categories(df, "many", 10) is None and len(E.categories(df, "many", 20)) == 20


def test_plan_falls_back_to_shares(spark, monkeypatch):
    from tablefit.plans import plan as P

    df = spark.range(40).select((F.col("id") % 8).cast("string").alias("c"), F.col("id").cast("double").alias("y"))
    plan = Plan("y", [("c", "encode", "OneHotEncoding", "")])
    assert len(fit_plan(df, plan).apply(df).columns) == 8
    monkeypatch.setattr(P, "categories", lambda d, n: None)
    fitted = fit_plan(df, plan)
    assert [s[2] for s in fitted.steps] == ["FrequencyEncoding"] and "instead_of" in fitted.log().first()["params"]
    assert {r["c"] for r in fitted.apply(df).select("c").distinct().collect()} == {0.125}


def test_fixes_that_leave_the_matrix_share_its_score(spark, monkeypatch):
    df = spark.range(300).select(
        "id", (F.col("id") * 37 % 101).alias("a"), F.when(F.col("id") % 9 == 0, "note").alias("memo"), F.when(F.col("id") * 37 % 101 > 50, "x").otherwise("y").alias("y"))
    scored, keep = [], TR.Frame.score
    monkeypatch.setattr(TR.Frame, "score", lambda self, pred: scored.append(1) or keep(self, pred))
    steps = {r["fix"]: r["score"] for r in TR.fix_impact(df, "y", ["id"], trees=3).collect()}
    assert steps["drop_sparse"] == steps["baseline"] and len(scored) == 3 * (len(steps) - 1)
    one = TR.Frame(df.drop("memo"), "y", ["id"], folds=3)
    other = TR.Frame(df.drop("memo").withColumn("a", F.when(F.col("id") == 7, -1).otherwise(F.col("a"))), "y", ["id"], folds=3)
    assert one.content() == TR.Frame(df, "y", ["id"], folds=3).content() != other.content()
