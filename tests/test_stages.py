"""Plans as pipeline stages: saved, loaded in a new session, equal rows."""

import uuid

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from queryset.base import read
from tablefit.plans.plan import apply_plan, build_plan
from tablefit.plans.stages import PlanEstimator, PlanModel, fit_pipeline, load_pipeline
from tablefit.sources.tables import shared_folder

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def same_types(df):
    """Numbers as doubles; other columns as they are."""
    numbers = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    return df.select([F.col(f"`{c}`").cast("double") if c in numbers else F.col(f"`{c}`") for c in df.columns])


@pytest.mark.parametrize("rules", ["simple", "strict"])
def test_plan_stage_is_the_plan(spark, rules):
    df = read(spark, SF_DIR, "orders_dirty")
    stage = PlanEstimator(target="o_orderstatus", rules=rules).fit(df)
    want = apply_plan(df, build_plan(df, "o_orderstatus", rules))
    got = stage.transform(df)
    assert got.columns == want.columns and rows(same_types(got)) == rows(same_types(want))
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    stage.write().overwrite().save(path)
    back = PlanModel.load(path)
    assert back.uid == stage.uid and back.getOrDefault("rules") == rules and rows(back.transform(df)) == rows(got)


def test_pipeline_in_a_new_session(spark):
    df = read(spark, SF_DIR, "orders_dirty")
    model = fit_pipeline(df, "o_orderstatus", RandomForestClassifier(labelCol="o_orderstatus", numTrees=5, seed=1), keep=["o_orderkey"])
    want = model.transform(df).select("o_orderkey", "prediction")
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    other = spark.newSession()
    back = load_pipeline(other, path)
    assert isinstance(back, PipelineModel) and len(back.stages) == 3
    fresh = read(other, SF_DIR, "orders_dirty")
    assert rows(back.transform(fresh).select("o_orderkey", "prediction")) == rows(want)
    # a table without the target can be scored
    assert back.transform(fresh.drop("o_orderstatus")).where("prediction is null").count() == 0


def test_estimator_in_a_pipeline(spark):
    df = read(spark, SF_DIR, "part_mixed").drop("p_partkey")
    from pyspark.ml.feature import VectorAssembler

    names = [c for c in PlanEstimator(target="p_retailprice").fit(df).transform(df).columns if c != "p_retailprice"]
    fitted = Pipeline(stages=[PlanEstimator(target="p_retailprice"), VectorAssembler(inputCols=names, outputCol="features"), LinearRegression(labelCol="p_retailprice")]).fit(df)
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    fitted.save(path)
    assert rows(PipelineModel.load(path).transform(df).select("prediction")) == rows(fitted.transform(df).select("prediction"))
