"""Edge tables: empty, one row, all null, constant, NaN, odd names, booleans, many columns."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.operators import profile as P
from tablefit.operators.clean import dedupe, impute_auto
from tablefit.operators.encode import one_hot, scale_standard
from tablefit.operators.facts import Facts
from tablefit.operators.issues import readiness
from tablefit.operators.quality import quality_score
from tablefit.plans.modes import clean, to_ml
from tablefit.sources.tables import normalise, require_rows


def test_empty_and_one_row(spark):
    schema = "a double, b string, c timestamp"
    empty = spark.createDataFrame([], schema)
    assert P.profile_numeric(empty).collect()[0]["mean"] == 0.0
    assert Facts(empty).rows == 0
    one = spark.createDataFrame([(1.0, "x", None)], schema)
    row = P.profile_numeric(one).collect()[0]
    assert (row["mean"], row["std"], row["skewness"], row["outlier_count"]) == (1.0, 0.0, 0.0, 0)
    with pytest.raises(ValueError):
        require_rows(one, 5)


def test_nan_is_null_and_constant_columns(spark):
    df = spark.createDataFrame([(float("nan"), 5.0, None), (1.0, 5.0, None), (3.0, 5.0, None)], "a double, k double, e double")
    t = {r["column"]: r for r in P.profile_numeric(df).collect()}
    assert t["a"]["missing_count"] == 1 and t["a"]["mean"] == 2.0
    assert t["k"]["std"] == 0.0 and t["k"]["skewness"] == 0.0 and t["e"]["missing_count"] == 3
    assert all(r is None for p, r in Facts(df).corr().items())


def test_odd_names_and_booleans(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False), (2, "y", None), (4, None, True)], "`a.b` long, `the col` string, `tick``s` boolean")
    assert P.table_summary(df).collect()[0]["missing_values"] == 2
    assert impute_auto(df).where("`the col` is null or `tick``s` is null").count() == 0
    assert one_hot(df.select("`a.b`", "`the col`"), ["the col"]).columns == ["a.b", "the col_y"]
    assert scale_standard(df.select("`a.b`")).count() == 4


def test_nested_types_are_refused(spark):
    with pytest.raises(ValueError):
        normalise(spark.sql("select array(1, 2) as a"))


def test_null_and_text_nan_are_not_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("", "a")], "x string, y string")
    assert Facts(df).duplicates() == 1
    assert dedupe(df).count() == 3


def test_many_columns(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 60)), columns=[f"c{i}" for i in range(60)])
    pdf["c59"] = pdf["c0"] * 2
    pdf.loc[::7, "c3"] = np.nan
    f = Facts(spark.createDataFrame(pdf))
    r = f.corr()
    want = pdf.corr()
    assert len(r) == 60 * 59 // 2
    assert all(r[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a, b in r)
    q = f.quantiles([0.25, 0.5])
    assert all(q[c][0.5] == pytest.approx(pdf[c].median()) for c in pdf)


@pytest.fixture(scope="module")
def people(spark):
    """Customer-like table with planted dirt."""
    rows = []
    for i in range(500):
        age = None if i % 10 == 0 else float(20 + i * 7 % 50)
        rows.append((i, age, math.exp(7 + (i * 37 % 100) / 25), "MF"[i % 2], f"city{i % 8}", float(i * 13 % 100), f"note{i % 7}" if i % 10 < 3 else None, 1, int(i * 13 % 100 > 60)))
    return spark.createDataFrame(rows, "id long, age double, income double, gender string, city string, score double, notes string, constant_col long, target int")


def test_to_ml_is_numeric_and_complete(people):
    out = to_ml(people, "target")
    assert set(t for _, t in out.dtypes) <= {"double", "int", "bigint"}
    assert out.select(sum(F.col(f"`{c}`").isNull().cast("int") for c in out.columns).alias("n")).agg(F.sum("n")).first()[0] == 0
    assert "target" in out.columns and "id" not in out.columns and "notes" not in out.columns and "constant_col" not in out.columns
    assert len([c for c in out.columns if c.startswith("city_")]) == 7
    assert len(out.columns) - 1 >= 3


def test_clean_keeps_sparse_but_not_too_sparse(people):
    out = clean(people, "target")
    assert "notes" in out.columns and "constant_col" not in out.columns
    assert out.where("age is null or notes is null").count() == 0


def test_scores_do_not_depend_on_partitioning(people):
    a = quality_score(people, "target").collect()
    b = quality_score(people.repartition(7), "target").collect()
    assert a == b
    assert readiness(people, "target").collect() == readiness(people.repartition(3), "target").collect()
