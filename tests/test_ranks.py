"""Exact order statistics against pandas and brute force, also on the narrowing path and with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.ranks import attach_values, average_rank, distinct_counts, exact_quantiles, hash_row_number, running_total
from tablefit.operators.encode import encode_label, value_codes
from tablefit.operators.relate import _discordant, kendall, spearman
from tablefit.sources.tables import normalise


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    x = rng.normal(size=4000)
    x[:1400] = 0.5  # one value holds a third of the rows
    y = np.round(x * 2 + rng.normal(size=4000), 1)
    z = rng.integers(0, 4, 4000).astype(float)
    z[::9] = np.nan
    return pd.DataFrame({"id": np.arange(4000), "x": x, "y": y, "z": z})


@pytest.mark.parametrize("accuracy,limit", [(5000, 100_000), (50, 40), (20, 3)])
def test_quantiles_match_pandas(spark, frame, accuracy, limit):
    df = spark.createDataFrame(frame).repartition(4)
    df = df.select("id", *[F.nanvl(n, F.lit(None)).alias(n) for n in "xyz"])
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "y", "z", "id"], probs, accuracy, limit)
    for n in ("x", "y", "z", "id"):
        for p in probs:
            assert got[n][p] == pytest.approx(frame[n].quantile(p), abs=1e-12)


def test_average_rank_with_hot_value(spark, frame):
    counted = spark.createDataFrame(frame[["x"]]).groupBy("x").agg(F.count("*").alias("cnt")).withColumn("column", F.lit("x"))
    got = average_rank(counted, ["column"], "x", "cnt").toPandas().set_index("x")["rank"].sort_index()
    want = frame["x"].rank().groupby(frame["x"]).first()
    assert np.allclose(got.values, want.values)


def test_running_total_without_group(spark):
    counted = spark.range(500).select((F.col("id") * 3 % 500).alias("v"), F.lit(2).alias("n"))
    got = running_total(counted, [], "v", ["n"], buckets=8).orderBy("v").toPandas()
    assert (got["n_upto"] == got["n"].cumsum()).all()


def test_hash_row_number_is_a_permutation(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 10, None).otherwise("b").alias("g"))
    got = hash_row_number(df, ["g"], ["id"]).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))
        assert (part["rn_of"] == len(part)).all()


def test_attach_values_splits_hot_values(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1500)).alias("k"))
    look = df.groupBy("k").agg(F.count("*").alias("cnt")).withColumn("code", F.col("cnt") * 10)
    want = {r["id"]: r["code"] for r in df.join(look, "k").collect()}
    got = {r["id"]: r["code"] for r in attach_values(df, look, "k", "cnt", 6000, small=10).collect()}
    assert got == want


def test_value_codes_large_path(spark, monkeypatch):
    import tablefit.operators.encode as enc

    monkeypatch.setattr(enc, "SORT_IN_ONE", 50)
    values = spark.range(900).select(F.concat(F.lit("Customer#"), F.col("id")).alias("value"), F.lit(1).alias("cnt"))
    got = {r["value"]: r["code"] for r in value_codes(values).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def brute_tau(x, y):
    s = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])
    dx = (x[:, None] != x[None, :]).sum() / 2
    dy = (y[:, None] != y[None, :]).sum() / 2
    return s.sum() / 2 / np.sqrt(dx * dy)


def test_kendall_and_spearman(spark, frame):
    small = frame.head(1500)
    df = spark.createDataFrame(small)
    assert kendall(df, "x", "y") == pytest.approx(brute_tau(small["x"].values, small["y"].values), abs=1e-12)
    clean = spark.createDataFrame(small.astype(object).where(small.notna(), None), "id double, x double, y double, z double")
    pair = small[["x", "z"]].dropna()
    assert kendall(clean, "x", "z") == pytest.approx(brute_tau(pair["x"].values, pair["z"].values), abs=1e-12)
    rho = spearman(clean, [("x", "z")])[("x", "z")]
    assert rho == pytest.approx(pair["x"].rank().corr(pair["z"].rank()), abs=1e-9)


def test_running_total_ranges_follow_the_rows(spark):
    """Many small ranges and few large ones give the same totals."""
    df = spark.range(3000).select((F.col("id") * 7 % 3001).cast("double").alias("v"), (F.col("id") % 5).alias("n"), (F.col("id") % 2).alias("g"))
    few = running_total(df, ["g"], "v", ["n"]).orderBy("g", "v").collect()
    many = running_total(df, ["g"], "v", ["n"], bucket_rows=5).orderBy("g", "v").collect()
    assert few == many and len(few) == 3000
    total = {0: 0, 1: 0}
    for r in few:
        total[r["g"]] += r["n"]
        assert r["n_upto"] == total[r["g"]]


@pytest.mark.parametrize("cell_rows", [500_000, 100, 7])
def test_discordant_cells_by_ranges(spark, cell_rows):
    """Hot values, ties and weights; no range gathers a value that is a cut."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 60, 900).astype(float), rng.normal(size=900).round(1)
    x[:300], y[200:500] = 7.0, 0.5
    cells = pd.DataFrame({"x": x, "y": y}).groupby(["x", "y"]).size().rename("cnt").reset_index()
    x, y, n = (cells[k].to_numpy() for k in ("x", "y", "cnt"))
    want = int((((x[:, None] < x) & (y[:, None] > y)) * n[:, None] * n).sum())
    assert _discordant(spark.createDataFrame(cells).repartition(3), cell_rows) == want


def test_distinct_counts_in_several_passes(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 9).cast("int").alias("a.b"), (F.col("id") % 700 / 7).alias("d"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x" * 70), F.col("id") % 500)).alias("t"),
        (F.col("id") % 2 == 0).alias("f"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(0.0).alias("zero"))
    want = {"id": 3000, "a.b": 9, "d": 700, "t": 500, "f": 2, "none": 0, "zero": 1}
    for together in (1, 600, 1_000_000):
        assert distinct_counts(df, df.columns, 64, together) == want
    assert distinct_counts(df, [], 64) == {}


def test_encode_label_stores_many_values_once(spark, monkeypatch):
    import tablefit.operators.encode as enc

    df = spark.range(900).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("n"), (F.col("id") % 400))).alias("t"), (F.col("id") + 1).alias("k"))
    want = encode_label(df, "t").orderBy("id").collect()
    stored = []
    keep = enc.settle
    monkeypatch.setattr(enc, "settle", lambda d: stored.append(d.columns) or keep(d))
    monkeypatch.setattr(enc, "SORT_IN_ONE", 50)
    out = encode_label(df, "t")
    assert out.columns == ["id", "t", "k"] and out.orderBy("id").collect() == want
    assert stored == [["value", "cnt"], ["value", "cnt", "code"]]


def test_brackets_are_searched_in_long_form(spark, monkeypatch):
    """Generated code that grows with columns x quantiles is not compiled; narrowing and bracket values join instead."""
    import tablefit.functions.ranks as R

    asked, keep = [], R._inside
    monkeypatch.setattr(R, "_inside", lambda df, cols, keys, brackets: asked.append(list(keys)) or keep(df, cols, keys, brackets))
    pdf = pd.DataFrame({f"x{i}": np.arange(3000.0) ** (1 + i / 8) % (900 + i) for i in range(6)})
    pdf.loc[::4, "x3"], pdf.loc[::7, "x2"] = 5.0, np.nan
    probs = [k / 10 for k in range(1, 10)]
    df = normalise(spark.createDataFrame(pdf).repartition(3))
    got = exact_quantiles(df, list(pdf), probs, 50, 60)
    for n in pdf:
        for p in probs:
            assert got[n][p] == pytest.approx(pdf[n].quantile(p), abs=1e-12)
    assert len(asked) > 2 and max(map(len, asked)) > 20
    keys = [(i, p) for i in range(6) for p in probs]
    rows = keep(df, list(pdf), keys, {k: [1.0, 50.0] for k in keys})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000 and plan.count("Generate") == 1
    assert rows.groupBy("j").count().where("j = 13").first()["count"] == pdf["x1"].between(1, 50).sum()


def test_many_groups_are_dealt_out_before_counting(spark, monkeypatch):
    import tablefit.functions.ranks as R
    from tablefit.operators.facts import Facts
    from tablefit.operators.relate import mapped_columns

    df = spark.range(0, 2000, 1, 2).select(
        "id", (F.col("id") % 5).alias("few"), F.greatest(F.col("id") - 900, F.lit(0)).cast("string").alias("t"), (F.col("id") % 1000).alias("half"), F.concat(F.lit("n"), F.col("id")).alias("name"))

    def outcome():
        counted = R.group_many(df, ["t"], {"k": (F.count(F.lit(1)), F.sum("k"))}, 2000)
        held = counted.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
        assert {r["t"]: r["k"] for r in counted.collect()} == {"0": 901} | {str(i): 1 for i in range(1, 1100)}
        assert distinct_counts(df, df.columns, 64, 10) == {"id": 2000, "few": 5, "t": 1100, "half": 1000, "name": 2000}
        f = Facts(df.unionByName(df.limit(30)))
        assert f.duplicates() == 30 and mapped_columns(f, ["id", "few", "half"], "name") == ["id"]
        assert mapped_columns(f, ["id", "name", "half", "t"], "few") == ["id", "name", "half"]
        return held

    outcome()
    monkeypatch.setattr(R, "GROUP_ROWS", 50)
    assert outcome() < 100


def test_mapping_sorts_no_rows(spark, monkeypatch):
    import tablefit.operators.relate as RE
    from tablefit.operators.facts import Facts

    plans, keep = [], RE.group_many
    monkeypatch.setattr(RE, "group_many", lambda *a: plans.append(keep(*a)) or plans[-1])
    assert RE.mapped_columns(Facts(spark.range(50).select("id", F.col("id").cast("string").alias("y"))), ["id"], "y") == ["id"]
    assert plans and all("Sort" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
