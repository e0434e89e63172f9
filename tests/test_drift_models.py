"""Drift properties, p-values, anomaly share, attribution sums, streaming against batch."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.pvalues import beta_i, chi2_sf, f_sf, kolmogorov_sf
from tablefit.operators import drift as D
from tablefit.operators import scoring as SC
from tablefit.operators import training as TR
from tablefit.operators import anomaly as AN
from tablefit.operators.anomaly import flag_anomalies
from tablefit.operators.facts import Facts
from tablefit.sources.tables import shared_folder
from tablefit.streaming.drift_stream import drift_stream, judge_open, verdicts


def test_published_tail_values():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert kolmogorov_sf(1.3580986393225507) == pytest.approx(0.05, abs=1e-6)
    grid = np.linspace(0, 0.3, 200_001)
    assert beta_i(2.5, 4.0, 0.3) == pytest.approx(np.trapezoid(grid ** 1.5 * (1 - grid) ** 3, grid) / (np.trapezoid(np.linspace(0, 1, 200_001) ** 1.5 * (1 - np.linspace(0, 1, 200_001)) ** 3, np.linspace(0, 1, 200_001))), abs=1e-6)


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    a = pd.DataFrame({"x": rng.normal(size=1500), "g": rng.choice(list("abcd"), 1500)})
    b = pd.DataFrame({"x": rng.normal(0.4, 1.3, size=900), "g": rng.choice(list("abce"), 900)})
    a.loc[:600, "x"] = 0.25
    return spark.createDataFrame(a), spark.createDataFrame(b), a, b


def test_equal_tables_do_not_drift(two):
    a = two[0]
    r = D.drift_numeric(a, a).first()
    assert (r["ks_statistic"], r["psi"], r["js_distance"], r["drift_severity"]) == (0.0, 0.0, 0.0, "STABLE")
    assert D.drift_categorical(a, a).first()["drift_severity"] == "STABLE"


def test_statistics_match_numpy_and_are_symmetric(two):
    a, b, pa, pb = two
    r = D.ks_2samp(a, b).first()
    both = np.sort(np.concatenate([pa.x, pb.x]))
    want = np.abs(np.searchsorted(np.sort(pa.x), both, "right") / len(pa) - np.searchsorted(np.sort(pb.x), both, "right") / len(pb)).max()
    assert r["ks_statistic"] == pytest.approx(want, abs=1e-4)
    assert D.js_distance(a, b).first()["js_distance"] == D.js_distance(b, a).first()["js_distance"]
    edges = np.unique(np.percentile(pa.x, np.linspace(0, 100, 11)))
    e, o = np.histogram(pa.x, edges)[0] / len(pa) + 1e-8, np.histogram(pb.x, edges)[0] / len(pb) + 1e-8
    e, o = e / e.sum(), o / o.sum()
    assert D.psi(a, b).first()["psi"] == pytest.approx(abs(((o - e) * np.log(o / e)).sum()), abs=1e-4)
    t = D.drift_categorical(a, b).first()
    assert (t["new_categories"], t["vanished_categories"], t["drift_severity"]) == (1, 1, "SIGNIFICANT_DRIFT")


def test_rank_positions(spark):
    every = spark.createDataFrame([("c", v) for v in "edcbahgf"], "column string, value string")
    got = D.running_positions(every, every.where("value in ('b', 'e', 'h')"))
    assert {r["value"]: r["pos"] for r in got.collect()} == {"b": 1, "e": 4, "h": 7}


def test_baseline_flags_missing_and_mismatched_columns(spark, two):
    base = D.Baseline.of(two[0])
    broken = two[1].select(F.col("x").cast("string").alias("x"))
    t = {(r["column"], r["check"]): r for r in D.drift_vs_baseline(base, broken).collect()}
    assert t["g", "missing_column"]["overall"] == "HIGH" and ("x", "type_mismatch") in t
    same = {r["column"]: r["severity"] for r in D.drift_vs_baseline(base, two[0]).collect()}
    assert same == {"x": "LOW", "g": "LOW"}


def test_stream_equals_batch(spark):
    root = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    events = spark.range(2000).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int") % 240)).alias("ts"),
        F.when(F.col("id") % 240 < 120, F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int"))).otherwise("c").alias("kind"),
    )
    events.write.parquet(f"{root}/in")
    base = D.Baseline.of(events.where("kind <> 'c'").select("kind"))
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    drift_stream(stream, base, "ts", ["kind"], f"{root}/out", f"{root}/cp").awaitTermination()
    judge_open(spark, base, f"{root}/out", f"{root}/cp")
    got = {(r["window_start"], r["psi"], r["severity"]) for r in spark.read.parquet(f"{root}/out").collect()}
    counts = events.groupBy(F.window("ts", "1 day").alias("w"), F.lit("kind").alias("column"), F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    want = {(r["window_start"], r["psi"], r["severity"]) for r in verdicts(counts, base).collect()}
    assert len(got) == 10 and got == want and {s for _, _, s in got} == {"LOW", "HIGH"}


def test_stream_judges_numeric_columns(spark):
    """A column that moves in half of the windows, one constant and one with a NaN, judged by the baseline's bins."""
    root = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    day = (F.col("id") % 6).cast("int")
    events = spark.range(6000).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=day)).alias("ts"),
        (F.floor(F.col("id") / 6) + F.when(day < 3, 0).otherwise(500)).cast("double").alias("x"), F.when(day < 5, 7).otherwise(8).alias("flat"),
        F.when(F.col("id") == 0, float("nan")).otherwise(F.floor(F.col("id") / 6) % 9).cast("double").alias("same"),
    )
    base = D.Baseline.of(events.where("ts < '2024-01-04'").select("x", "flat", "same"))
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    drift_stream(stream, base, "ts", ["x", "flat", "same"], f"{root}/out", f"{root}/cp").awaitTermination()
    judge_open(spark, base, f"{root}/out", f"{root}/cp")
    got = {(r["window_start"].day, r["column"]): r["severity"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {(d, n): "HIGH" if (n == "x" and d > 3) or (n == "flat" and d > 5) else "LOW" for d in range(1, 7) for n in ("x", "flat", "same")}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(600), "a": rng.normal(size=600), "b": rng.normal(size=600), "c": rng.normal(size=600)})
    pdf["y"] = 3 * pdf.a + pdf.b
    pdf.loc[:4, ["a", "b", "c"]] = 12.0
    return spark.createDataFrame(pdf)


def test_anomaly_share_and_hits(planted):
    t = flag_anomalies(planted.drop("y"), ["id"], trees=25)
    flagged = {r["id"] for r in t.where("is_anomaly").collect()}
    assert len(flagged) == 30 and set(range(5)) <= flagged


def test_anomalies_query_returns_the_flagged_share(spark):
    from queryset.modelling import REG

    sf = "/root/testdata/sf0.01"
    t = REG.queries["anomalies_lineitem_whole"](spark, sf)
    assert t.columns == ["anomaly_count", "rows", "anomaly_percent", "severity"]
    r, n = t.first(), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    share = AN.contamination(n, "fixed")
    # rows above the exact quantile: at most the share, less only by the rows that tie with it
    assert r["rows"] == n and 0.9 * share * n <= r["anomaly_count"] <= share * n + 1
    assert r["anomaly_percent"] == pytest.approx(r["anomaly_count"] * 100 / n, abs=0.006)
    assert r["severity"] == ("LOW" if r["anomaly_percent"] < 3 else "MODERATE" if r["anomaly_percent"] < 8 else "HIGH")


def test_anomalies_keep_rows_of_repeated_keys(planted):
    t = planted.drop("y").withColumn("id", F.col("id") % 7)
    flagged = flag_anomalies(t, ["id"], trees=10)
    assert flagged.count() == 600 and flagged.where("score is null").count() == 0
    assert AN.most_anomalous(flagged).count() == 10 and AN.top_features(flagged, 2).count() == 2


def test_scores_of_a_table_that_claims_to_be_huge(planted):
    f = Facts(planted.drop("y"))
    f.scan()
    f._rows = 40_000
    scores = AN.isolation_scores(f, ["id"], trees=5)
    assert scores.where("score is null").count() == 0
    f = Facts(planted.drop("y"))
    f.scan()
    f._rows = 10**13
    with pytest.raises(RuntimeError):  # no row is picked: said aloud, not scored as null
        AN.isolation_scores(f, ["id"], trees=5)


def test_full_trees_score_as_a_walk_down_the_nodes():
    rng = np.random.default_rng(2)
    for rows in (1, 2, 40):
        nodes = AN._grow(3, 5)(pd.DataFrame(rng.normal(size=(rows, 3)).round(1), columns=["f0", "f1", "f2"]).assign(tree=0))
        feature, cut, length, levels = AN._full_tree(nodes)
        by = {r.node: r for r in nodes.itertuples()}
        for row in [*rng.normal(size=(60, 3)).round(1), np.array([np.inf, -np.inf, 0.0])]:
            node = depth = at = 0
            while by[node].feature >= 0:
                node, depth = 2 * node + 1 + int(row[by[node].feature] >= by[node].cut), depth + 1
            for _ in range(levels):
                at = 2 * at + 1 + int(row[feature[at]] >= cut[at])
            assert length[at] == depth + AN._average_path(by[node].size)


def test_column_of_another_kind_is_a_mismatch(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string"), spark.createDataFrame([("k", "x"), ("l", "x")], "n string, t string")
    rows = {r["column"]: r for r in D.drift_columns(a, b).collect()}
    assert rows["n"]["dtype"] == "mismatch" and rows["n"]["drift_severity"] == "SIGNIFICANT_DRIFT" and len(rows) == 2
    assert D.drift_report(a, b).first()["overall_risk"] == "HIGH"


@pytest.mark.parametrize("n", [12, 3000])
def test_baseline_of_any_size_raises_no_alarm(spark, n):
    rng = np.random.default_rng(8)
    high = 0
    for i in range(3):
        base = D.Baseline.of(spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=n)})))
        high += D.drift_vs_baseline(base, spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=2000)}))).first()["severity"] == "HIGH"
    assert high == 0


def test_equal_large_tables_stay_low(spark):
    """12 million rows a side: the grid alone is 0.0008 away from them, beyond the critical value."""
    rows = spark.range(12_000_000).select((F.col("id") % 5000).cast("double").alias("x"))
    path = f"{shared_folder(spark)}/b-{uuid.uuid4().hex}"
    D.Baseline.of(rows).save(path)
    base = D.Baseline.load(spark, path)
    assert base.counts.count() == 5000 and base.counts.agg(F.sum("n")).first()[0] == 12_000_000
    same = D.drift_vs_baseline(base, rows).first()
    assert (same["p_value"], same["severity"], same["overall"]) == (1.0, "LOW", "LOW")
    assert same["value"] * (12_000_000 / 2) ** 0.5 > 1.63
    moved = D.drift_vs_baseline(base, rows.select((F.col("x") + 10).alias("x"))).first()
    assert moved["severity"] == "HIGH"


def test_model_queries_run_the_whole_operator(monkeypatch):
    """No registered model query hands its operator fewer trees, folds, rounds or units than the default."""
    from queryset import modelling

    seen = {}
    for name in ("train_compare", "overfit", "learning_curve", "importance", "consensus_select", "search", "ensembles", "fix_impact", "apply_fixes", "clean_gain", "mlp", "attribution"):
        class Result:
            drop = summary = lambda self, *_: self
        monkeypatch.setattr(TR, name, lambda *a, _n=name, **k: seen.setdefault(_n, []).append(k) or Result())
    monkeypatch.setattr(modelling, "read", lambda *_: None)
    for query in (
        "train_compare_documents", "train_compare_part", "overfit_documents", "learning_curve_documents", "importance_documents", "consensus_select_documents", "search_documents",
        "ensembles_documents", "ensembles_part", "fix_impact_orders", "apply_fixes_documents", "clean_gain_part", "mlp_documents", "attribution_documents",
    ):
        modelling.REG.queries[query](None, "")
    smaller = {"trees", "folds", "hidden", "iterations", "permutations"}
    assert len(seen) == 12 and not [(n, k) for n, calls in seen.items() for k in calls if smaller & set(k)]


def test_folds_and_split_partition_the_table(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 3)
    f = SC.folds(df, ["id"], 5, "y").groupBy("y", "fold").count().toPandas()
    assert f["count"].max() - f["count"].min() <= 1 and f["count"].sum() == 1000
    assert SC.split(df, ["id"], "y", 0.2).where("is_test").count() == sum(-(-n // 5) for n in (334, 333, 333))


def test_importance_finds_the_signal(planted):
    t = {r["feature"]: r for r in TR.importance(planted.where("id > 4"), "y", ["id"], repeats=2, trees=8).collect()}
    assert t["a"]["permutation"] > t["c"]["permutation"] and t["a"]["tier"] == "HIGH"
