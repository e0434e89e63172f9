"""k-means on standardised numeric columns: choice of k, report, stability."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, rounded
from tablefit.operators.encode import scale_standard
from tablefit.operators.facts import Facts, as_facts, small_table
from tablefit.sources.tables import settle


def _vectors(f: Facts, skip: list[str]) -> tuple[DataFrame, list[str]]:
    cols = [n for n in f.numeric if n not in skip]
    if len(cols) < 2:
        raise ValueError("needs at least two numeric columns")
    scaled = settle(scale_standard(Facts(f.df.select(*[c(n) for n in cols]).dropna())))
    slots = [f"f{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=slots, outputCol="features").transform(scaled.toDF(*slots)), cols


def cluster(df, skip: list[str] | None = None, max_k: int = 6) -> DataFrame:
    """Silhouette (squared Euclidean) for k = 2 .. max_k - 1; the best is marked."""
    f = as_facts(df)
    data, _ = _vectors(f, skip or [])
    rows = []
    for k in range(2, min(max_k, f.rows)):
        rows.append((k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=42).fit(data).transform(data)))))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    t = small_table(f.spark, [(k, s, k == best) for k, s in rows], [("k", "bigint"), ("silhouette", "double"), ("is_best", "boolean")])
    return t.withColumn("silhouette", rounded(F.col("silhouette"), 3))


def cluster_report(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Given labels: share per cluster, mean distance to the centroid and Davies-Bouldin index of
    the clustering (on every row). Only one row per cluster reaches the driver."""
    centres = df.groupBy(c(label).alias("__l")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c(n).cast("double")).alias(f"m{i}") for i, n in enumerate(cols)])
    joined = df.join(F.broadcast(centres), c(label) == F.col("__l"))  # one row per cluster
    dist = F.sqrt(sum(((c(n).cast("double") - F.col(f"m{i}")) ** 2 for i, n in enumerate(cols)), F.lit(0.0)))
    spread = {r["__l"]: r["d"] for r in joined.groupBy("__l").agg(F.avg(dist).alias("d")).collect()}
    rows = centres.collect()
    total = sum(r["n"] for r in rows)
    gap = lambda a, b: math.sqrt(sum((a[f"m{i}"] - b[f"m{i}"]) ** 2 for i in range(len(cols))))
    worst = [max((spread[a["__l"]] + spread[b["__l"]]) / gap(a, b) for b in rows if b is not a and gap(a, b) > 0) for a in rows]
    index = sum(worst) / len(worst)
    t = small_table(df.sparkSession, [(str(r["__l"]), r["n"], r["n"] / total * 100, spread[r["__l"]], index) for r in rows], [
        ("cluster", "string"), ("rows", "bigint"), ("percent", "double"), ("mean_distance", "double"), ("davies_bouldin", "double")])
    return t.select("cluster", "rows", rounded(F.col("percent"), 2).alias("percent"), rounded(F.col("mean_distance")).alias("mean_distance"), rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


def centroid_spread(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Influence of each column: deviation of the cluster means, as a share of the total."""
    centres = df.groupBy(c(label)).agg(*[F.avg(c(n).cast("double")).alias(f"m{i}") for i, n in enumerate(cols)])
    row = centres.agg(*[F.stddev_pop(f"m{i}").alias(f"s{i}") for i in range(len(cols))]).first()
    total = sum(row[f"s{i}"] for i in range(len(cols))) or 1.0
    t = small_table(df.sparkSession, [(n, row[f"s{i}"] / total) for i, n in enumerate(cols)], [("column", "string"), ("influence", "double")])
    return t.select("column", rounded(F.col("influence")).alias("influence"))


def cluster_stability(df, k: int, skip: list[str] | None = None, rounds: int = 5) -> DataFrame:
    """Mean silhouette of refits on bootstrap samples."""
    f = as_facts(df)
    data, _ = _vectors(f, skip or [])
    rows = []
    for i in range(rounds):
        part = settle(data.select("features").sample(True, 1.0, 100 + i))
        rows.append((i, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=i).fit(part).transform(part)))))
    t = small_table(f.spark, rows, [("round", "bigint"), ("silhouette", "double")])
    return t.agg(F.count(F.lit(1)).alias("rounds"), rounded(F.avg("silhouette"), 3).alias("stability"))
