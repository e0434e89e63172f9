"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs, and what sets the flagged rows apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, hash_key, rounded
from tablefit.functions.ranks import exact_quantiles
from tablefit.operators.facts import Facts, as_facts, small_table
from tablefit.sources.tables import settle

NODES = "tree int, node int, feature int, cut double, size int"


def _grow(cols: int, seed: int):
    """Build one tree from its (bounded) sample: random feature, random cut, until rows are alone
    or the depth limit is reached. Children of node k are 2k+1 and 2k+2."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = pdf[[f"f{i}" for i in range(cols)]].to_numpy()
        limit = max(1, int(np.ceil(np.log2(max(len(x), 2)))))
        out, todo = [], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(cols), np.zeros(cols))
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_):
                out.append((tree, node, -1, 0.0, len(rows)))
                continue
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            out.append((tree, node, f, cut, len(rows)))
            left = part[:, f] < cut
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])
    return build


def _average_path(n):
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _full_tree(t: pd.DataFrame):
    """(feature, cut, path length, levels) of one tree as a complete one: what ends early is carried down
    to the last level, so that all rows of a batch walk equally many levels and none is looked up apart."""
    levels = int(t["node"].max() + 1).bit_length() - 1
    top = 2 ** (levels + 1) - 1
    feature, cut, length = np.zeros(top, dtype=np.int64), np.full(top, np.inf), np.full(top, np.nan)
    for node, f, at, size in zip(t["node"], t["feature"], t["cut"], t["size"]):
        if f >= 0:
            feature[node], cut[node] = f, at
        else:
            length[node] = int(node + 1).bit_length() - 1 + _average_path(size)
    for node in range(top // 2):
        if not np.isnan(length[node]):
            length[2 * node + 1] = length[2 * node + 2] = length[node]
    return feature, cut, length, levels


def isolation_scores(df, key: list[str], target: str | None = None, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """The table with ``score`` in (0, 1); larger is more anomalous. Rows are scored in place, so keys
    need not be unique; the key only picks the samples.

    Trees are grown in parallel from at most ``sample`` hash-picked rows each (the algorithm's own
    subsample); the grown nodes (trees x 2 x sample at most) go to every task and all rows are scored."""
    f = as_facts(df)
    cols = [n for n in f.numeric if n != target and n not in key and f.scan()[n]["present"]]
    if len(cols) < 2 or f.rows < 20:
        raise ValueError("needs at least two numeric columns and 20 rows")
    medians = f.quantiles([0.5], cols)
    x = [F.coalesce(c(n).cast("double"), F.lit(medians[n][0.5])).alias(f"f{i}") for i, n in enumerate(cols)]
    data = f.df.select(hash_key(key).alias("h"), F.xxhash64(*[c(n) for n in f.columns]).alias("row"), *x)
    share = min(1.0, 4.0 * sample / f.rows)  # each tree first keeps about 4 samples' worth of rows
    spread = data.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))) if share == 1.0 else _presample(data, trees, share)
    order = W.partitionBy("tree").orderBy(F.md5(F.concat_ws("-", "h", F.col("tree").cast("string"))), "row")
    picked = spread.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample).drop("rn", "h", "row")
    nodes = picked.groupBy("tree").applyInPandas(_grow(len(cols), seed), NODES).toPandas()
    if nodes["tree"].nunique() < trees:
        raise RuntimeError(f"{trees - nodes['tree'].nunique()} of {trees} trees got no rows")
    size = int(min(sample, f.rows))
    packed = f.spark.sparkContext.broadcast([_full_tree(g) for _, g in nodes.groupby("tree")])

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        m = np.column_stack([v.to_numpy() for v in values])
        flat, first, total = m.ravel(), np.arange(len(m)) * m.shape[1], np.zeros(len(m))
        for feature, cut, length, levels in packed.value:
            at = np.zeros(len(m), dtype=np.int64)
            for _ in range(levels):
                right = flat.take(first + feature.take(at)) >= cut.take(at)
                at = 2 * at + 1 + right
            total += length.take(at)
        return pd.Series(2.0 ** (-(total / len(packed.value)) / float(_average_path(size))))

    return f.df.withColumn("score", score(*x))


def _presample(data: DataFrame, trees: int, share: float) -> DataFrame:
    """(tree, row) pairs whose 64-bit hash lies below a share of its range; nothing else is emitted."""
    ids = F.sequence(F.lit(0), F.lit(trees - 1))
    below = -(1 << 63) + int(share * (1 << 64))
    chosen = F.filter(ids, lambda t: F.xxhash64(F.col("h"), F.col("row"), t) < F.lit(below))
    return data.withColumn("tree", F.explode(chosen))


def contamination(rows: int, rules: str = "fixed") -> float:
    return 0.05 if rules == "fixed" else min(0.1, max(0.01, 10 / rows))


def flag_anomalies(df, key: list[str], target: str | None = None, rules: str = "fixed", trees: int = 100) -> DataFrame:
    """The table with ``score`` and ``is_anomaly``: rows above the exact score quantile."""
    f = as_facts(df)
    scored = settle(isolation_scores(f, key, target, trees))
    p = 1 - contamination(f.rows, rules)
    cut = exact_quantiles(scored.select("score"), ["score"], [p])["score"][p]
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(cut))


def anomalies(df, key: list[str], target: str | None = None, rules: str = "fixed", trees: int = 100) -> DataFrame:
    """Count, share and severity of the flagged rows (3/8 % or 5/15 %)."""
    return flag_summary(flag_anomalies(df, key, target, rules, trees), rules)


def flag_summary(flagged: DataFrame, rules: str = "fixed", flag: str = "is_anomaly") -> DataFrame:
    """Count, share and severity of the rows flagged by any rule or model; a null flag is none."""
    t = flagged.agg(F.count_if(c(flag)).alias("anomaly_count"), F.count(F.lit(1)).alias("rows"))
    pct = F.col("anomaly_count") / F.nullif(F.col("rows"), F.lit(0)) * 100
    band = F.when(pct < 3, "LOW").when(pct < 8, "MODERATE").otherwise("HIGH") if rules == "fixed" else F.when(pct > 15, "HIGH").when(pct > 5, "MODERATE").otherwise("LOW")
    return t.select("anomaly_count", "rows", rounded(pct, 2).alias("anomaly_percent"), band.alias("severity"))


def most_anomalous(flagged: DataFrame, n: int = 10) -> DataFrame:
    """The n rows with the highest scores (a top-n report)."""
    return flagged.orderBy(F.col("score").desc(), F.xxhash64(*[c(x) for x in flagged.columns])).limit(n)


def top_features(flagged: DataFrame, n: int = 3, target: str | None = None) -> DataFrame:
    """The n numeric columns in which flagged rows lie farthest from the rest."""
    skip = {"score", "is_anomaly", target}
    cols = [x for x in Facts(flagged.drop("is_anomaly")).numeric if x not in skip]
    return deviation(flagged.drop("score"), "is_anomaly", cols).orderBy(F.col("deviation").desc(), "column").limit(n)


def deviation(df: DataFrame, flag: str, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: |mean of flagged - mean of the rest| / (deviation of the rest + 1e-9)."""
    f = Facts(df.drop(flag))
    cols = cols or f.numeric
    x = lambda n, hit: F.when(c(flag) if hit else ~c(flag), c(n).cast("double"))
    row = df.agg(*[a for i, n in enumerate(cols) for a in (F.avg(x(n, True)).alias(f"a{i}"), F.avg(x(n, False)).alias(f"b{i}"), F.stddev_samp(x(n, False)).alias(f"s{i}"))]).first()
    rows = [(n, abs(row[f"a{i}"] - row[f"b{i}"]) / (row[f"s{i}"] + 1e-9)) for i, n in enumerate(cols) if row[f"a{i}"] is not None and row[f"s{i}"] is not None]
    t = small_table(f.spark, rows, [("column", "string"), ("deviation", "double")])
    return t.select("column", rounded(F.col("deviation"), 3).alias("deviation"))
