"""The baseline check as a stream: one verdict per event-time window.

Categories are judged by PSI, numbers by the two-sample KS test, as a batch is against the same
baseline. The state keeps counts, never rows: one number per category, or per cell of a numeric column.
Cells are cut at the baseline's 1001 quantiles; each quantile is a cell of its own, between two of them
lies another. Both distributions are known exactly before and after every cell, so the statistic is
never above that of all rows, and below it by at most the baseline's share of one cell between two
quantiles, which is no more than 1/1000 (plus one row).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from tablefit.functions.exprs import c
from tablefit.functions.pvalues import ks_2samp_sf
from tablefit.operators.drift import Baseline
from tablefit.sources.tables import settle

FLOOR = 1e-4
STEP = 32  # quantiles that one step of the search for a cell jumps over
OPEN = -1  # folder of the windows that the last run left open


def cell_edges(base: Baseline) -> dict[str, list[float]]:
    """Distinct exact quantiles of each numeric column of the baseline, at most 1001."""
    out: dict[str, list[float]] = {}
    for r in base.grid.select("column", "v").distinct().orderBy("column", "v").collect():
        out.setdefault(r["column"], []).append(r["v"])
    return out


def _cell(v, edges: list[float]):
    """Number of the cell of a number: 2k + 1 for edge k itself, 2k for what lies below it and above edge
    k - 1. The edges are searched in two steps, so a row meets about 2 * STEP of them."""
    parts = [edges[i:i + STEP] for i in range(0, len(edges), STEP)]
    heads = F.array(*[F.lit(float(p[0])) for p in parts])
    tables = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in parts])
    part = F.greatest(F.size(F.filter(heads, lambda x: x <= v)) - 1, F.lit(0))
    own = tables[part]
    return (part * (2 * STEP) + F.size(F.filter(own, lambda x: x < v)) + F.size(F.filter(own, lambda x: x <= v))).cast("string")


def expected_shares(base: Baseline) -> DataFrame:
    """(column, value, then, rows): the baseline's share of every category, and of every cell with the
    number of rows behind it (null for categories)."""
    out = base.categories.select("column", "value", F.col("share").alias("then"), F.lit(None).cast("bigint").alias("rows"))
    edges = cell_edges(base)
    if not edges:
        return out
    spots = F.coalesce(*[F.when(F.col("column") == n, _cell(F.col("v"), e)) for n, e in edges.items()])
    cells = base.counts.groupBy("column", spots.alias("value")).agg(F.sum("n").alias("n"))
    total = cells.groupBy("column").agg(F.sum("n").alias("t"))
    return out.unionByName(cells.join(F.broadcast(total), "column").select("column", "value", (F.col("n") / F.col("t")).alias("then"), F.col("t").alias("rows")))


def window_counts(stream: DataFrame, time_col: str, cols: list[str], window: str, delay: str, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Counts of every category, or cell of a numeric column with ``edges``, per window, with late data
    cut off by the watermark. The state holds one number per (window, column, value), not rows."""
    values = {}
    for n in cols:
        if n not in (edges or {}):
            values[n] = c(n).cast("string")
        elif isinstance(stream.schema[n].dataType, NumericType):
            v = c(n).cast("double")
            values[n] = F.when(~F.isnan(v), _cell(v, edges[n]))
        else:
            raise ValueError(f"column {n} is numeric in the baseline only")
    entries = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("column"), v.alias("value"))) for n, v in values.items()]
    timed = stream.withColumn("__ts", c(time_col).cast("timestamp")).withWatermark("__ts", delay)
    # plain names for the keys, so that they can be told apart in the stored state
    rows = timed.select("__ts", F.explode(F.array(*entries)).alias("e")).where("e is not null").select("__ts", "e.*")
    return rows.groupBy(F.window("__ts", window).alias("w"), "column", "value").agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(DoubleType())
def _ks_p(stat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_2samp_sf(d, a, b) for d, a, b in zip(stat, n, m)], dtype="float64")


def verdicts(counts: DataFrame, base: Baseline, expected: DataFrame | None = None) -> DataFrame:
    """One row per (window, column) of ``counts``: PSI of categories (above .2 HIGH, .1 MEDIUM), or KS and its
    p-value of a numeric column (below .01 HIGH, .05 MEDIUM). ``expected`` holds ``expected_shares`` where
    they have been settled."""
    keys = ["w", "column"]
    expected = expected_shares(base) if expected is None else expected
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"))
    now = counts.join(total, keys).select(*keys, "value", (F.col("n") / F.col("t")).alias("now"))
    # every category and cell of the baseline must show up in every window, also with count 0
    wanted = total.select(*keys).join(expected.select("column", "value", "then"), "column")
    both = now.join(wanted, [*keys, "value"], "full_outer")
    sizes = expected.groupBy("column").agg(F.max("rows").alias("rows"))  # one row per column
    both = both.join(F.broadcast(sizes), "column")
    e, o = F.greatest(F.coalesce("then", F.lit(FLOOR)), F.lit(FLOOR)), F.greatest(F.coalesce("now", F.lit(FLOOR)), F.lit(FLOOR))
    psi = both.where("rows is null").groupBy(*keys).agg(F.sum((o - e) * F.log(o / e)).alias("psi"))
    upto = W.partitionBy(*keys).orderBy(F.col("value").cast("int"))  # about 2,000 cells
    gap = F.abs(F.sum(F.coalesce("now", F.lit(0.0))).over(upto) - F.sum(F.coalesce("then", F.lit(0.0))).over(upto))
    ks = both.where("rows is not null").select(*keys, "rows", gap.alias("gap")).groupBy(*keys, "rows").agg(F.max("gap").alias("ks"))
    ks = ks.join(total, keys).withColumn("p", _ks_p("ks", "t", "rows"))
    head = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "column"]
    none = F.lit(None).cast("double")
    return psi.select(
        *head, F.round("psi", 4).alias("psi"), none.alias("ks"), none.alias("p_value"),
        F.when(F.col("psi") > 0.2, "HIGH").when(F.col("psi") > 0.1, "MEDIUM").otherwise("LOW").alias("severity"),
    ).unionByName(ks.select(
        *head, none.alias("psi"), F.round("ks", 4).alias("ks"), F.round("p", 4).alias("p_value"),
        F.when(F.col("p") < 0.01, "HIGH").when(F.col("p") < 0.05, "MEDIUM").otherwise("LOW").alias("severity"),
    ))


def drift_stream(stream: DataFrame, base: Baseline, time_col: str, cols: list[str], out: str, checkpoint: str, window: str = "1 day", delay: str = "1 day"):
    """Start the stream: windows are emitted once they are closed by the watermark, judged in
    foreachBatch and appended under ``out`` (one folder per batch id, so a replayed batch
    overwrites itself). ``judge_open`` adds the windows that a bounded run leaves open."""
    counts = window_counts(stream, time_col, cols, window, delay, cell_edges(base))
    expected = settle(expected_shares(base))  # read by every micro-batch

    def judge(batch: DataFrame, batch_id: int) -> None:
        verdicts(batch, base, expected).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(judge).start()


def judge_open(spark: SparkSession, base: Baseline, out: str, checkpoint: str) -> None:
    """Judge the windows still open after a run has ended, from its stored state.

    They replace those of the run before: a window closed since then is no longer in the state and
    has its final verdict in the folder of its batch, so no window is ever there twice.
    """
    state = spark.read.format("statestore").load(checkpoint)
    keys = {n if n in ("column", "value") else "w": F.col("key").getField(n) for n in state.schema["key"].dataType.names}
    count = F.col("value").getField(state.schema["value"].dataType.names[0])
    counts = state.select(*[k.alias(n) for n, k in keys.items()], count.alias("n"))
    verdicts(counts, base).write.mode("overwrite").parquet(f"{out}/batch={OPEN}")
