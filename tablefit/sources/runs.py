"""Run log: one appended row per run, history, comparison of two runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("logged_at", T.TimestampType()), T.StructField("table_name", T.StringType()),
    T.StructField("task_type", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("best_model", T.StringType()),
    T.StructField("best_score", T.DoubleType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])


def log_run(spark, path: str, table_name: str, task_type: str, features: list[str], best_model: str, best_score: float, metrics: dict, params: dict | None = None) -> str:
    """Append one run; the id is random, so runs of the same second stay apart."""
    from datetime import datetime, timezone

    run_id = uuid.uuid4().hex
    row = (run_id, datetime.now(timezone.utc), table_name, task_type, list(features), best_model, float(best_score), {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in (params or {}).items()})
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def runs(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def compare_runs(spark, path: str, first: str, second: str) -> DataFrame:
    """Both runs side by side; score_diff is the second minus the first. Empty when one is unknown."""
    side = lambda run, i: runs(spark, path).where(F.col("run_id") == run).select(
        F.col("table_name").alias(f"table_{i}"), F.col("best_model").alias(f"model_{i}"), F.col("best_score").alias(f"score_{i}"), F.lit(1).alias("k"))
    both = side(first, 1).join(side(second, 2), "k").drop("k")
    return both.withColumn("score_diff", F.col("score_2") - F.col("score_1"))
