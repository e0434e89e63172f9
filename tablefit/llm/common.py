"""Shared helpers of the subpackage: text identity, hold-out remainders, buckets, hot-safe row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tablefit.sources.tables import settle

#: a word is a run of characters other than space, \\t, \\n, \\v, \\f, \\r
WORD = r"[^\x20\x09-\x0D]+"


def need(df: DataFrame, *cols: str) -> None:
    """Refuse a table without the columns an operator reads."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def text_of(df: DataFrame, text: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text; computed alike wherever the text is read again."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text, F.length(text))


def fields(kept, made: str) -> T.StructType:
    """Schema of the columns ``kept`` (of any name and type) and those of the DDL text ``made``."""
    return T.StructType([*kept, *T.StructType.fromDDL(made).fields])


def spread(df: DataFrame) -> int:
    """Partitions that the session uses for a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_buckets(df: DataFrame, key: Column, count: int, rows: int, name: str = "bucket") -> DataFrame:
    """Add the number of the key's range among ``count`` ranges of about equal row counts.

    Range ends come from a sample of about 40 keys per range; they only steer the load, so the
    result does not depend on them. ``key`` may be a struct, to cut through a frequent first part.
    """
    if count <= 1 or rows == 0:
        return df.withColumn(name, F.lit(0))
    share = min(1.0, 40.0 * count / rows)
    seen = sorted((r["k"] for r in df.select(key.alias("k")).sample(share, seed=7).limit(80 * count).collect()), key=_order)
    ends = [seen[i * len(seen) // count] for i in range(1, count)] if seen else []
    if not ends:
        return df.withColumn(name, F.lit(0))
    kind = df.select(key.alias("k")).schema["k"].dataType
    table = df.sparkSession.createDataFrame([(ends,)], T.StructType([T.StructField("__ends", T.ArrayType(kind))]))
    placed = df.withColumn("__key", key).crossJoin(F.broadcast(table))  # one row of ends
    spot = F.size(F.filter("__ends", lambda e: e <= F.col("__key")))
    return placed.withColumn(name, spot).drop("__ends", "__key")


def _order(k):
    return tuple((x is not None, x if x is not None else 0) for x in (k if isinstance(k, tuple) else (k,)))


def numbered(df: DataFrame, group: list[str], cell: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Row numbers from 0 within ``group``, in the order of the ``cell`` columns, then ``order``.

    Cells must be small enough for one task; only one row per cell is ever sorted for a whole group.
    Group and cell columns must not be null.
    """
    keys = [*group, *cell]
    sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    w = W.partitionBy(*group).orderBy(*cell)
    starts = sizes.select(
        *keys,
        F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
        *([F.sum("__n").over(W.partitionBy(*group)).alias(total)] if total else []),
    )
    inside = W.partitionBy(*keys).orderBy(*order)
    local = df.withColumn("__i", F.row_number().over(inside) - 1)
    return local.join(starts, keys).withColumn(name, F.col("__i") + F.col("__start")).drop("__i", "__start")


__all__ = ["WORD", "fields", "need", "numbered", "range_buckets", "remainder", "settle", "spread", "text_key", "text_of"]
