"""Sharding by jump consistent hashing: no ring table, and one more shard only takes rows into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import need, numbered, text_of
from tablefit.llm.flat import mix

CELL_ROWS = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key. A key moves to shard j only when j is the newest shard.

    All keys jump together; a key takes about ln(shards) jumps.
    """
    state = mix(keys.astype(np.uint64))
    at = np.full(len(keys), -1, np.int64)
    to = np.zeros(len(keys), np.int64)
    on = to < shards
    while on.any():
        at = np.where(on, to, at)
        state = np.where(on, state * np.uint64(2862933555777941757) + np.uint64(1), state)
        step = float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0)
        to = np.where(on, ((at + 1) * step).astype(np.int64), to)
        on = on & (to < shards)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard (0 to shards-1) of a 64-bit integer key; a null key goes to the shard of key 0."""
    if shards < 1:
        raise ValueError("need at least one shard")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards), dtype="int32")

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in each shard.

    Any integer key; its value and the number of shards decide alone, so repeated keys share a
    shard and every rerun agrees. Slots follow a hash of the key (ties: the whole row). A shard is
    numbered in cells of about CELL_ROWS rows, so no task holds a shard. Empty tables stay empty.
    """
    need(df, key)
    rows = df.count()
    cells = max(1, rows // (shards * CELL_ROWS))
    k = F.coalesce(F.col(key).cast("long"), F.lit(0))
    out = df.withColumns({"shard": shard_of(k, shards), "grown_shard": shard_of(k, shards + 1)})
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    # a key with very many rows is spread over cells by the rest of the row
    out = out.withColumns({"__row": whole, "__cell": F.pmod(F.xxhash64(k, whole), F.lit(cells))})
    out = numbered(out, ["shard"], ["__cell"], [F.xxhash64(k), F.col("__row")], "slot")
    return out.drop("__row", "__cell")


def write_shards(df: DataFrame, key: str, shards: int, path: str, cuts: int = 1) -> None:
    """Write one folder per shard; each shard is written by up to ``cuts`` tasks."""
    placed = df.withColumn("shard", shard_of(F.col(key), shards))
    placed.repartition(shards * cuts, "shard", F.pmod(F.xxhash64(*df.columns), F.lit(cuts))).write.partitionBy("shard").parquet(path)


def sharded_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Digest of the placement of ``docs`` (doc_id, text): the contract of op3.

    size is the UTF-8 length (null: none) plus 8; the CRC of a null text is that of no bytes.
    """
    need(docs, "doc_id", "text")
    text = text_of(docs)
    slim = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(slim, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
