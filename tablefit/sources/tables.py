"""Readers, writers and the one place where intermediate tables are stored."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.functions.exprs import c, quoted
from tablefit.functions.names import NULL_TOKENS

SMALL_TABLE = 256 << 20  # bytes
_LOCAL_FOLDER: dict[str, str] = {}
NUMBER_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null in float columns; nested types are refused with one clear error."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise ValueError(f"nested or binary columns are not supported, expand or drop them first: {nested}")
    fixes = {
        f.name: F.nanvl(c(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.select(*[fixes[n].alias(n) if n in fixes else c(n) for n in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """Scan a table. Parquet, ORC and JSON keep their schema; anything else is read as CSV with
    a header, the usual null tokens and types inferred from the whole file in one aggregate."""
    fmt = fmt or next((e for e in ("parquet", "orc", "json") if path.rstrip("/").endswith("." + e)), "csv")
    if fmt != "csv":
        return normalise(spark.read.format(fmt).load(path))
    # one quote character inside a quoted field is written twice
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline)
    raw = raw.select(*[F.when(~c(n).isin(NULL_TOKENS), c(n)).alias(n) for n in raw.columns])
    return normalise(_typed(raw))


def _typed(raw: DataFrame) -> DataFrame:
    """Cast text columns to bigint, double, boolean or leave them, by what every value allows."""
    checks = []
    for i, name in enumerate(raw.columns):
        v = c(name)
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(r"^\s*[+-]?[0-9]+\s*$"), v.try_cast("bigint"))).alias(f"i{i}"),
            F.count(F.when(v.rlike(NUMBER_TEXT), v.try_cast("double"))).alias(f"d{i}"),
            F.count(F.when(F.lower(v).isin("true", "false"), v)).alias(f"b{i}"),
        ]
    seen = raw.agg(*checks).first()
    out = []
    for i, name in enumerate(raw.columns):
        n = seen[f"n{i}"]
        kind = next((t for t, k in (("bigint", "i"), ("double", "d"), ("boolean", "b")) if n and seen[f"{k}{i}"] == n), None)
        out.append((F.trim(c(name)).cast(kind) if kind else c(name)).alias(name))
    return raw.select(*out)


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """Refuse a table with fewer than n rows; reads at most n rows."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"need at least {n} rows, got {got}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a result; CSV gets a header and doubled quotes, one file per partition."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a local one in local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="tablefit-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDER[app], ignore_errors=True)
    return _LOCAL_FOLDER[app]


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table to the shared folder. Unlike a cached or checkpointed
    RDD the result is columnar (later passes still prune columns) and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    # names may hold characters parquet readers dislike, so columns are stored by position
    slots = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*slots).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select(*[c(s).alias(n) for s, n in zip(slots, df.columns)])


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small table over all cores and keep it: a file of one row group is one task
    otherwise, however many passes follow. Decided by the optimizer's size estimate, so a large
    table is never copied; what is kept is bounded by SMALL_TABLE."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_TABLE:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism).persist()


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def column_kinds(df: DataFrame) -> dict[str, str]:
    """numeric, string, boolean or datetime for every column."""
    kinds = {}
    for f in df.schema:
        t = f.dataType
        if isinstance(t, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(t, T.BooleanType):
            kinds[f.name] = "boolean"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "datetime"
        else:
            kinds[f.name] = "string"
    return kinds


def integral_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}


__all__ = [
    "NUMBER_TEXT", "categorical_cols", "column_kinds", "integral_cols", "normalise", "numeric_cols",
    "quoted", "read_table", "require_rows", "settle", "shared_folder", "spread_small", "write_table",
]
