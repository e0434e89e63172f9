"""Encoders and scalers. Codes of small value sets become CASE expressions; large value sets are
joined from a lookup table (broadcast only when small, hot values split off otherwise)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c
from tablefit.functions.ranks import attach_values, when_map
from tablefit.operators.clean import replace
from tablefit.operators.facts import as_facts
from tablefit.sources.tables import settle

MOST_COLUMNS = 1000   # one-hot columns made of one column
LITERAL_VALUES = 64   # value sets up to this size are written into the plan as literals
SORT_IN_ONE = 100_000  # distinct values one task may number


def as_text(name: str, null_text: str | None = None):
    """Value as text; ``null_text`` makes nulls a category of their own."""
    text = c(name).cast("string")
    return F.coalesce(text, F.lit(null_text)) if null_text is not None else text


def counted(df: DataFrame, text) -> DataFrame:
    """(value, cnt) of one column."""
    return df.select(text.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))


def value_codes(values: DataFrame) -> DataFrame:
    """Add ``code``: position of the value in sorted order, from 0. Large sets are cut into ranges
    at a small hash-picked set of edges, numbered inside each range and shifted by range sizes."""
    if values.limit(SORT_IN_ONE + 1).count() <= SORT_IN_ONE:
        return values.withColumn("code", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("value")) - 1)
    edges = sorted(r["value"] for r in values.orderBy(F.md5("value")).limit(255).collect())
    placed = values.withColumn("__b", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("value"))))
    sums = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("k"))
    before = W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # at most 256 rows
    offsets = sums.select("__b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__o"))
    local = placed.withColumn("__n", F.row_number().over(W.partitionBy("__b").orderBy("value")) - 1)
    return local.join(F.broadcast(offsets), "__b").withColumn("code", F.col("__n") + F.col("__o")).select("value", "cnt", "code")


def apply_lookup(df: DataFrame, name: str, text, lookup: DataFrame, default, rows: int | None = None, stored: bool = False) -> DataFrame:
    """Replace a column by ``code`` of a (value, cnt, code) lookup; unseen values get the default.

    A few values become a CASE expression. A larger lookup is settled, because its size, its row count and
    its join would each count the values again; ``stored`` says that it already is. The join shuffles the
    column as text only."""
    small = lookup.limit(LITERAL_VALUES + 1).collect()
    if len(small) <= LITERAL_VALUES:
        table = {r["value"]: r["code"] for r in small}
        return replace(df, {name: when_map(text, table, default)})
    lookup = settle(lookup.select("value", "cnt", "code")) if not stored else lookup
    rows = rows if rows is not None else lookup.agg(F.sum("cnt")).first()[0] or 0
    renamed = lookup.select(F.col("value").alias("__v"), "cnt", F.col("code").alias("__code"))
    slim = df.select(*[c(n) for n in df.columns if n != name], text.alias("__v"))
    joined = attach_values(slim, renamed, "__v", "cnt", rows)
    return joined.select(*[F.coalesce(F.col("__code"), F.lit(default)).alias(n) if n == name else c(n) for n in df.columns])


def encode_binary(df: DataFrame, name: str) -> DataFrame:
    """Two-valued column to 0/1 in sorted order of the trimmed text."""
    text = F.trim(as_text(name))
    high = df.agg(F.max(text)).first()[0]
    return replace(df, {name: F.when(text == F.lit(high), 1).otherwise(0)})


def categories(df: DataFrame, name: str, most: int = MOST_COLUMNS) -> list[str] | None:
    """Sorted categories, one column each; None where there are more than ``most``, which are not read."""
    seen = counted(df, as_text(name)).select("value").limit(most + 1).collect()
    return sorted(r["value"] for r in seen) if len(seen) <= most else None


def one_hot(df: DataFrame, cols: list[str], most: int = MOST_COLUMNS) -> DataFrame:
    """0/1 columns named col_value for all but the first sorted category; originals are dropped. A column
    with more than ``most`` categories gets their frequency share in place of columns."""
    extra, gone = [], []
    for name in cols:
        values = categories(df, name, most)
        if values is None:
            df = encode_freq(df, name)
        else:
            gone.append(name)
            extra += [F.coalesce((as_text(name) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in values[1:]]
    return df.select(*[c(n) for n in df.columns if n not in gone], *extra)


def encode_freq_rank(df: DataFrame, name: str) -> DataFrame:
    """Dense rank of the category frequency, most frequent first."""
    values = counted(df, as_text(name))
    # ranks depend on the distinct counts alone (at most the square root of twice the rows); only those are sorted
    sizes = values.select("cnt").distinct().withColumn("code", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("cnt").desc())))
    ranked = values.join(sizes, "cnt").select("value", "cnt", "code")
    return apply_lookup(df, name, as_text(name), ranked, 0)


def encode_freq(df: DataFrame, name: str) -> DataFrame:
    """Share of the category among the non-null rows."""
    values = counted(df, as_text(name))
    n = values.agg(F.sum("cnt")).first()[0] or 1
    return apply_lookup(df, name, as_text(name), values.withColumn("code", F.col("cnt") / F.lit(float(n))), 0.0, n)


def encode_label(df: DataFrame, name: str, null_text: str | None = "nan") -> DataFrame:
    """Index of the value among the sorted distinct texts (null counts as the text ``nan``)."""
    text = as_text(name, null_text)
    values = counted(df, text)
    many = df.agg(F.approx_count_distinct(text)).first()[0] > SORT_IN_ONE // 2
    if many:  # counting, cutting and numbering read the values again, and so do the lookup's size and join
        values = settle(values)
    codes = value_codes(values)
    return apply_lookup(df, name, text, settle(codes) if many else codes, None, stored=many)


def encode_target(df: DataFrame, name: str, target: str) -> DataFrame:
    """Mean of a numeric target per category; overall mean for unseen or missing categories."""
    text, y = as_text(name), c(target).cast("double")
    means = df.select(text.alias("value"), y.alias("y")).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"), F.avg("y").alias("code")).where("value is not null")
    return apply_lookup(df, name, text, means, df.agg(F.avg(y)).first()[0])


def encode_hash(df: DataFrame, name: str, buckets: int = 32) -> DataFrame:
    """Stable hash bucket of the value from its md5 (the same in any engine)."""
    spot = F.conv(F.substring(F.md5(as_text(name, "nan")), 1, 8), 16, 10).cast("bigint") % buckets
    return replace(df, {name: spot})


def ensure_numeric(df, target: str | None = None) -> DataFrame:
    """All-numeric table without nulls: booleans to int, left-over text one-hot (15 values or
    fewer) or frequency share, other types dropped, nulls to 0. A text target is label encoded."""
    f = as_facts(df)
    out = f.df
    if target in f.columns and f.kinds[target] == "string":
        out = encode_label(out, target)
    texts = [n for n in f.strings if n != target]
    distinct = f.distinct(texts) if texts else {}
    few = [n for n in texts if distinct[n] <= 15]
    for name in [n for n in texts if n not in few]:
        out = encode_freq(out, name)
    if few:
        out = one_hot(out, few)
    kinds = {n: f.kinds.get(n, "numeric") for n in out.columns}
    keep = [n for n in out.columns if kinds[n] != "datetime"]
    return out.select(*[F.coalesce(c(n).cast("int") if kinds[n] == "boolean" else c(n), F.lit(0)).alias(n) for n in keep])


# ---- scalers -----------------------------------------------------------------------------------

def scale_standard(df, cols: list[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    f = as_facts(df)
    new = {}
    for n in cols or f.numeric:
        m = f.scan()[n]
        if m["mean"] is not None:
            new[n] = (c(n).cast("double") - F.lit(m["mean"])) / F.lit(m["std_pop"] or 1.0)
    return replace(f.df, new)


def scale_minmax(df, cols: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    f = as_facts(df)
    new = {}
    for n in cols or f.numeric:
        m = f.scan()[n]
        if m["min"] is not None:
            new[n] = (c(n).cast("double") - F.lit(m["min"])) / F.lit((m["max"] - m["min"]) or 1.0)
    return replace(f.df, new)


def scale_robust(df, cols: list[str] | None = None) -> DataFrame:
    """(x - median) / IQR with exact quantiles; a zero IQR divides by 1."""
    f = as_facts(df)
    cols = cols or f.numeric
    q = f.quantiles([0.25, 0.5, 0.75], cols)
    new = {}
    for n in cols:
        if q[n][0.5] is not None:
            new[n] = (c(n).cast("double") - F.lit(q[n][0.5])) / F.lit((q[n][0.75] - q[n][0.25]) or 1.0)
    return replace(f.df, new)
