"""Row and value cleaning: duplicates, outliers, imputation, simple transforms, class balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.exprs import c
from tablefit.functions.ranks import hash_row_number
from tablefit.operators.facts import Facts, as_facts


def replace(df: DataFrame, new: dict) -> DataFrame:
    """Same columns in the same order, some of them replaced, as one projection."""
    return df.select(*[new[n].alias(n) if n in new else c(n) for n in df.columns])


def dedupe(df: DataFrame) -> DataFrame:
    """Rows without exact copies; copies are merged inside each task before the shuffle."""
    return df.dropDuplicates()


def drop_iqr_outliers(df, target: str | None = None, max_share: float = 0.15) -> DataFrame:
    """Remove rows beyond the fences of any numeric column with a spread, unless that would take
    ``max_share`` of the rows or more (then all rows stay)."""
    f = as_facts(df)
    quart = f.quantiles([0.25, 0.75])
    out = F.lit(False)
    for name in f.numeric:
        q = quart[name]
        if name == target or q[0.25] is None or q[0.75] == q[0.25]:
            continue
        iqr, v = q[0.75] - q[0.25], c(name).cast("double")
        out = out | F.coalesce((v < q[0.25] - 1.5 * iqr) | (v > q[0.75] + 1.5 * iqr), F.lit(False))
    hit = f.df.agg(F.count_if(out).alias("k")).first()["k"]
    return f.df.where(~out) if 0 < hit < max_share * f.rows else f.df


def row_outlier_score(df, key: list[str]) -> DataFrame:
    """Per row: number of columns outside their fences and the largest |z|."""
    f = as_facts(df)
    cols = [n for n in f.numeric if n not in key]
    fences, scan = f.fences(cols), f.scan()
    beyond, zs = F.lit(0), [F.lit(0.0)]
    for name in cols:
        if fences[name] is None:
            continue
        v, (lo, hi) = c(name).cast("double"), fences[name]
        beyond = beyond + F.when((v < lo) | (v > hi), 1).otherwise(0)
        zs.append(F.abs((v - scan[name]["mean"]) / ((scan[name]["std"] or 0.0) + 1e-9)))
    return f.df.select(*[c(k) for k in key], beyond.cast("bigint").alias("columns_outside"), F.greatest(*zs, F.lit(0.0)).alias("max_abs_z"))


def drop_correlated(df, threshold: float = 0.85, target: str | None = None) -> DataFrame:
    """Drop the later column of every numeric pair with |r| above the threshold."""
    f = as_facts(df)
    cols = [n for n in f.numeric if n != target]
    late = {b for (a, b), r in f.corr(cols).items() if r is not None and abs(r) > threshold}
    return f.df.select(*[c(n) for n in f.columns if n not in late])


# ---- imputation --------------------------------------------------------------------------------

def fill_values(f: Facts, how: dict[str, str]) -> dict[str, object]:
    """The constant of each column: mean, median, mode or a given constant."""
    medians = [n for n, h in how.items() if h == "median"]
    quant = f.quantiles([0.5], medians) if medians else {}
    modes = [n for n, h in how.items() if h == "mode"]
    top = f.top(modes, 1) if modes else {}
    out = {}
    for name, h in how.items():
        if h == "mean":
            out[name] = f.scan()[name]["mean"]
        elif h == "median":
            out[name] = quant[name][0.5]
        elif h == "mode":
            out[name] = top[name][0][0] if top[name] else "Unknown"
        else:
            out[name] = "Unknown"
    return out


def fill_column(f_types: dict[str, str], kinds: dict[str, str], name: str, value):
    if value is None:
        return c(name)
    if kinds[name] == "numeric":
        return F.coalesce(c(name).cast("double"), F.lit(float(value)))
    return F.coalesce(c(name), F.lit(value).cast(f_types[name]))


def auto_methods(f: Facts, target: str | None, rules: str = "auto") -> dict[str, str]:
    """How to fill each incomplete column: by skew (``auto``) or always median (``median``)."""
    how = {}
    for name in f.columns:
        m = f.scan()[name]
        if name == target or m["missing"] == 0:
            continue
        if f.kinds[name] == "numeric":
            how[name] = "median" if rules == "median" or abs(m["skew"] or 0.0) > 1 else "mean"
        else:
            how[name] = "mode"
    return how


def impute_auto(df, target: str | None = None, rules: str = "auto") -> DataFrame:
    """Fill numbers by mean (median when |skew| > 1) and other columns by their mode (smallest on
    ties; ``Unknown`` without values). Complete columns keep their type."""
    f = as_facts(df)
    return impute(f, auto_methods(f, target, rules))


def impute(df, how: dict[str, str]) -> DataFrame:
    """Fill by an explicit plan column -> mean, median, mode, constant or drop."""
    f = as_facts(df)
    values = fill_values(f, {n: h for n, h in how.items() if h != "drop"})
    kept = [n for n in f.columns if how.get(n) != "drop"]
    return replace(f.df.select(*[c(n) for n in kept]), {n: fill_column(f.types, f.kinds, n, v) for n, v in values.items()})


def missing_flag(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add a 0/1 column per given column that says where it was missing."""
    return df.select("*", *[c(n).isNull().cast("int").alias(f"{n}_missing") for n in cols])


# ---- transforms --------------------------------------------------------------------------------

def skewed_columns(f: Facts, target: str | None, limit: float = 2.0) -> list[str]:
    scan = f.scan()
    return [n for n in f.numeric if n != target and abs(scan[n]["skew"] or 0.0) > limit and scan[n]["min"] is not None and scan[n]["min"] >= 0]


def log_transform(df, target: str | None = None, limit: float = 2.0) -> DataFrame:
    """log1p of strongly skewed non-negative columns."""
    f = as_facts(df)
    return replace(f.df, {n: F.log1p(c(n).cast("double")) for n in skewed_columns(f, target, limit)})


def transform(df, how: dict[str, str]) -> DataFrame:
    """Apply log1p, sqrt or reflect_log1p (log of 1 + max - x) per column; the first two only
    where no value is negative."""
    f = as_facts(df)
    scan, new = f.scan(), {}
    for name, h in how.items():
        v, low = c(name).cast("double"), scan[name]["min"]
        if h == "log1p" and low is not None and low >= 0:
            new[name] = F.log1p(v)
        elif h == "sqrt" and low is not None and low >= 0:
            new[name] = F.sqrt(v)
        elif h == "reflect_log1p":
            new[name] = F.log1p(F.lit(scan[name]["max"]) - v)
    return replace(f.df, new)


def winsorize(df, low: float = 0.01, high: float = 0.99, target: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """Cap numeric columns at two exact quantiles."""
    f = as_facts(df)
    cols = [n for n in (cols or f.numeric) if n != target]
    q = f.quantiles([low, high], cols)
    new = {}
    for n in cols:
        if q[n][low] is not None:
            v = c(n).cast("double")
            new[n] = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(q[n][low])), F.lit(q[n][high])))
    return replace(f.df, new)


def oversample(df: DataFrame, target: str, key: list[str]) -> DataFrame:
    """Bring every class to the size of the largest: each row is repeated largest // size times
    and the first largest % size rows in md5 order of the key once more. Needs a unique key."""
    present = df.where(c(target).isNotNull())
    largest = present.groupBy(c(target)).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    numbered = hash_row_number(present, [target], key, "__rn")
    copies = F.floor(F.lit(largest) / F.col("__rn_of")) + F.when(F.col("__rn") <= F.lit(largest) % F.col("__rn_of"), 1).otherwise(0)
    return numbered.select(*[c(n) for n in df.columns], F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("__copy")).drop("__copy")
