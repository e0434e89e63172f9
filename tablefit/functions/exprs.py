"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Column name safe for dots, spaces and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def rounded(x: Column, digits: int = 4) -> Column:
    """Report rounding of the binary value (half away from zero after scaling, so 0.00015, which
    is stored slightly smaller, gives 0.0001); adding zero turns -0.0 into 0.0."""
    scale = float(10 ** digits)
    return F.round(x.cast("double") * scale, 0) / F.lit(scale) + F.lit(0.0)


def tidy(x: Column, digits: int = 4) -> Column:
    """Report clean-up: null, NaN and infinities become 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(rounded(x, digits))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pair_corr(a: Column, b: Column, complete: bool = False) -> Column:
    """Pearson r over rows where both sides are present; null for a constant side.

    ``complete`` says that neither side holds nulls, so the two deviations can be shared
    between pairs (Catalyst keeps one copy of equal aggregates).
    """
    x, y = a.cast("double"), b.cast("double")
    if not complete:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Bias-adjusted skewness from the population one; 0 for a constant column."""
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(g1, F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population one; 0 for a constant column."""
    n = n.cast("double")
    full = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.coalesce(full, F.lit(0.0)))


def entropy_term(p: Column, base: float = 2.0) -> Column:
    return -p * F.log(p) / F.lit(math.log(base))


def band(value: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """First label whose threshold is reached: steps are (threshold, label), highest first."""
    out = None
    for threshold, label in steps:
        hit = value > threshold if strict else value >= threshold
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def row_digest(df, cols: list[str] | None = None) -> list[Column]:
    """128-bit fingerprint of a whole row as two differently seeded 64-bit hashes, so duplicate
    search shuffles 16 bytes per row instead of the row. A null mask goes in first because the
    hash function skips nulls."""
    cols = cols or df.columns
    masks = []
    for start in range(0, len(cols), 60):
        mask = F.lit(0).cast("bigint")
        for i, name in enumerate(cols[start:start + 60]):
            mask = mask.bitwiseOR(F.when(c(name).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        masks.append(mask)
    values = [c(n) for n in cols]
    return [F.xxhash64(*masks, *values).alias("d1"), F.xxhash64(F.lit(7), *masks, *values).alias("d2")]


def long_numbers(df, cols: list[str]):
    """Numeric columns as rows (i, v): one group per column keeps the generated code the same
    size for 5 or 500 columns, where one wide aggregate falls off the JIT limit."""
    pairs = [x for i, n in enumerate(cols) for x in (F.lit(i), c(n).cast("double"))]
    return df.select(F.stack(F.lit(len(cols)), *pairs).alias("i", "v")).where("v is not null")


# fixed values: Hart's rational approximation of the normal tail, good to double precision
NORMAL_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
NORMAL_BELOW = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; beyond 7.07 the tail by its continued fraction."""
    x = F.abs(z)

    def poly(coefs):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + F.lit(k)
        return out

    e = F.exp(-x * x / 2)
    far = x + F.lit(0.65)
    for k in (4, 3, 2, 1):
        far = x + F.lit(float(k)) / far
    tail = F.when(x > 37, 0.0).when(x < 7.07106781186547, e * poly(NORMAL_TOP) / poly(NORMAL_BELOW)).otherwise(e / far / F.lit(2.506628274631))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def hash_key(key: list[str], salt: str = "") -> Column:
    """md5 text of the key columns: a random-looking order every engine can reproduce."""
    parts = [c(k).cast("string") for k in key]
    return F.md5(F.concat_ws("-", *parts, F.lit(salt)) if salt else F.concat_ws("-", *parts))


def dots_and_minus_number(v: Column, one_each: bool) -> Column:
    """Text that is digits once dots and minus signs are taken out (at most one of each, or all)."""
    bare = F.translate(v, ".-", "")
    ok = bare.rlike("^[0-9]+$")
    if one_each:
        for mark in (".", "-"):
            ok = ok & ((F.length(v) - F.length(F.translate(v, mark, ""))) <= 1)
    return ok
