"""Drift between two tables, and of a batch against a stored baseline.

All columns of both tables are counted together: one shuffle gives (column, value, n_a, n_b), and
KS, quantile bins, PSI, JS, medians and category tests are aggregates over those counts. Running
totals are range-bucketed, so a near-unique column never meets in one task.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, long_numbers, ratio, rounded
from tablefit.functions.pvalues import chi2_sf, ks_2samp_sf
from tablefit.functions.ranks import exact_quantiles, running_total
from tablefit.operators.facts import as_facts, small_table
from tablefit.sources.tables import column_kinds, normalise, settle

EPS = 1e-8
PSI_BINS, JS_BINS = 10, 20


def psi_band(x):
    return F.when(x < 0.10, "STABLE").when(x < 0.25, "MODERATE_DRIFT").otherwise("SIGNIFICANT_DRIFT")


# ---- numeric columns ---------------------------------------------------------------------------

def both_counts(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(i, v, n_a, n_b): counts of every number of every column on both sides."""
    one = long_numbers(a, cols).select("i", (F.col("v") + F.lit(0.0)).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    two = long_numbers(b, cols).select("i", (F.col("v") + F.lit(0.0)).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return one.unionAll(two).groupBy("i", "v").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def held_counts(held: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """``both_counts`` where side a is given as stored counts (column, v, n)."""
    names = small_table(b.sparkSession, list(enumerate(cols)), [("i", "int"), ("column", "string")])
    one = held.join(F.broadcast(names), "column").select("i", "v", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b"))
    two = long_numbers(b, cols).select("i", (F.col("v") + F.lit(0.0)).alias("v"), F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    return one.unionAll(two).groupBy("i", "v").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


class NumericDrift:
    """Counts of both sides with running totals, stored once, and the statistics read from them.
    Side a may be given as counts (column, v, n) instead of rows."""

    def __init__(self, a: DataFrame, b: DataFrame, cols: list[str], counted: bool = False):
        self.cols, self.spark = cols, a.sparkSession
        self.counts = settle(running_total((held_counts if counted else both_counts)(a, b, cols), ["i"], "v", ["n_a", "n_b"]))
        v, n_a, n_b = F.col("v"), F.col("n_a"), F.col("n_b")
        in_a, in_b = F.when(n_a > 0, v), F.when(n_b > 0, v)
        self.sides = self.counts.groupBy("i").agg(
            F.sum(n_a).alias("t_a"), F.sum(n_b).alias("t_b"), F.min(in_a).alias("min_a"), F.max(in_a).alias("max_a"), F.min(in_b).alias("min_b"),
            F.max(in_b).alias("max_b"), (F.sum(v * n_a) / F.nullif(F.sum(n_a), F.lit(0))).alias("mean_a"), (F.sum(v * n_b) / F.nullif(F.sum(n_b), F.lit(0))).alias("mean_b"),
        )
        self.facts = {r["i"]: r for r in self.sides.collect()}
        self.live = {i: r for i, r in self.facts.items() if r["t_a"] and r["t_b"]}

    def _join(self, t: DataFrame) -> DataFrame:
        """Column name and totals next to per-column results (one row per column)."""
        names = small_table(self.spark, list(enumerate(self.cols)), [("i", "int"), ("column", "string")])
        return t.join(F.broadcast(names), "i")

    def ks(self) -> DataFrame:
        total = lambda k: F.create_map(*[F.lit(x) for i, r in self.live.items() for x in (i, float(r[k]))])[F.col("i")]
        gap = F.abs(F.col("n_a_upto") / total("t_a") - F.col("n_b_upto") / total("t_b"))
        return self.counts.where(F.col("i").isin(list(self.live))).groupBy("i").agg(F.max(gap).alias("ks"))

    def grid(self, side: str, parts: int) -> DataFrame:
        """Exact quantiles of one side at 0, 1/parts, ..., 1 as rows (i, k, v).

        A counted value covers a run of ranks; the grid points that fall into the run follow by
        integer arithmetic, so every row emits only the points it answers."""
        upto, n = F.col(f"n_{side}_upto"), F.col(f"n_{side}")
        total = F.create_map(*[F.lit(x) for i, r in self.live.items() for x in (i, int(r[f"t_{side}"]))])[F.col("i")]
        rows = self.counts.where(F.col("i").isin(list(self.live)) & (n > 0)).select("i", "v", upto.alias("u"), n.alias("n"), (total - 1).alias("m"))

        def hits(shift: int, name: str) -> DataFrame:
            # grid points k whose lower rank floor(k * m / parts), plus shift, lies in [u - n, u)
            first = F.expr(f"(greatest(u - n - {shift}, 0) * {parts} + m - 1) div greatest(m, 1)")
            last = F.expr(f"((u - {shift}) * {parts} - 1) div greatest(m, 1)")
            k = F.when(F.col("m") == 0, F.sequence(F.lit(0), F.lit(parts).cast("bigint"))).when(
                (F.col("u") > shift) & (first <= last) & (first <= parts), F.sequence(first, F.least(last, F.lit(parts)).cast("bigint"))
            )
            return rows.select("i", "m", F.explode(k).alias("k"), F.col("v").alias(name))

        low, high = hits(0, "lo"), hits(1, "hi").drop("m")
        both = low.join(high, ["i", "k"], "left")
        w = F.expr(f"(k * m) % {parts}") / F.lit(float(parts))
        return both.select("i", "k", (F.col("lo") + (F.coalesce("hi", "lo") - F.col("lo")) * w).alias("v"))

    def quantiles(self, parts: int, side: str) -> dict[int, list[float]]:
        out: dict[int, list[float]] = {}
        for r in self.grid(side, parts).orderBy("i", "k").collect():
            out.setdefault(r["i"], []).append(r["v"])
        return out

    def psi(self, bins: int = PSI_BINS) -> DataFrame:
        """Population stability over quantile bins of side a. The last bin is closed on the right;
        values of side b outside the bins fall out, shares are taken of all values."""
        edges = {i: sorted(set(q)) for i, q in self.quantiles(bins, "a").items()}
        usable = {i: e for i, e in edges.items() if len(e) > 1}
        if not usable:
            return small_table(self.spark, [(i, 0.0) for i in self.live], [("i", "int"), ("psi", "double")])
        table = F.create_map(*[x for i, e in usable.items() for x in (F.lit(i), F.array(*[F.lit(v) for v in e]))])[F.col("i")]
        spot = F.least(F.size(F.filter(table, lambda e: e <= F.col("v"))) - 1, F.size(table) - 2)
        placed = self.counts.where(F.col("i").isin(list(usable))).withColumn("bin", spot)
        placed = placed.where((F.col("v") >= table[0]) & (F.col("v") <= F.element_at(table, -1)))
        cells = placed.groupBy("i", "bin").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
        grid = small_table(self.spark, [(i, k) for i, e in usable.items() for k in range(len(e) - 1)], [("i", "int"), ("bin", "int")])
        out = _divergence(F.broadcast(grid).join(cells, ["i", "bin"], "left"), self.live, "psi")
        flat = [(i, 0.0) for i in self.live if i not in usable]
        return out.unionByName(small_table(self.spark, flat, [("i", "int"), ("psi", "double")])) if flat else out

    def js(self, bins: int = JS_BINS) -> DataFrame:
        """Jensen-Shannon distance over equal-width bins of the joint range."""
        lows = {i: min(r["min_a"], r["min_b"]) for i, r in self.live.items()}
        highs = {i: max(r["max_a"], r["max_b"]) for i, r in self.live.items()}
        # a constant column gets the unit-wide range around its value
        span = {i: (lows[i], highs[i]) if highs[i] > lows[i] else (lows[i] - 0.5, highs[i] + 0.5) for i in self.live}
        low = F.create_map(*[F.lit(x) for i in self.live for x in (i, float(span[i][0]))])[F.col("i")]
        width = F.create_map(*[F.lit(x) for i in self.live for x in (i, float(span[i][1] - span[i][0]) / bins)])[F.col("i")]
        spot = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        cells = self.counts.where(F.col("i").isin(list(self.live))).groupBy("i", spot.alias("bin")).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
        grid = small_table(self.spark, [(i, k) for i in self.live for k in range(bins)], [("i", "int"), ("bin", "int")])
        return _js(F.broadcast(grid).join(cells, ["i", "bin"], "left"), ["i"])

    def spread(self) -> DataFrame:
        mean = lambda k: F.create_map(*[F.lit(x) for i, r in self.live.items() for x in (i, float(r[f"mean_{k}"]))])[F.col("i")]
        sq = lambda k: F.sqrt(F.sum(F.col(f"n_{k}") * (F.col("v") - mean(k)) ** 2) / F.sum(f"n_{k}"))
        lo = F.create_map(*[F.lit(x) for i, r in self.live.items() for x in (i, float(r["min_a"]))])[F.col("i")]
        hi = F.create_map(*[F.lit(x) for i, r in self.live.items() for x in (i, float(r["max_a"]))])[F.col("i")]
        outside = F.sum(F.when((F.col("v") < lo) | (F.col("v") > hi), F.col("n_b")).otherwise(0))
        return self.counts.where(F.col("i").isin(list(self.live))).groupBy("i").agg(sq("a").alias("std_a"), sq("b").alias("std_b"), outside.alias("out_of_range"))


def _divergence(cells: DataFrame, live: dict, name: str) -> DataFrame:
    """PSI of binned counts: shares of all values plus epsilon, renormalised."""
    total = lambda k: F.create_map(*[F.lit(x) for i, r in live.items() for x in (i, float(r[f"t_{k}"]))])[F.col("i")]
    share = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) / total(k) + EPS
    every = W.partitionBy("i")  # at most one row per bin
    p = cells.select("i", "bin", share("a").alias("e"), share("b").alias("o"))
    p = p.select("i", (F.col("e") / F.sum("e").over(every)).alias("e"), (F.col("o") / F.sum("o").over(every)).alias("o"))
    return p.groupBy("i").agg(F.abs(F.sum((F.col("o") - F.col("e")) * F.log(F.col("o") / F.col("e")))).alias(name))


def _js(cells: DataFrame, keys: list[str], shares: bool = False) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (natural log) of counts or shares plus epsilon.

    Sums are aggregates, joined back per key (few keys), so many categories stay distributed."""
    p = cells.select(*keys, *[(F.coalesce(F.col(f"{'p' if shares else 'n'}_{k}"), F.lit(0)).cast("double") + EPS).alias(k) for k in ("a", "b")])
    total = p.groupBy(*keys).agg(F.sum("a").alias("s_a"), F.sum("b").alias("s_b"))
    q = p.join(F.broadcast(total), keys).select(*keys, (F.col("a") / F.col("s_a")).alias("p"), (F.col("b") / F.col("s_b")).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    half = F.sum(F.col("p") * F.log(F.col("p") / mid)) + F.sum(F.col("q") * F.log(F.col("q") / mid))
    return q.groupBy(*keys).agg(F.sqrt(F.greatest(half / 2, F.lit(0.0))).alias("js"))


def common_numeric(a: DataFrame, b: DataFrame) -> list[str]:
    ka, kb = column_kinds(a), column_kinds(b)
    return sorted(n for n in set(a.columns) & set(b.columns) if ka[n] == "numeric" and kb[n] == "numeric")


def _both_sides(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(i, v, a, b): every number of every column with a 1 for its side."""
    one = long_numbers(a, cols).select("i", "v", F.lit(1).alias("a"), F.lit(0).alias("b"))
    return one.unionAll(long_numbers(b, cols).select("i", "v", F.lit(0).alias("a"), F.lit(1).alias("b")))


def _bin_cells(rows: DataFrame, spot) -> dict[int, dict[int, tuple[int, int]]]:
    """Counts of both sides by column and bin, from one scan; only a few bins per column leave it."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("i", spot.alias("bin")).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).collect():
        out.setdefault(r["i"], {})[r["bin"]] = (r["n_a"], r["n_b"])
    return out


def psi(a, b, cols: list[str] | None = None) -> DataFrame:
    """Population stability over the deciles of side a: exact edges of one side, then one binning scan of
    both. The last bin is closed on the right; values of side b outside the bins fall out, shares are
    taken of all values. Fewer than two different edges give 0; a column empty on a side has no row."""
    a, b = normalise(a), normalise(b)
    cols = cols or common_numeric(a, b)
    edges = {i: sorted({v for v in q.values() if v is not None}) for i, (n, q) in enumerate(exact_quantiles(a, cols, [k / PSI_BINS for k in range(PSI_BINS + 1)]).items())}
    table = F.create_map(*[x for i, e in edges.items() for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in e]) if e else F.array().cast("array<double>"))])[F.col("i")]
    inside = (F.size(table) > 1) & (F.col("v") >= table[0]) & (F.col("v") <= F.element_at(table, -1))
    spot = F.when(inside, F.least(F.size(F.filter(table, lambda e: e <= F.col("v"))) - 1, F.size(table) - 2)).otherwise(-1)
    rows = []
    for i, cells in _bin_cells(_both_sides(a, b, cols), spot).items():
        t_a, t_b = (sum(x[side] for x in cells.values()) for side in (0, 1))
        if t_a and t_b:
            got = [cells.get(k, (0, 0)) for k in range(len(edges[i]) - 1)]
            e, o = [x / t_a + EPS for x, _ in got], [y / t_b + EPS for _, y in got]
            rows.append((cols[i], abs(math.fsum((y / sum(o) - x / sum(e)) * math.log(y / sum(o) / (x / sum(e))) for x, y in zip(e, o)))))
    t = small_table(a.sparkSession, rows, [("column", "string"), ("psi", "double")])
    return t.select("column", rounded(F.col("psi")).alias("psi"), psi_band(F.round("psi", 4)).alias("band"))


def js_distance(a, b, cols: list[str] | None = None) -> DataFrame:
    """Jensen-Shannon distance over equal-width bins of the joint range: one scan for the ranges, one that
    bins both sides. A column empty on a side has no row."""
    a, b = normalise(a), normalise(b)
    cols = cols or common_numeric(a, b)
    sides = _both_sides(a, b, cols)
    ranges = {r["i"]: (r["lo"], r["hi"]) for r in sides.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0 and b > 0").collect()}
    # a constant column gets the unit-wide range around its value
    span = {i: (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5) for i, (lo, hi) in ranges.items()}
    rows = []
    if span:
        of = lambda get: F.create_map(*[x for i, s in span.items() for x in (F.lit(i), F.lit(float(get(s))))])[F.col("i")]
        spot = F.least(F.floor((F.col("v") - of(lambda s: s[0])) / of(lambda s: (s[1] - s[0]) / JS_BINS)), F.lit(JS_BINS - 1)).cast("int")
        for i, cells in _bin_cells(sides.where(F.col("i").isin(list(span))), spot).items():
            p, q = ([cells.get(k, (0, 0))[side] + EPS for k in range(JS_BINS)] for side in (0, 1))
            p, q = [x / math.fsum(p) for x in p], [x / math.fsum(q) for x in q]
            half = math.fsum(x * math.log(2 * x / (x + y)) + y * math.log(2 * y / (x + y)) for x, y in zip(p, q))
            rows.append((cols[i], math.sqrt(max(half / 2, 0.0))))
    t = small_table(a.sparkSession, rows, [("column", "string"), ("js", "double")])
    return t.select("column", rounded(F.col("js")).alias("js_distance"))


def ks_2samp(a, b, cols: list[str] | None = None) -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per column."""
    a, b = normalise(a), normalise(b)
    d = NumericDrift(a, b, cols or common_numeric(a, b))
    rows = [(d.cols[r["i"]], r["ks"], ks_2samp_sf(r["ks"], d.live[r["i"]]["t_a"], d.live[r["i"]]["t_b"])) for r in d.ks().collect()]
    t = small_table(d.spark, rows, [("column", "string"), ("ks_statistic", "double"), ("p_value", "double")])
    return t.select("column", rounded(F.col("ks_statistic")).alias("ks_statistic"), rounded(F.col("p_value")).alias("p_value"))


def drift_numeric(a, b, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column: KS, PSI, JS, shifts of mean, deviation and median, out-of-range
    share and severity (PSI band, raised by a significant KS test)."""
    a, b = normalise(a), normalise(b)
    d = NumericDrift(a, b, cols or common_numeric(a, b))
    med_a, med_b = d.quantiles(2, "a"), d.quantiles(2, "b")
    got = d.ks().join(d.psi(), "i").join(d.js(), "i").join(d.spread(), "i").collect()  # one row per column
    rows = []
    for r in got:
        i, f = r["i"], d.live[r["i"]]
        rows.append((
            d.cols[i], r["ks"], ks_2samp_sf(r["ks"], f["t_a"], f["t_b"]), r["psi"], r["js"], f["mean_a"], f["mean_b"], r["std_a"], r["std_b"],
            med_a[i][1], med_b[i][1], int(r["out_of_range"]), int(f["t_b"]),
        ))
    t = small_table(d.spark, rows, [("column", "string")] + [(n, "double") for n in ("ks", "p", "psi", "js", "mean_a", "mean_b", "std_a", "std_b", "med_a", "med_b")] + [("out", "bigint"), ("t_b", "bigint")])
    shift = lambda k: F.abs(F.col(f"{k}_b") - F.col(f"{k}_a")) / ((F.abs(F.col(f"{k}_a"))) + 1e-9) * 100
    base = psi_band(F.round("psi", 4))
    severity = F.when((F.col("p") < 0.001) & (shift("mean") > 20), "SIGNIFICANT_DRIFT").when((F.col("p") < 0.05) & (base == "STABLE"), "MODERATE_DRIFT").otherwise(base)
    return t.select(
        "column", F.lit("numeric").alias("dtype"), severity.alias("drift_severity"), (severity != "STABLE").alias("drift_detected"),
        rounded(F.col("ks")).alias("ks_statistic"), rounded(F.col("p")).alias("p_value"), rounded(F.col("psi")).alias("psi"), rounded(F.col("js")).alias("js_distance"),
        rounded(shift("mean"), 2).alias("mean_shift_pct"), rounded(shift("std"), 2).alias("std_shift_pct"), rounded(shift("med"), 2).alias("median_shift_pct"),
        F.col("out").alias("out_of_range"), rounded(F.col("out") / F.col("t_b") * 100, 2).alias("out_of_range_pct"),
    )


# ---- categorical columns -----------------------------------------------------------------------

def category_counts(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n_a, n_b) of text-like columns."""
    def side(df, x, y):
        entries = [F.when(c(n).isNotNull(), F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value"))) for n in cols]
        return df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*", F.lit(x).alias("a"), F.lit(y).alias("b"))
    return side(a, 1, 0).unionAll(side(b, 0, 1)).groupBy("column", "value").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def category_shifts(a, b, cols: list[str]) -> DataFrame:
    """Share of each value on both sides, its shift, and whether it is new or vanished."""
    counts = category_counts(normalise(a), normalise(b), cols)
    totals = counts.groupBy("column").agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    t = counts.join(F.broadcast(totals), "column")
    pa, pb = ratio(F.col("n_a"), F.col("t_a")), ratio(F.col("n_b"), F.col("t_b"))
    return t.select(
        "column", "value", rounded(pa * 100, 2).alias("share_a"), rounded(pb * 100, 2).alias("share_b"), rounded((pb - pa) * 100, 2).alias("shift"),
        F.when(F.col("n_a") == 0, "new").when(F.col("n_b") == 0, "vanished").otherwise("kept").alias("state"),
    )


def drift_categorical(a, b, cols: list[str] | None = None) -> DataFrame:
    """One row per text-like column: chi-square (Yates for two categories), JS distance, PSI over
    per-mille shares, new and vanished categories, severity."""
    a, b = normalise(a), normalise(b)
    if cols is None:
        ka = column_kinds(a)
        cols = sorted(n for n in set(a.columns) & set(b.columns) if ka[n] != "numeric")
    counts = settle(category_counts(a, b, cols))
    totals = counts.groupBy("column").agg(
        F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"), F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("n_a") == 0).alias("new"), F.count_if(F.col("n_b") == 0).alias("gone"),
    ).where("t_a > 0 and t_b > 0")
    t = counts.join(F.broadcast(totals), "column")
    row = F.col("n_a") + F.col("n_b")
    n = (F.col("t_a") + F.col("t_b")).cast("double")
    fix = F.when(F.col("k") == 2, 0.5).otherwise(0.0)

    def cell(side):
        expect = row * F.col(f"t_{side}") / n
        gap = F.abs(F.col(f"n_{side}") - expect)
        gap = gap - F.least(fix, gap)
        return gap * gap / expect

    t = t.withColumn("p_a", F.col("n_a") / F.col("t_a")).withColumn("p_b", F.col("n_b") / F.col("t_b"))
    chi = t.groupBy("column", "t_a", "t_b", "k", "new", "gone").agg(F.sum(cell("a") + cell("b")).alias("chi2"))
    js = _js(t, ["column"], shares=True)
    found = chi.join(js, "column").collect()
    per_mille = _per_mille_psi(t)
    rows = []
    for r in found:
        p = chi2_sf(r["chi2"], r["k"] - 1) if r["k"] > 1 else None
        rows.append((r["column"], r["chi2"] if r["k"] > 1 else None, p, r["js"], per_mille.get(r["column"], 0.0), int(r["new"]), int(r["gone"])))
    out = small_table(a.sparkSession, rows, [("column", "string"), ("chi2", "double"), ("p", "double"), ("js", "double"), ("psi", "double"), ("new", "bigint"), ("gone", "bigint")])
    p = F.round("p", 4)
    severity = (
        F.when((p < 0.001) | (F.col("new") > 3), "SIGNIFICANT_DRIFT").when((p < 0.05) | (F.col("new") > 0) | (F.col("gone") > 0), "MODERATE_DRIFT").otherwise("STABLE")
    )
    return out.select(
        "column", F.lit("categorical").alias("dtype"), severity.alias("drift_severity"), (severity != "STABLE").alias("drift_detected"),
        rounded(F.col("chi2")).alias("chi2_statistic"), rounded(F.col("p")).alias("p_value"), rounded(F.col("js")).alias("js_distance"),
        rounded(F.col("psi")).alias("psi"), F.col("new").alias("new_categories"), F.col("gone").alias("vanished_categories"),
    )


def _per_mille_psi(t: DataFrame) -> dict[str, float]:
    """PSI where each category index is repeated by its share in per mille and cut at k quantiles
    of the repeated indexes. Only categories with at least 0.5 per mille on a side survive the
    rounding (no more than 4,000 per column), so this part is small whatever the table."""
    rint = lambda x: F.rint(x * 1000).cast("int")
    weights = t.select("column", "value", "k", rint(F.col("p_a")).alias("w_a"), rint(F.col("p_b")).alias("w_b"))
    kept = weights.where("w_a > 0 or w_b > 0")
    # position of each surviving category among all categories of its column
    ranked = running_positions(weights.select("column", "value"), kept.select("column", "value"))
    rows = kept.join(ranked, ["column", "value"]).collect()
    return {name: repeated_psi([(r["pos"], r["w_a"], r["w_b"]) for r in rows if r["column"] == name], next(r["k"] for r in rows if r["column"] == name)) for name in {r["column"] for r in rows}}


def repeated_psi(weights: list[tuple[int, int, int]], k: int) -> float:
    """PSI of indexes repeated by two weights, over bins between k + 1 quantiles of the first side.

    Quantiles are not listed: the bin of an index is found by bisection, bins without any index are
    counted, so k may be as large as the number of categories of any table."""
    a = np.repeat([p for p, w, _ in sorted(weights)], [w for _, w, _ in sorted(weights)]).astype(float)
    total_b = sum(w for _, _, w in weights)
    if not len(a) or not total_b:
        return 0.0

    def edge(j: int) -> float:
        # linear interpolation as numpy.quantile rounds it
        at = (len(a) - 1) * (1.0 if j == k else j * (1.0 / k))
        low = min(math.floor(at), len(a) - 1)
        x, y, w = float(a[low]), float(a[min(low + 1, len(a) - 1)]), at - low
        return x + (y - x) * w if w < 0.5 else y - (y - x) * (1.0 - w)

    upto = lambda x: bisect.bisect_right(range(k + 1), x, key=edge)  # quantiles up to x
    # different quantiles: all that lie strictly between neighbours, and each index that is hit
    points = sorted(set(a.tolist()))
    below = lambda x: bisect.bisect_left(range(k + 1), x, key=edge)
    edges = sum(upto(x) > below(x) for x in points) + sum(below(y) - upto(x) for x, y in zip(points, points[1:]))
    if edges < 2:
        return 0.0
    cells: dict[float, list[int]] = {}
    last = edge(below(points[-1]) - 1)  # where the last bin starts
    for p, w_a, w_b in weights:
        if points[0] <= p <= points[-1]:
            start = last if p == points[-1] else edge(upto(p) - 1)
            cell = cells.setdefault(start, [0, 0])
            cell[0] += w_a
            cell[1] += w_b
    e = np.array([c[0] / len(a) for c in cells.values()] + [0.0]) + EPS
    o = np.array([c[1] / total_b for c in cells.values()] + [0.0]) + EPS
    times = np.array([1] * len(cells) + [edges - 1 - len(cells)])
    e, o = e / (e * times).sum(), o / (o * times).sum()
    return abs(math.fsum(times * (o - e) * np.log(o / e)))


def running_positions(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted position (from 0) of the wanted values among all values of their column. ``wanted``
    is bounded (see the caller); each is compared with counts between neighbours only."""
    order = W.partitionBy("column").orderBy("value")
    marks = wanted.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("marks"))
    gaps = every.join(F.broadcast(marks), "column").select("column", F.size(F.filter("marks", lambda m: m < F.col("value"))).alias("slot"))
    sizes = gaps.groupBy("column", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("column", "slot", (F.sum("n").over(W.partitionBy("column").orderBy("slot")) - 1).alias("pos"))
    numbered = wanted.withColumn("slot", F.row_number().over(order) - 1)
    return numbered.join(before, ["column", "slot"]).select("column", "value", "pos")


# ---- table level -------------------------------------------------------------------------------

def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every column of either table with its state: common, only on one side, or type mismatch."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    state = lambda n: "only_a" if n not in tb else "only_b" if n not in ta else "common" if ta[n] == tb[n] else "type_mismatch"
    rows = [(n, ta.get(n), tb.get(n), state(n)) for n in sorted({*ta, *tb})]
    return small_table(a.sparkSession, rows, [("column", "string"), ("type_a", "string"), ("type_b", "string"), ("state", "string")])


def missing_drift(a, b, limit: float = 5.0) -> DataFrame:
    """Columns whose missing share moved by more than 5 points (more than 20: HIGH)."""
    fa, fb = as_facts(a), as_facts(b)
    rows = [(n, fa.scan()[n]["missing_share"] * 100, fb.scan()[n]["missing_share"] * 100) for n in sorted(set(fa.columns) & set(fb.columns))]
    t = small_table(fa.spark, rows, [("column", "string"), ("a", "double"), ("b", "double")])
    t = t.select("column", rounded(F.col("a"), 2).alias("missing_a"), rounded(F.col("b"), 2).alias("missing_b"))
    shift = rounded(F.col("missing_b") - F.col("missing_a"), 2)
    return t.withColumn("shift", shift).where(F.abs("shift") > limit).withColumn("severity", F.when(F.abs("shift") > 20, "HIGH").otherwise("MODERATE"))


def size_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    na, nb = a.count(), b.count()
    t = small_table(a.sparkSession, [(na, nb, len(a.columns), len(b.columns))], [("rows_a", "bigint"), ("rows_b", "bigint"), ("columns_a", "bigint"), ("columns_b", "bigint")])
    r = rounded(F.coalesce(ratio(F.col("rows_b"), F.col("rows_a")), F.lit(0.0)), 3)
    return t.withColumn("ratio", r).withColumn("larger_warning", F.col("ratio") > 2).withColumn("small_warning", F.col("ratio") < 0.1).withColumn("width_warning", F.col("columns_a") != F.col("columns_b"))


def drift_columns(a, b) -> DataFrame:
    """Both kinds of columns in one table. A column that is numeric on one side only is a type mismatch:
    drifted, with the highest severity and no statistics."""
    a, b = normalise(a), normalise(b)
    parts = []
    shared = set(a.columns) & set(b.columns)
    ka, kb = column_kinds(a), column_kinds(b)
    mixed = sorted(n for n in shared if (ka[n] == "numeric") != (kb[n] == "numeric"))
    numeric = sorted(n for n in shared if ka[n] == "numeric" and n not in mixed)
    other = sorted(n for n in shared if ka[n] != "numeric" and n not in mixed)
    keep = ["column", "dtype", "drift_detected", "drift_severity", "psi", "js_distance", "p_value"]
    if numeric:
        parts.append(drift_numeric(a, b, numeric).select(*keep))
    if other:
        parts.append(drift_categorical(a, b, other).select(*keep))
    if mixed or not parts:
        kinds = ["string", "string", "boolean", "string", "double", "double", "double"]
        parts.append(small_table(a.sparkSession, [(n, "mismatch", True, "SIGNIFICANT_DRIFT", None, None, None) for n in mixed], list(zip(keep, kinds))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_ranking(a, b) -> DataFrame:
    """``drift_columns`` with ``position``: the most severe first, then by name. One row per column."""
    order = F.when(F.col("drift_severity") == "SIGNIFICANT_DRIFT", 0).when(F.col("drift_severity") == "MODERATE_DRIFT", 1).otherwise(2)
    t = drift_columns(a, b).withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "column")))
    return t.orderBy("position")


def drift_report(a, b) -> DataFrame:
    """Counts by severity, share of drifted columns, overall risk."""
    s = F.col("drift_severity")
    t = drift_columns(a, b).agg(
        F.count(F.lit(1)).alias("total_columns"), F.count_if(~F.col("drift_detected")).alias("stable_columns"), F.count_if(s == "MODERATE_DRIFT").alias("moderate_columns"),
        F.count_if(s == "SIGNIFICANT_DRIFT").alias("significant_columns"),
    )
    return t.select(
        "*", rounded((F.col("total_columns") - F.col("stable_columns")) / F.col("total_columns") * 100, 1).alias("drift_percent"),
        F.when(F.col("significant_columns") > 0, "HIGH").when(F.col("moderate_columns") > 0, "MODERATE").otherwise("LOW").alias("overall_risk"),
    )


# ---- stored baseline ---------------------------------------------------------------------------

GRID = 1000


class Baseline:
    """Snapshot of a table: column facts, full category shares, and per numeric column an exact
    1001-point quantile grid and the count of every value (column, v, n), in place of a random sample."""

    PARTS = ("columns", "categories", "grid", "counts")

    def __init__(self, columns: DataFrame, categories: DataFrame, grid: DataFrame, counts: DataFrame):
        self.columns, self.categories, self.grid, self.counts = columns, categories, grid, counts

    @staticmethod
    def of(df, target: str | None = None) -> Baseline:
        f = as_facts(df)
        cols = [n for n in f.columns if n != target]
        numeric = [n for n in f.numeric if n != target]
        other = [n for n in cols if n not in numeric]
        scan = f.scan()
        rows = [(n, f.types[n], "numeric" if n in numeric else "categorical", float(scan[n].get("mean") or 0.0), float(scan[n].get("std") or 0.0), scan[n]["present"]) for n in cols]
        columns = small_table(f.spark, rows, [("column", "string"), ("type", "string"), ("kind", "string"), ("mean", "double"), ("std", "double"), ("present", "bigint")])
        counts = category_counts(f.df, f.df.limit(0), other) if other else None
        if counts is None:
            categories = small_table(f.spark, [], [("column", "string"), ("value", "string"), ("share", "double")])
        else:
            total = counts.groupBy("column").agg(F.sum("n_a").alias("t"))
            categories = counts.join(F.broadcast(total), "column").select("column", "value", (F.col("n_a") / F.col("t")).alias("share"))
        filled = [n for n in numeric if scan[n]["present"]]
        if filled:
            d = NumericDrift(f.df, f.df, filled)
            grid = d._join(d.grid("a", GRID)).select("column", (F.col("k") / F.lit(float(GRID))).alias("p"), "v")
            values = d._join(d.counts.where("n_a > 0")).select("column", "v", F.col("n_a").alias("n"))
        else:
            grid = small_table(f.spark, [], [("column", "string"), ("p", "double"), ("v", "double")])
            values = small_table(f.spark, [], [("column", "string"), ("v", "double"), ("n", "bigint")])
        return Baseline(columns, categories, grid, values)

    def save(self, path: str) -> None:
        for name in Baseline.PARTS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> Baseline:
        return Baseline(*[spark.read.parquet(f"{path}/{name}") for name in Baseline.PARTS])


def drift_vs_baseline(base: Baseline, batch: DataFrame) -> DataFrame:
    """Checks a batch against a baseline, one row per expected column: missing column, kind
    mismatch, KS (p below .01 HIGH, .05 MEDIUM) or category PSI (above .2 HIGH, .1 MEDIUM), with the
    overall verdict on every row. ``value`` of KS is read at the baseline's grid, within 1/1000 +
    1/rows of the statistic on all rows; p-value and severity are those of all rows. Works
    unchanged inside foreachBatch."""
    batch = normalise(batch)
    spark, kinds = batch.sparkSession, column_kinds(batch)
    expected = base.columns.collect()
    rows, numeric, other = [], [], []
    for r in expected:
        n = r["column"]
        if n not in kinds:
            rows.append((n, "missing_column", None, None, "HIGH"))
            continue
        is_num = kinds[n] == "numeric"
        if is_num != (r["kind"] == "numeric"):
            rows.append((n, "type_mismatch", None, None, "HIGH"))
        if r["kind"] == "numeric" and is_num and r["present"]:
            numeric.append(n)
        elif r["kind"] == "categorical":
            other.append(n)
    broken = any(r[4] == "HIGH" for r in rows)
    drift = []
    if numeric:
        # one running total over stored counts, batch and grid: the grid is a step function about 1/1001 away
        # from the rows, so its gap is only shown; the p-value comes from all rows
        names = F.broadcast(small_table(spark, list(enumerate(numeric)), [("i", "int"), ("column", "string")]))  # one row per column
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        part = lambda t, a, b, g: t.select("i", (F.col("v") + F.lit(0.0)).alias("v"), a.alias("n_a"), b.alias("n_b"), g.alias("n_g"))
        rows_of = part(base.counts.join(names, "column"), F.col("n"), zero, zero).unionAll(part(long_numbers(batch, numeric), zero, one, zero)).unionAll(part(base.grid.join(names, "column"), zero, zero, one))
        counted = rows_of.groupBy("i", "v").agg(*[F.sum(n).alias(n) for n in ("n_a", "n_b", "n_g")])
        placed = running_total(counted, ["i"], "v", ["n_a", "n_b", "n_g"])
        sizes = counted.groupBy("i").agg(*[F.sum(n).alias(f"t{n[1:]}") for n in ("n_a", "n_b", "n_g")])
        share = lambda s: F.col(f"n_{s}_upto") / F.nullif(F.col(f"t_{s}"), F.lit(0))
        found = placed.join(F.broadcast(sizes), "i").groupBy("i", "t_a", "t_b").agg(F.max(F.abs(share("a") - share("b"))).alias("ks"), F.max(F.abs(share("g") - share("b"))).alias("shown"))
        for r in found.where("t_a > 0 and t_b > 0").collect():
            p = ks_2samp_sf(r["ks"], r["t_a"], r["t_b"])
            drift.append((numeric[r["i"]], "ks", r["shown"], p, "HIGH" if p < 0.01 else "MEDIUM" if p < 0.05 else "LOW"))
    if other:
        counts = category_counts(batch, batch.limit(0), other)
        total = counts.groupBy("column").agg(F.sum("n_a").alias("t"))
        now = counts.join(F.broadcast(total), "column").select("column", "value", (F.col("n_a") / F.col("t")).alias("now"))
        then = base.categories.where(F.col("column").isin(other)).select("column", "value", F.col("share").alias("then"))
        e, o = F.greatest(F.coalesce("then", F.lit(1e-4)), F.lit(1e-4)), F.greatest(F.coalesce("now", F.lit(1e-4)), F.lit(1e-4))
        score = now.join(then, ["column", "value"], "full_outer").groupBy("column").agg(F.sum((o - e) * F.log(o / e)).alias("psi"))
        present = {r["column"] for r in total.collect()}
        for r in score.collect():
            if r["column"] in present:
                drift.append((r["column"], "psi", r["psi"], None, "HIGH" if r["psi"] > 0.2 else "MEDIUM" if r["psi"] > 0.1 else "LOW"))
    n = max(len(expected), 1)
    high, medium = (sum(r[4] == s for r in drift) for s in ("HIGH", "MEDIUM"))
    overall = "HIGH" if broken or high / n > 0.2 else "MEDIUM" if high or medium / n > 0.3 else "LOW"
    t = small_table(spark, [(*r, overall) for r in rows + drift], [
        ("column", "string"), ("check", "string"), ("value", "double"), ("p_value", "double"), ("severity", "string"), ("overall", "string")])
    return t.withColumn("value", rounded(F.col("value"))).withColumn("p_value", rounded(F.col("p_value")))
