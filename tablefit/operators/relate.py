"""Association between columns: Pearson, Spearman, Kendall, leakage, mutual information, F test."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.exprs import band, c, rounded
from tablefit.functions.pvalues import f_sf
from tablefit.functions.ranks import COLUMNS_PER_SCAN, attach_values, average_rank, count_values, group_many, running_total
from tablefit.operators.facts import PAIRS_IN_JVM, Facts, as_facts, pair_correlations, small_table
from tablefit.sources.tables import settle

PAIR_FIELDS = [("feature_1", "string"), ("feature_2", "string"), ("pearson", "double")]


SMALL_TOTALS = 200_000  # rows that may be broadcast: about 10 MB

def _pairs_table(f: Facts, pairs: dict) -> DataFrame:
    rows = [(a, b, float(r)) for (a, b), r in pairs.items() if r is not None]
    return small_table(f.spark, rows, PAIR_FIELDS)


def corr_pairs(df, threshold: float = 0.75) -> DataFrame:
    """Numeric pairs with |r| above the threshold and their severity."""
    f = as_facts(df)
    r = F.abs("pearson")
    return _pairs_table(f, f.corr()).where(r > threshold).select(
        "feature_1", "feature_2", rounded(F.col("pearson")).alias("pearson"),
        F.when(r > 0.95, "CRITICAL").when(r > 0.85, "HIGH").otherwise("MODERATE").alias("severity"),
    )


def corr_methods(df, threshold: float = 0.8) -> DataFrame:
    """Strong pairs by three methods; which member to drop is the one with the lower variance."""
    f = as_facts(df)
    strong = {p: r for p, r in f.corr().items() if r is not None and abs(r) > threshold}
    rho = spearman(f, list(strong)) if strong else {}
    rows = []
    for (a, b), r in strong.items():
        s, t = rho[a, b], kendall(f.df, a, b)
        agree = s is not None and t is not None and abs(s) > 0.8 and abs(t) > 0.8
        drop = a if f.scan()[a]["var"] < f.scan()[b]["var"] else b
        rows.append((a, b, float(r), s, t, agree, drop))
    t = small_table(f.spark, rows, [*PAIR_FIELDS, ("spearman", "double"), ("kendall", "double"), ("all_methods_agree", "boolean"), ("drop_suggestion", "string")])
    size = F.abs("pearson")
    return t.select(
        "feature_1", "feature_2", *[rounded(F.col(m)).alias(m) for m in ("pearson", "spearman", "kendall")],
        F.when(size > 0.95, "CRITICAL").when(size > 0.9, "HIGH").otherwise("MODERATE").alias("severity"),
        "all_methods_agree", "drop_suggestion",
    )


def spearman(df, pairs: list[tuple[str, str]] | None = None) -> dict[tuple[str, str], float | None]:
    """Spearman rho of column pairs: Pearson of average ranks.

    Ranks come from counted values (one shuffle for all columns) and are joined back per column;
    hot values are broadcast, so no join key carries more than a thousandth of the rows. With nulls
    a value has one rank for each partner of its column, taken among the rows where both are present:
    the same shuffle counts every value by the partners present beside it.
    """
    f = as_facts(df)
    names = f.numeric
    pairs = pairs or [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    used = sorted({n for p in pairs for n in p})
    base = f.df.select(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(used)])
    if any(f.scan()[n]["missing"] for n in used):
        return _spearman_with_nulls(base, used, pairs, f.rows)
    cols = base.columns
    ranked = settle(average_rank(count_values(base, cols).select("column", F.col("num").alias("v"), "cnt"), ["column"], "v", "cnt"))
    for i in range(len(used)):
        look = ranked.where(F.col("column") == f"x{i}").select(F.col("v").alias(f"x{i}"), "cnt", F.col("rank").alias(f"r{i}"))
        base = attach_values(base, look, f"x{i}", "cnt", f.rows)
    ranks = base.select(*[F.col(f"r{i}").alias(n) for i, n in enumerate(used)])
    return pair_correlations(ranks, pairs, {n: (f.rows + 1) / 2 for n in used})


def _spearman_with_nulls(base: DataFrame, used: list[str], pairs: list[tuple[str, str]], rows: int) -> dict[tuple[str, str], float | None]:
    """Every pair over its own complete rows. ``base`` has columns x0, x1, ... in the order of ``used``."""
    at = {n: i for i, n in enumerate(used)}
    partners = {i: sorted({at[b] for a, b in pairs if at[a] == i} | {at[a] for a, b in pairs if at[b] == i}) for i in at.values()}
    # (column, value, rows with it, rows of it where each other column is present)
    there = F.array(*[F.col(n).isNotNull().cast("bigint") for n in base.columns])
    entries = [F.when(F.col(n).isNotNull(), F.struct(F.lit(i).alias("i"), (F.col(n) + F.lit(0.0)).alias("v"))) for i, n in enumerate(base.columns)]
    long = base.select(there.alias("t"), F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.i", "e.v", "t")
    beside = [f"n{j}" for j in range(len(used))]
    counted = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(F.col("t")[j]).alias(n) for j, n in enumerate(beside)])
    ranked = running_total(counted, ["i"], "v", beside)
    rank = lambda j: F.col(f"n{j}_upto") - (F.col(f"n{j}") - 1) / F.lit(2.0)
    ranked = settle(ranked.select("i", "v", "cnt", F.array(*[rank(j) for j in range(len(used))]).alias("r")))
    for i in range(len(used)):
        look = ranked.where(F.col("i") == i).select(F.col("v").alias(f"x{i}"), "cnt", F.col("r").alias(f"r{i}"))
        base = attach_values(base.withColumn(f"x{i}", F.col(f"x{i}") + F.lit(0.0)), look, f"x{i}", "cnt", rows)
    both = lambda i, j: F.when(F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull(), F.col(f"r{i}")[j]).alias(f"r{i}_{j}")
    ranks = settle(base.select(*[both(i, j) for i, js in partners.items() for j in js]))
    sizes = ranks.agg(*[F.count(f"r{at[a]}_{at[b]}").alias(f"n{k}") for k, (a, b) in enumerate(pairs)]).first()
    out: dict[tuple[str, str], float | None] = {}
    for k in range(0, len(pairs), PAIRS_IN_JVM):  # each pair has rank columns of its own
        part = {p: (f"r{at[p[0]]}_{at[p[1]]}", f"r{at[p[1]]}_{at[p[0]]}") for p in pairs[k:k + PAIRS_IN_JVM]}
        mid = {n: (sizes[f"n{k + i}"] + 1) / 2 for i, cols in enumerate(part.values()) for n in cols}
        got = pair_correlations(ranks, list(part.values()), mid)
        out |= {p: got[cols] for p, cols in part.items()}
    return out


def spearman_pairs(df) -> DataFrame:
    f = as_facts(df)
    rows = [(a, b, r) for (a, b), r in spearman(f).items() if r is not None]
    t = small_table(f.spark, rows, [("feature_1", "string"), ("feature_2", "string"), ("spearman", "double")])
    return t.select("feature_1", "feature_2", rounded(F.col("spearman")).alias("spearman"))


def _inversions(y, weight) -> int:
    """Weighted pairs of a sequence whose first y is larger, bit by bit over the dense rank of y: two
    entries differ first at some bit, share all higher bits, and are inverted when the 1 comes first."""
    import numpy as np

    rank = np.unique(y, return_inverse=True)[1]
    out, top = 0, int(rank.max()).bit_length() if len(rank) else 0
    w = weight.astype(np.int64)
    for bit in range(top - 1, -1, -1):  # entries lie grouped by their higher bits, each group in sequence
        high, one = rank >> (bit + 1), (rank >> bit) & 1 == 1
        ones = np.cumsum(np.where(one, w, 0))
        start = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        before = np.repeat(np.r_[0, ones[start[1:] - 1]], np.diff(np.r_[start, len(rank)]))
        out += int(((ones - before)[~one] * w[~one]).sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return out


def _discordant(cells: DataFrame, cell_rows: int = 500_000, most: int = 255) -> int:
    """Weighted pairs of (x, y, cnt) cells of which one has the larger x and the smaller y.

    Both columns are cut into ranges, a value that is a cut being a range of its own. Pairs that differ in
    both ranges follow from the counts of the grid of ranges; those of one x range are counted inside it,
    and those of one y range but different x ranges inside that. Ranges of one value hold no such pair, so
    a hot value is never gathered in a task; the others hold about ``cell_rows`` cells, more where ``most``
    cuts are not enough."""
    import numpy as np
    import pandas as pd

    total = cells.count()
    wanted = min(most, max(1, total // cell_rows))
    even = [(k + 1) / (wanted + 1) for k in range(wanted)]
    cuts = cells.agg(*[F.percentile_approx(n, even, 20 * (wanted + 1)).alias(n) for n in ("x", "y")]).first()

    def spot(n):  # 2k: between cuts, 2k + 1: the value is cut k
        at = F.array(*[F.lit(float(e)) for e in sorted(set(cuts[n]))])
        return F.size(F.filter(at, lambda e: e < F.col(n))) + F.size(F.filter(at, lambda e: e <= F.col(n)))

    placed = cells.select("x", "y", "cnt", spot("x").alias("bx"), spot("y").alias("by"))
    grid = placed.groupBy("bx", "by").agg(F.sum("cnt").alias("n")).toPandas()
    counts = np.zeros((2 * most + 2, 2 * most + 2), np.int64)
    counts[grid["bx"], grid["by"]] = grid["n"]
    below = np.zeros_like(counts)  # rows of smaller y ranges in larger x ranges
    below[:-1, 1:] = np.cumsum(np.cumsum(counts[::-1], axis=0)[::-1], axis=1)[1:, :-1]
    out = int((counts * below).sum())

    def inside(first: str, second: str):
        def run(pdf):
            pdf = pdf.sort_values([first, second])
            return pd.DataFrame({"k": [_inversions(pdf[second].to_numpy(), pdf["cnt"].to_numpy())]})
        return run

    for by, first in (("bx", "x"), ("by", "bx")):
        part = placed.where(F.col(by) % 2 == 0).select(*dict.fromkeys([by, first, "y", "cnt"]))
        out += part.groupBy(by).applyInPandas(inside(first, "y"), "k long").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    return out


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall tau-b, exact in n log n work without comparing pairs: counted (x, y) cells are shuffled
    twice, by ranges of x and by ranges of y (see ``_discordant``)."""
    both = df.select(c(a).cast("double").alias("x"), c(b).cast("double").alias("y")).dropna()
    cells = settle(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("cnt")))  # three passes follow
    ties = lambda col: cells.groupBy(col).agg(F.sum("cnt").alias("t")).agg(F.sum(F.col("t").cast("double") * (F.col("t") - 1) / 2)).first()[0]
    total = cells.agg(F.sum("cnt"), F.sum(F.col("cnt").cast("double") * (F.col("cnt") - 1) / 2)).first()
    if total[0] is None or total[0] < 2:
        return None
    n, joint = total
    n0, n1, n2 = n * (n - 1) / 2, ties("x"), ties("y")
    if n0 == n1 or n0 == n2:
        return None
    discordant = _discordant(cells)
    agreeing = n0 - n1 - n2 + joint - discordant
    return (agreeing - discordant) / math.sqrt((n0 - n1) * (n0 - n2))


def target_corr(df, target: str) -> DataFrame:
    """Correlation of every numeric column with the target."""
    f = as_facts(df)
    rows = [(n, r) for n, r in f.corr_with(target).items()]
    t = small_table(f.spark, rows, [("feature", "string"), ("correlation", "double")])
    return t.select("feature", rounded(F.coalesce(F.col("correlation"), F.lit(0.0))).alias("correlation"))


# ---- leakage -----------------------------------------------------------------------------------

def leakage_rows(f: Facts, target: str) -> list[tuple[str, float, str]]:
    """(feature, correlation, reason) by near-perfect correlation or one-to-one mapping."""
    rows = []
    if f.kinds[target] == "numeric":
        rows += [(n, abs(r), "near_perfect_correlation") for n, r in f.corr_with(target).items() if r is not None and abs(r) > 0.95]
    distinct = f.distinct()
    same = [n for n in f.columns if n != target and distinct[n] == distinct[target] and distinct[n] > 0]
    return rows + [(n, 1.0, "one_to_one_mapping") for n in mapped_columns(f, same, target)]


def mapped_columns(f: Facts, cols: list[str], target: str) -> list[str]:
    """Columns whose every value meets at most one target value.

    Pairs of value and target are counted first, then the pairs of every value: hash aggregates, where
    least and greatest texts would have every task sort all its rows."""
    if not cols:
        return []
    y = c(target).cast("string")
    entries = [F.when(c(n).isNotNull(), F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("v"))) for n in cols]
    rows = f.df.select(y.alias("y"), F.explode(F.array(*entries)).alias("e")).where("e is not null and y is not null").select("e.column", "e.v", "y")
    size = sum(f.distinct(cols).values())
    pairs = group_many(rows, ["column", "v", "y"], {"k": (F.count(F.lit(1)), F.sum("k"))}, size)
    seen = group_many(pairs, ["column", "v"], {"k": (F.count(F.lit(1)), F.sum("k"))}, size)
    got = seen.groupBy("column").agg(F.bool_and(F.col("k") == 1).alias("single")).where("single").collect()
    found = {r["column"] for r in got}
    return [n for n in cols if n in found]


def leakage(df, target: str) -> DataFrame:
    f = as_facts(df)
    t = small_table(f.spark, leakage_rows(f, target), [("feature", "string"), ("correlation", "double"), ("reason", "string")])
    return t.select("feature", rounded(F.col("correlation")).alias("correlation"), "reason")


def leakage_with_pairs(df, target: str | None = None) -> DataFrame:
    """Target correlations beyond 0.95 and feature pairs beyond 0.9, with the overall severity."""
    f = as_facts(df)
    target = target or f.columns[-1]
    rows = []
    if target in f.numeric:
        rows += [("target", n, target, r, "CRITICAL") for n, r in f.corr_with(target).items() if r is not None and abs(r) > 0.95]
    features = [n for n in f.numeric if n != target]
    for (a, b), r in f.corr(features).items():
        if r is not None and abs(r) > 0.9:
            rows.append(("pair", a, b, r, "HIGH" if abs(r) > 0.95 else "MODERATE"))
    hit = any(k[0] == "target" for k in rows)
    overall = "CRITICAL" if hit else "HIGH" if len(rows) > 5 else "MODERATE" if rows else "NONE"
    t = small_table(f.spark, [(*r, overall) for r in rows], [
        ("kind", "string"), ("feature_1", "string"), ("feature_2", "string"), ("correlation", "double"), ("severity", "string"), ("overall", "string"),
    ])
    return t.withColumn("correlation", rounded(F.col("correlation")))


def duplicate_columns(df) -> DataFrame:
    """Column pairs of one type that agree in every row.

    A hash sum per column leaves candidate pairs; those are then compared row by row."""
    f = as_facts(df)
    sums = f.df.agg(*[F.sum((F.xxhash64(c(n)) % 1_000_003).cast("bigint")).alias(f"h{i}") for i, n in enumerate(f.columns)]).first()
    pairs = [
        (a, b) for i, a in enumerate(f.columns) for j, b in enumerate(f.columns)
        if i < j and f.types[a] == f.types[b] and sums[f"h{i}"] == sums[f"h{j}"]
    ]
    same = []
    if pairs:
        row = f.df.agg(*[F.count_if(~c(a).eqNullSafe(c(b))).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]).first()
        same = [p for k, p in enumerate(pairs) if row[f"d{k}"] == 0]
    return small_table(f.spark, same, [("feature_1", "string"), ("feature_2", "string")])


# ---- mutual information, F test, signal --------------------------------------------------------

def bin_edges(f: Facts, cols: list[str], bins: int) -> dict[str, list[float]]:
    q = f.quantiles([k / bins for k in range(1, bins)], cols)
    return {n: sorted({v for v in q[n].values() if v is not None}) for n in cols}


def _binned(f: Facts, name: str, edges: dict[str, list[float]]):
    """Quantile bin of a number (edges belong to the lower bin) or the value itself as text."""
    if name in edges:
        return _bin_number(c(name), edges[name]).cast("string")
    return c(name).cast("string")


def _bin_number(x: Column, edges: list[float]) -> Column:
    v = x.cast("double")
    return F.when(v.isNotNull(), sum((F.when(v > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0)))


def mutual_info(df, target: str, cols: list[str] | None = None, bins: int = 10, target_classes: int = 20) -> DataFrame:
    """Plug-in mutual information in nats between each column and the target.

    Numbers with more than ``bins`` values are cut at exact quantiles. All columns share one count
    of (column, bin, class); map-side counting leaves few cells to shuffle."""
    f = as_facts(df)
    cols = [n for n in (cols or f.columns) if n != target and f.kinds[n] != "datetime"]
    distinct = f.distinct([*cols, target])
    cut = [n for n in cols if f.kinds[n] == "numeric" and distinct[n] > bins]
    if f.kinds[target] == "numeric" and distinct[target] > target_classes:
        cut.append(target)
    edges = bin_edges(f, cut, bins)
    base = f.df.where(c(target).isNotNull()).withColumn("__y", _binned(f, target, edges))
    counted = []
    numbers, rest = [n for n in cols if n in edges], [n for n in cols if n not in edges]
    for some in [numbers[k:k + COLUMNS_PER_SCAN] for k in range(0, len(numbers), COLUMNS_PER_SCAN)]:
        # compiled comparisons per column; whole numbers as keys until the cells are counted
        pairs = [x for j, n in enumerate(some) for x in (F.lit(j), _bin_number(c(n), edges[n]))]
        rows = base.select(F.col("__y").alias("y"), F.stack(F.lit(len(some)), *pairs).alias("j", "k")).where("k is not null")
        cells = rows.groupBy("y", "j", "k").agg(F.count(F.lit(1)).alias("n_by"))
        counted.append(cells.select("y", F.array(*[F.lit(n) for n in some])[F.col("j")].alias("feature"), F.col("k").cast("string").alias("b"), "n_by"))
    if rest:
        pairs = [x for n in rest for x in (F.lit(n), c(n).cast("string"))]
        rows = base.select(F.col("__y").alias("y"), F.stack(F.lit(len(rest)), *pairs).alias("feature", "b")).where("b is not null")
        counted.append(rows.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n_by")))
    cells = reduce(DataFrame.unionByName, counted)
    n_b = cells.groupBy("feature", "b").agg(F.sum("n_by").alias("n_b"))
    n_y = cells.groupBy("feature", "y").agg(F.sum("n_by").alias("n_y"))
    n = cells.groupBy("feature").agg(F.sum("n_by").alias("n"))
    # class totals are few; as a broadcast they keep the cells of one class from meeting in one task
    n_y = F.broadcast(n_y) if len(cols) * min(distinct[target], target_classes if target in edges else distinct[target]) <= SMALL_TOTALS else n_y
    full = cells.join(n_b, ["feature", "b"]).join(n_y, ["feature", "y"]).join(F.broadcast(n), "feature")
    term = F.col("n_by") / F.col("n") * F.log(F.col("n_by").cast("double") * F.col("n") / (F.col("n_b").cast("double") * F.col("n_y")))
    return full.groupBy("feature").agg(F.sum(term).alias("mi")).select("feature", rounded(F.greatest(F.col("mi"), F.lit(0.0))).alias("mutual_information"))


def f_test(df, target: str, regression: bool = False) -> DataFrame:
    """F statistic and p-value per numeric column: one-way ANOVA over classes, or the linear
    regression F when the target is continuous."""
    f = as_facts(df)
    cols = [n for n in f.numeric if n != target]
    if regression:
        rs, rows = f.corr_with(target), []
        both = f.df.where(c(target).isNotNull()).agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(cols)]).first() if cols else {}
        for i, name in enumerate(cols):
            n, r = both[f"n{i}"], rs[name]
            if r is not None and abs(r) < 1 and n > 2:
                stat = r * r / (1 - r * r) * (n - 2)
                rows.append((name, stat, f_sf(stat, 1, n - 2)))
        t = small_table(f.spark, rows, [("feature", "string"), ("f_statistic", "double"), ("p_value", "double")])
        return t.select("feature", rounded(F.col("f_statistic"), 2).alias("f_statistic"), rounded(F.col("p_value")).alias("p_value"))
    pairs = [x for i, n in enumerate(cols) for x in (F.lit(i), c(n).cast("double"))]
    y = c(target).cast("string")
    rows = f.df.where(y.isNotNull()).select(y.alias("y"), F.stack(F.lit(len(cols)), *pairs).alias("i", "v")).where("v is not null")
    by = rows.groupBy("i", "y").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    grand = by.groupBy("i").agg(F.sum("n").alias("big_n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    both = by.join(F.broadcast(grand), "i").groupBy("i", "big_n", "k").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"),
    )
    out = []
    for r in both.collect():
        if r["k"] < 2 or r["big_n"] <= r["k"] or not r["within"]:
            continue
        d1, d2 = r["k"] - 1, r["big_n"] - r["k"]
        stat = (r["between"] / d1) / (r["within"] / d2)
        out.append((cols[r["i"]], stat, f_sf(stat, d1, d2)))
    t = small_table(f.spark, out, [("feature", "string"), ("f_statistic", "double"), ("p_value", "double")])
    return t.select("feature", rounded(F.col("f_statistic")).alias("f_statistic"), rounded(F.col("p_value")).alias("p_value"))


def signal_strength(df, target: str) -> DataFrame:
    """Signal in [0, 1]: |r| when both sides are numeric, otherwise mutual information / 0.5."""
    f = as_facts(df)
    cols = [n for n in f.columns if n != target and f.kinds[n] != "datetime"]
    direct = [n for n in cols if f.kinds[n] == "numeric"] if f.kinds[target] == "numeric" else []
    rest = [n for n in cols if n not in direct]
    rows = [(n, abs(r or 0.0)) for n, r in f.corr_with(target, direct).items()] if direct else []
    out = small_table(f.spark, rows, [("feature", "string"), ("signal", "double")])
    if rest:
        mi = mutual_info(f, target, rest).select("feature", F.least(F.col("mutual_information") / 0.5, F.lit(1.0)).alias("signal"))
        out = out.unionByName(mi)
    few = F.lit(f.rows < 10)
    return out.select("feature", rounded(F.when(few, 0.0).otherwise(F.col("signal"))).alias("signal"))


def imbalance_band(r):
    return band(r, [(10, "HIGH"), (5, "MODERATE"), (2, "LOW")], "NONE")


