"""Quality and FAIR scores, sizing facts, comparison and ranking of tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import band, rounded
from tablefit.functions.names import GENERIC_FILES, GENERIC_NAME, SENSITIVE_WORDS
from tablefit.operators.facts import Facts, as_facts, small_table
from tablefit.operators.profile import class_counts
from tablefit.operators.target import choose_target, task_of

SIMPLE_DIMS = ["completeness", "uniqueness", "consistency", "class_balance", "feature_quality", "adequacy"]
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.10, "consistency": 0.20, "class_balance": 0.15, "feature_quality": 0.15, "adequacy": 0.15}


def half_up(x: float, digits: int) -> float:
    """The rounding of ``rounded`` for a driver-side scalar."""
    scale = 10.0 ** digits
    y = abs(x) * scale
    return math.copysign(math.floor(y + 0.5), x) / scale + 0.0


def simple_dimensions(f: Facts, target: str | None) -> dict[str, float]:
    """Six dimensions: completeness, uniqueness, consistency, class balance, feature quality, adequacy."""
    scan, n, k = f.scan(), f.rows, len(f.columns)
    missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100 if n else 0.0
    repeats = f.duplicates() / n * 100 if n else 0.0
    mixed = 0
    for name in f.strings:
        m = scan[name]
        share = m["numberlike"] / m["present"] if m["present"] else 0.0
        mixed += 0.3 < share < 0.8
    balance = 100.0
    if target in f.columns:
        got = class_counts(f.df, target).agg(F.count(F.lit(1)).alias("k"), F.max("cnt").alias("hi"), F.min("cnt").alias("lo")).first()
        if got["k"] >= 2:
            balance = max(0.0, 100 - math.log10(max(got["hi"] / got["lo"], 1)) * 30)
    cols = [c_ for c_ in f.numeric if c_ != target]
    outs = f.outliers(cols)
    rates = [outs[c_][1] / scan[c_]["present"] * 100 for c_ in cols if scan[c_]["present"] > 3]
    rate = sum(rates) / len(rates) if rates else 0.0
    return {
        "completeness": max(0.0, 100 - missing * 2.5), "uniqueness": max(0.0, 100 - repeats * 2), "consistency": max(0.0, 100.0 - mixed * 10),
        "class_balance": balance, "feature_quality": max(0.0, 100 - rate * 3), "adequacy": min(100.0, n / k * 5) if k else 0.0,
    }


def weighted_dimensions(f: Facts, target: str | None = None) -> dict[str, float]:
    scan, n, k = f.scan(), f.rows, len(f.columns)
    target = target or f.columns[-1]
    missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100
    outs = sum((z + o) / 2 for z, o in f.outliers().values()) / n * 100
    got = class_counts(f.df, target).agg(
        F.count(F.lit(1)).alias("k"), F.sum("cnt").cast("double").alias("n"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("ss")
    ).first()
    balance = 100.0
    if got["k"] > 1:
        balance = (1 - got["ss"] / got["n"] ** 2) / (1 - 1 / got["k"]) * 100
    penalty = sum(10 for c_ in f.numeric if scan[c_]["std"] is not None and scan[c_]["std"] < 0.01)
    penalty += sum(5 for r in f.corr().values() if r is not None and abs(r) > 0.95)
    per = n / k
    return {
        "completeness": 100 - missing, "uniqueness": 100 - f.duplicates() / n * 100, "consistency": max(0.0, 100 - outs * 2),
        "class_balance": balance, "feature_quality": max(0.0, 100.0 - penalty),
        "adequacy": 100.0 if per >= 10 else 70.0 if per >= 5 else 40.0 if per >= 2 else 10.0,
    }


def score_of(f: Facts, target: str | None = None, rules: str = "simple") -> tuple[dict[str, float], float]:
    """Rounded dimensions and the overall score."""
    if rules == "simple":
        dims = {d: half_up(v, 1) for d, v in simple_dimensions(f, target).items()}
        return dims, half_up(sum(dims.values()) / len(dims), 1)
    dims = {d: half_up(v, 2) for d, v in weighted_dimensions(f, target).items()}
    return dims, half_up(sum(dims[d] * w for d, w in WEIGHTS.items()), 2)


def quality_score(df, target: str | None = None, rules: str = "simple", grade: bool = False) -> DataFrame:
    """One row: the six dimensions, the overall score and its status (or letter grade)."""
    f = as_facts(df)
    dims, overall = score_of(f, target, rules)
    t = small_table(f.spark, [(*[float(dims[d]) for d in SIMPLE_DIMS], float(overall))], [(d, "double") for d in [*SIMPLE_DIMS, "overall_score"]])
    s = F.col("overall_score")
    if rules == "simple":
        status = band(s, [(90, "Excellent"), (75, "Good"), (60, "Fair")], "Poor")
    else:
        status = band(s, [(85, "Excellent"), (70, "Good"), (50, "Moderate")], "Poor")
    t = t.withColumn("status", status)
    return t.withColumn("grade", letter(s)) if grade else t


def letter(s):
    return band(s, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F")


# ---- FAIR --------------------------------------------------------------------------------------

def sensitive_columns(df) -> list[str]:
    return [n for n in df.columns if any(w in n.lower() for w in SENSITIVE_WORDS)]


def sensitive_scan(df) -> DataFrame:
    """Sensitive attributes by name: one row per column."""
    rows = [(n, n in sensitive_columns(df)) for n in df.columns]
    return small_table(df.sparkSession, rows, [("column", "string"), ("sensitive", "boolean")])


def fair_score(df, rules: str = "simple", file_name: str = "") -> DataFrame:
    """Findable, accessible, interoperable, reusable (0..100 each), their mean and grade."""
    f = as_facts(df)
    scan, n, k = f.scan(), f.rows, len(f.columns)
    unnamed = sum(x.startswith("Unnamed") for x in f.columns)
    if rules == "simple":
        missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100 if n else 0.0
        full = sum(scan[x]["present"] == scan[x]["castable"] for x in f.strings)
        dims = [100 - unnamed * 20, 100 - missing * 2, 100 - full * 10, 100 - len(sensitive_columns(f.df)) * 15]
        dims = [half_up(max(0.0, float(d)), 1) for d in dims]
        overall = half_up(sum(dims) / 4, 1)
        steps, low = [(90, "Fully FAIR"), (75, "Mostly FAIR"), (55, "Partially FAIR")], "Not FAIR"
    else:
        generic = sum(bool(re.match(GENERIC_NAME, x.lower())) for x in f.columns)
        stem = re.sub(r"\.(csv|xlsx)", "", file_name.lower())
        findable = 100 - unnamed * 15 - generic * 10 - (20 if file_name and stem in GENERIC_FILES else 0)
        empty = sum(m["present"] == 0 for m in scan.values())
        sparse = sum(m["missing_share"] > 0.9 for m in scan.values())
        accessible = 100 - empty * 20 - sparse * 10 - (50 if n < 10 else 0)
        odd = sum(bool(re.search(r"[^a-zA-Z0-9_]", x)) for x in f.columns)
        rate = {x: scan[x]["numberlike_any"] / scan[x]["present"] if scan[x]["present"] else 0.0 for x in f.strings}
        interoperable = 100 - odd * 8 - sum(0.2 < r < 0.8 for r in rate.values()) * 10
        short = sum(len(x) <= 2 for x in f.columns)
        distinct = f.distinct(f.strings) if f.strings else {}
        reusable = 100 - (40 if n < 50 else 20 if n < 200 else 0) - (25 if short > k * 0.5 else 0) - sum(v == n for v in distinct.values()) * 10
        dims = [float(max(0, min(100, d))) for d in (findable, accessible, interoperable, reusable)]
        overall = half_up(sum(dims) / 4, 1)
        steps, low = [(85, "FAIR-compliant"), (65, "Partially FAIR"), (40, "Needs improvement")], "Not FAIR"
    t = small_table(f.spark, [(*dims, overall)], [(d, "double") for d in ("findable", "accessible", "interoperable", "reusable", "overall_fair_score")])
    return t.withColumn("fair_grade", band(F.col("overall_fair_score"), steps, low))


# ---- several tables ----------------------------------------------------------------------------

def issue_counts(f: Facts) -> tuple[int, int, int]:
    """(critical, high, moderate) of the quick issue rules."""
    shares = [m["missing_share"] * 100 for m in f.scan().values()]
    unique = sum(v == f.rows for v in f.distinct().values())
    tied = sum(r is not None and abs(r) > 0.95 for r in f.corr().values())
    return sum(s > 60 for s in shares), sum(20 < s <= 60 for s in shares) + unique + min(tied, 3), sum(5 < s <= 20 for s in shares)


def rank_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: score, grade, issue counts, rank (ties share the lowest), percentile and
    distance from the average."""
    rows, spark = [], None
    for name, df in tables.items():
        f = as_facts(df)
        spark = f.spark
        dims, overall = score_of(f, None, "weighted")
        rows.append((name, f.rows, len(f.columns), *[float(dims[d]) for d in SIMPLE_DIMS], float(overall), *issue_counts(f)))
    t = small_table(spark, rows, [
        ("table", "string"), ("rows", "bigint"), ("columns", "bigint"), *[(d, "double") for d in SIMPLE_DIMS], ("overall_score", "double"),
        ("critical", "bigint"), ("high", "bigint"), ("moderate", "bigint"),
    ])
    every = W.partitionBy(F.lit(0))  # one row per compared table
    s = F.col("overall_score")
    rank = F.rank().over(every.orderBy(s.desc()))
    return t.withColumn("grade", letter(s)).withColumn("rank", rank.cast("bigint")).withColumn(
        "percentile", rounded((1 - (F.col("rank") - 1) / F.count(F.lit(1)).over(every)) * 100, 1)
    ).withColumn("vs_average", rounded(s - F.avg(s).over(every), 2))


def rank_insights(ranked: DataFrame) -> DataFrame:
    """Average, spread, best and worst table, weakest and strongest dimension."""
    s = F.col("overall_score")
    means = F.array(*[F.struct(rounded(F.avg(d), 2).alias("v"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(SIMPLE_DIMS)])
    lows = F.array(*[F.struct(rounded(F.avg(d), 2).alias("v"), F.lit(i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(SIMPLE_DIMS)])
    return ranked.agg(
        F.count(F.lit(1)).alias("tables"), rounded(F.avg(s), 2).alias("average_score"), rounded(F.stddev_pop(s), 2).alias("score_std"),
        F.max_by("table", F.struct(s, "table")).alias("best_table"), F.min_by("table", F.struct(s, "table")).alias("worst_table"),
        F.array_max(means)["d"].alias("strongest_dimension"), F.array_min(lows)["d"].alias("weakest_dimension"),
        F.count_if(F.col("grade").isin("A", "B")).alias("ready_tables"), F.sum("critical").alias("critical"), F.sum("high").alias("high"),
        F.sum("moderate").alias("moderate"),
    )


def compare_tables(a, b, target: str | None = None) -> DataFrame:
    """Two tables side by side: one row per dimension and per headline number, with the delta."""
    fa, fb = as_facts(a), as_facts(b)
    rows = []
    sides = []
    for f in (fa, fb):
        y = target if target in f.columns else choose_target(f)
        dims, overall = score_of(f, y, "simple")
        share = sum(m["missing_share"] for m in f.scan().values()) / len(f.columns) * 100
        sides.append({**dims, "overall_score": overall, "missing_percent": share, "rows": float(f.rows), "columns": float(len(f.columns))})
    for key in sides[0]:
        rows.append((key, float(sides[0][key]), float(sides[1][key])))
    shared, union = set(fa.columns) & set(fb.columns), set(fa.columns) | set(fb.columns)
    overlap = len(shared) / max(len(union), 1) * 100
    rows.append(("column_overlap_percent", overlap, overlap))
    t = small_table(fa.spark, rows, [("metric", "string"), ("table_1", "double"), ("table_2", "double")])
    return t.select("metric", rounded(F.col("table_1")).alias("table_1"), rounded(F.col("table_2")).alias("table_2"), rounded(F.col("table_2") - F.col("table_1")).alias("delta"))


def ml_sizing(df, target: str | None = None) -> DataFrame:
    """Facts behind model advice: size class, rows per feature, imbalance, missing share, steps."""
    f = as_facts(df)
    target = target or f.columns[-1]
    task = task_of(f, target)
    got = class_counts(f.df, target).agg(F.max("cnt").alias("hi"), F.min("cnt").alias("lo")).first() if task == "classification" else None
    imbalance = got["hi"] / (got["lo"] + 1e-9) if got and got["lo"] else None
    missing = sum(m["missing_share"] for m in f.scan().values()) / len(f.columns) * 100
    n, k = f.rows, len(f.columns)
    t = small_table(f.spark, [(n, k, n / k, task, imbalance, missing, len(f.numeric), k - len(f.numeric))], [
        ("rows", "bigint"), ("columns", "bigint"), ("per", "double"), ("task", "string"), ("ratio", "double"), ("missing", "double"),
        ("numeric_columns", "bigint"), ("categorical_columns", "bigint"),
    ])
    return t.select(
        "rows", "columns", "task", "numeric_columns", "categorical_columns",
        F.when(F.col("rows") < 1000, "small").when(F.col("rows") < 10000, "medium").otherwise("large").alias("size_category"),
        F.when(F.col("rows") < 500, "small").when(F.col("rows") < 10000, "medium").otherwise("large").alias("size_note"),
        rounded(F.col("per"), 2).alias("rows_per_feature"),
        F.when(F.col("per") < 5, "DANGER").when(F.col("per") < 10, "CAUTION").otherwise("OK").alias("ratio_warning"),
        rounded(F.col("ratio"), 2).alias("imbalance_ratio"),
        F.when(F.col("ratio").isNull(), None).when(F.col("ratio") > 10, "SEVERE").when(F.col("ratio") > 3, "MODERATE").otherwise("NONE").alias("imbalance_severity"),
        rounded(F.col("missing")).alias("missing_percent"), (F.col("missing") > 0).alias("needs_imputation"),
        (F.col("categorical_columns") > 0).alias("needs_encoding"), (F.col("numeric_columns") > 0).alias("needs_scaling"),
        (F.col("per") < 10).alias("needs_selection"),
    )


