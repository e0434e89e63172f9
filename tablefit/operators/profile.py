"""Profiling operators: summaries, per-column statistics and the suggestions derived from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import band, c, long_numbers, normal_cdf, ratio, rounded, tidy
from tablefit.functions.names import TYPE_ID
from tablefit.functions.pvalues import kolmogorov_sf
from tablefit.functions.ranks import BUCKET_ROWS, MOST_BUCKETS, count_values, running_total, when_map
from tablefit.operators.facts import Facts, as_facts, small_table, top_values


def table_summary(df) -> DataFrame:
    """Rows, columns, missing cells and share, duplicate rows, type counts and lists."""
    f = as_facts(df)
    scan = f.scan()
    missing = sum(m["missing"] for m in scan.values())
    cells = f.rows * len(f.columns)
    row = (
        f.rows, len(f.columns), missing, round(missing / cells * 100, 4) if cells else 0.0, f.duplicates(),
        len(f.numeric), len(f.categorical), ",".join(f.numeric), ",".join(f.categorical),
    )
    return small_table(f.spark, [row], [
        ("rows", "bigint"), ("columns", "bigint"), ("missing_values", "bigint"), ("missing_percent", "double"),
        ("duplicate_rows", "bigint"), ("numeric_columns", "bigint"), ("categorical_columns", "bigint"),
        ("numeric_names", "string"), ("categorical_names", "string"),
    ])


def profile_numeric(df) -> DataFrame:
    """Full numeric profile, one row per numeric column."""
    f = as_facts(df)
    t = f.table("distinct", "quantiles", "outliers").where("kind = 'numeric'")
    return t.select(
        "column", F.col("missing").alias("missing_count"), tidy(ratio(F.col("missing"), F.col("rows")) * 100).alias("missing_percent"),
        F.col("distinct").alias("unique_values"), tidy(ratio(F.col("distinct"), F.col("rows"))).alias("unique_ratio"),
        tidy(F.col("mean")).alias("mean"), tidy(F.col("q50")).alias("median"), tidy(F.col("std")).alias("std"),
        tidy(F.col("min")).alias("min"), tidy(F.col("max")).alias("max"), tidy(F.col("q25")).alias("q25"),
        tidy(F.col("q75")).alias("q75"), tidy(F.col("skew")).alias("skewness"), tidy(F.col("kurt")).alias("kurtosis"),
        F.col("zeros").alias("zero_count"), F.col("negatives").alias("negative_count"),
        F.when(F.col("present") < 4, F.lit(0)).otherwise(F.col("iqr_outliers")).cast("bigint").alias("outlier_count"),
    )


def _shares(f: Facts, cols: list[str]) -> DataFrame:
    """Per column: distinct values and entropies from one value-count shuffle."""
    counted = count_values(f.df, cols)
    scan = f.scan()
    present = F.create_map(*[F.lit(v) for n in cols for v in (n, float(scan[n]["present"]))])
    p = F.col("cnt") / present[F.col("column")]
    return counted.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum(-p * F.log2(p + F.lit(1e-10))).alias("entropy"),
        F.sum(-p * F.log(p)).alias("entropy_nats"), F.max("cnt").alias("top_count"), F.min("cnt").alias("low_count"),
        F.sum(p * p).alias("sum_sq"),
    )


def profile_categorical(df, cols: list[str] | None = None) -> DataFrame:
    """Distinct values, most frequent value and its share of all rows, Shannon entropy in bits."""
    f = as_facts(df)
    cols = cols or [n for n in f.columns if f.kinds[n] != "numeric"]
    scan = f.scan()
    missing = F.create_map(*[F.lit(v) for n in cols for v in (n, scan[n]["missing"])])
    top = top_values(count_values(f.df, cols), 1).select("column", F.col("value").alias("top_category"), "cnt")
    return _shares(f, cols).join(F.broadcast(top), "column").select(
        "column", missing[F.col("column")].cast("bigint").alias("missing_count"), F.col("distinct").alias("unique_values"),
        "top_category", rounded(F.col("cnt") / f.rows * 100).alias("top_category_freq"),
        tidy(F.col("entropy")).alias("category_entropy"),
    )


def value_counts(df, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top-k values per categorical column with their counts and shares of the non-null rows."""
    f = as_facts(df)
    cols = cols or f.categorical
    scan = f.scan()
    present = F.create_map(*[F.lit(v) for n in cols for v in (n, float(scan[n]["present"]))])
    t = top_values(count_values(f.df, cols), k)
    return t.select("column", "value", "cnt", rounded(F.col("cnt") / present[F.col("column")]).alias("share"), F.col("rank").cast("bigint").alias("rank"))


def profile_extended(df) -> DataFrame:
    """Numeric columns: role, spread, shape class, outlier share and the suggestions that follow."""
    f = as_facts(df)
    last = f.columns[-1]
    t = f.table("distinct", "quantiles", "outliers").where("kind = 'numeric' and present > 0")
    spread, skew = F.col("max") - F.col("min"), F.coalesce(F.col("skew"), F.lit(0.0))
    shape = (
        F.when(F.abs(skew) < 0.5, "approximately_normal").when(skew > 1.5, "heavy_right_skew")
        .when(skew > 0.5, "mild_right_skew").when(skew < -1.5, "heavy_left_skew").otherwise("mild_left_skew")
    )
    wide = (F.col("std") > 50) | (spread > 100)
    scaling = (
        F.when(F.col("is_unit"), "none").when(wide & (F.col("iqr_outliers") > F.col("rows") * 0.05), "RobustScaler")
        .when(wide, "StandardScaler").otherwise("optional")
    )
    change = F.when((F.abs(skew) > 2) & (F.col("min") >= 0), "log1p").when((F.abs(skew) > 1) & (F.col("min") >= 0), "sqrt").otherwise("none")
    return t.select(
        "column", _role(last).alias("likely_role"), rounded(spread).alias("range"), rounded(F.col("q75") - F.col("q25")).alias("iqr"),
        rounded(F.col("std") / (F.abs(F.col("mean")) + 1e-9)).alias("coefficient_of_variation"), shape.alias("distribution_shape"),
        F.col("iqr_outliers").alias("iqr_outlier_count"), rounded(F.col("iqr_outliers") / F.col("rows") * 100, 2).alias("iqr_outlier_percent"),
        F.col("is_unit").alias("is_binary"), scaling.alias("scaling_suggestion"), change.alias("transformation_suggestion"),
    )


def _role(last: str):
    return (
        F.when(F.col("distinct") == F.col("rows"), "identifier").when(F.col("column") == last, "target_candidate").otherwise("feature")
    )


def profile_dominance(df) -> DataFrame:
    """Categorical columns: dominance of the top value, cardinality ratio, bias flag."""
    f = as_facts(df)
    cols = [n for n in f.columns if f.kinds[n] != "numeric"]
    scan = f.scan()
    present = F.create_map(*[F.lit(v) for n in cols for v in (n, float(scan[n]["present"]))])
    share = F.col("top_count") / present[F.col("column")]
    return _shares(f, cols).withColumn("rows", F.lit(f.rows)).select(
        "column", _role(f.columns[-1]).alias("likely_role"), rounded(share * 100, 2).alias("top_category_percent"),
        rounded(F.col("distinct") / f.rows).alias("cardinality_ratio"),
        F.when(share > 0.9, "SEVERE").when(share > 0.8, "MODERATE").otherwise("NONE").alias("bias_warning"),
        suggest_encoding_column("advice").alias("encoding_suggestion"),
    )


def fast_stats(df) -> DataFrame:
    """Missing and duplicate percent, total outliers over all numeric columns."""
    f = as_facts(df)
    scan = f.scan()
    n, k = f.rows, len(f.columns)
    total = sum(o for _, o in f.outliers().values())
    missing = sum(m["missing_share"] for m in scan.values()) / k
    row = (n, k, len(f.numeric), k - len(f.numeric), missing * 100, f.duplicates() / n * 100, total, total / n * 100)
    t = small_table(f.spark, [row], [
        ("rows", "bigint"), ("columns", "bigint"), ("numeric_columns", "bigint"), ("categorical_columns", "bigint"),
        ("missing_percent", "double"), ("duplicate_percent", "double"), ("total_outliers", "bigint"), ("outlier_percent", "double"),
    ])
    return t.select(*[rounded(F.col(n), 2).alias(n) if n.endswith("percent") else F.col(n) for n in t.columns])


def missing_bands(df) -> DataFrame:
    """Missing share, its band (0, up to 5, 20, 60, more) and what to do about it."""
    pct = F.round(ratio(F.col("missing"), F.col("rows")) * 100, 2)
    band_of = F.when(pct == 0, "none").when(pct > 60, "over_60").when(pct > 20, "20_to_60").when(pct > 5, "5_to_20").otherwise("up_to_5")
    action = (
        F.when(pct == 0, "none").when(pct > 60, "drop_column").when(pct > 20, "impute_and_flag").when(pct > 5, "impute").otherwise("impute_low_priority")
    )
    return as_facts(df).table().select("column", F.col("missing").alias("missing_count"), rounded(pct, 2).alias("missing_percent"), band_of.alias("band"), action.alias("action"))


def outliers_dual(df) -> DataFrame:
    """|z| > 3 and fence counts, their floored mean, share and severity."""
    t = as_facts(df).table("outliers").where("kind = 'numeric' and present > 0")
    both = F.floor((F.col("z_outliers") + F.col("iqr_outliers")) / 2).cast("bigint")
    pct = F.round(both / F.col("present") * 100, 2)
    severity = F.when(pct > 10, "HIGH").when(pct > 2, "MODERATE").when(both > 0, "LOW").otherwise("NONE")
    return t.select("column", "z_outliers", "iqr_outliers", both.alias("consensus_outliers"), rounded(pct, 2).alias("outlier_percent"), severity.alias("severity"))


def low_variance(df) -> DataFrame:
    """Sample variance, distinct share and the near-zero-variance flag."""
    t = as_facts(df).table("distinct").where("kind = 'numeric' and present > 0")
    share = F.col("distinct") / F.col("present")
    return t.select("column", rounded(F.col("var")).alias("variance"), rounded(share).alias("unique_ratio"), ((F.col("var") < 0.01) | (share < 0.01)).alias("near_zero_variance"))


def normality(df) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test of the standardised column against N(0, 1), any size,
    plus Jarque-Bera from the moments already measured.

    All columns share one job: values are counted and their running totals taken inside value ranges,
    so no column is sorted as a whole. The largest gap lies at a counted value or just below it; the
    p-value is asymptotic with the finite-sample correction of Stephens."""
    f = as_facts(df)
    cols = [n for n in f.numeric if f.scan()[n]["present"] >= 3 and f.scan()[n]["std"]]
    fields = [("column", "string"), ("ks_statistic", "double"), ("p_value", "double"), ("is_normal", "boolean"), ("jarque_bera", "double")]
    if not cols:
        return small_table(f.spark, [], fields)
    m = {n: f.scan()[n] for n in cols}
    counted = long_numbers(f.df, cols).groupBy("i", (F.col("v") + F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    of = lambda get: when_map(F.col("i"), {i: float(get(m[n])) for i, n in enumerate(cols)})
    n = of(lambda x: x["present"])
    p = normal_cdf((F.col("v") - of(lambda x: x["mean"])) / (of(lambda x: x["std"]) + F.lit(1e-9)))
    upto = F.col("cnt_upto")
    gap = F.greatest(upto / n - p, p - (upto - F.col("cnt")) / n)
    got = running_total(counted, ["i"], "v", ["cnt"]).groupBy("i").agg(F.max(gap).alias("d")).collect()
    rows = []
    for r in sorted(got, key=lambda r: r["i"]):
        x = m[cols[r["i"]]]
        root = math.sqrt(x["present"])
        p_value = kolmogorov_sf((root + 0.12 + 0.11 / root) * r["d"])
        rows.append((cols[r["i"]], float(r["d"]), p_value, p_value > 0.05, float(x["present"] / 6 * (x["skew"] ** 2 + (x["kurt"] or 0.0) ** 2 / 4))))
    t = small_table(f.spark, rows, fields)
    return t.select("column", *[rounded(F.col(n)).alias(n) for n in ("ks_statistic", "p_value")], "is_normal", rounded(F.col("jarque_bera"), 2).alias("jarque_bera"))


def semantic_types(df, order_by: str | None = None) -> DataFrame:
    """Semantic column type, first rule that holds: datetime, id, text, binary, categorical by
    cardinality, numeric. The monotonic test looks at row order, so it needs ``order_by``."""
    f = as_facts(df)
    t = f.table("distinct")
    sorted_cols = monotonic_columns(f, order_by) if order_by else []
    share = F.col("distinct") / F.greatest(F.col("rows"), F.lit(1))
    named = F.lower("column").rlike(TYPE_ID)
    ordered = F.col("column").isin(sorted_cols) if sorted_cols else F.lit(False)
    textual = (share > 0.5) & (F.col("avg_length") > 10) & (ratio(F.col("spaced"), F.col("present")) > 0.5)
    numeric = F.col("kind") == "numeric"
    kind = (
        F.when(F.col("kind") == "datetime", "datetime").when((share > 0.9) & (named | ordered), "id")
        .when((F.col("kind") == "string") & textual, "text").when(F.col("distinct") == 2, "binary")
        .when(
            ~numeric | (F.col("is_int") & (share < 0.05)),
            F.when((share < 0.05) | (F.col("distinct") < 15), "categorical_low").when(share <= 0.3, "categorical_medium").otherwise("categorical_high"),
        )
        .when(F.col("is_int") | (F.col("integers") == F.col("present")), "numeric_int").otherwise("numeric_float")
    )
    return t.select("column", kind.alias("semantic_type"), rounded(share).alias("unique_ratio"))


def monotonic_columns(df, order_by: str) -> list[str]:
    """Numeric columns that never fall (or never rise) along ``order_by``.

    Distributed without a global sort: rows are cut into ranges of the order column; inside a
    range neighbours are compared, between ranges only first and last values are.
    """
    f = as_facts(df)
    cols = [n for n in f.numeric]
    parts = max(64, min(MOST_BUCKETS, f.rows // BUCKET_ROWS))
    edges = f.df.select(F.percentile_approx(c(order_by).cast("double"), [k / parts for k in range(1, parts)], 16 * parts)).first()[0]
    literal = F.array(*[F.lit(e) for e in sorted(set(edges))])
    placed = f.df.withColumn("__b", F.size(F.filter(literal, lambda e: e < c(order_by).cast("double"))))
    inside = W.partitionBy("__b").orderBy(c(order_by))
    seen = inside.rowsBetween(W.unboundedPreceding, -1)  # the last value present before this row
    steps = placed.select("__b", c(order_by).alias("__o"), *[
        x for i, n in enumerate(cols)
        for x in (c(n).alias(f"v{i}"), (c(n) - F.last(c(n), ignorenulls=True).over(seen)).alias(f"d{i}"))
    ])
    parts = steps.groupBy("__b").agg(*[
        x for i in range(len(cols)) for x in (
            F.coalesce(F.bool_or(F.col(f"d{i}") < 0), F.lit(False)).alias(f"falls{i}"), F.coalesce(F.bool_or(F.col(f"d{i}") > 0), F.lit(False)).alias(f"rises{i}"),
            F.min_by(F.col(f"v{i}"), F.when(F.col(f"v{i}").isNotNull(), F.col("__o"))).alias(f"first{i}"),
            F.max_by(F.col(f"v{i}"), F.when(F.col(f"v{i}").isNotNull(), F.col("__o"))).alias(f"last{i}"), F.count(f"v{i}").alias(f"n{i}"),
        )
    ]).orderBy("__b").collect()
    out = []
    for i, name in enumerate(cols):
        filled = [r for r in parts if r[f"n{i}"]]
        if sum(r[f"n{i}"] for r in filled) < 2:
            continue
        falls, rises = any(r[f"falls{i}"] for r in filled), any(r[f"rises{i}"] for r in filled)
        for a, b in zip(filled, filled[1:]):
            falls = falls or b[f"first{i}"] < a[f"last{i}"]
            rises = rises or b[f"first{i}"] > a[f"last{i}"]
        if not (falls and rises):
            out.append(name)
    return out


def numeric_like_rate(df) -> DataFrame:
    """Share of number-like texts per string column, three readings of number-like."""
    t = as_facts(df).table().where("kind = 'string' and present > 0")
    return t.select("column", *[rounded(F.col(m) / F.col("present")).alias(m) for m in ("numberlike", "numberlike_any", "castable")])


# ---- suggestions -------------------------------------------------------------------------------

def suggest_scaling_column(rules: str):
    skew = F.abs(F.coalesce(F.col("skew"), F.lit(0.0)))
    if rules == "simple":
        skew = F.when(F.col("present") > 3, skew).otherwise(0.0)
        return (
            F.when((skew > 2) & (F.col("negatives") == 0), "log_transform + StandardScaler")
            .when(skew > 2, "Yeo-Johnson + StandardScaler").when(skew > 1, "RobustScaler (moderate skew)").otherwise("StandardScaler")
        )
    if rules == "strict":
        useful = ~F.col("is_unit") & ((F.col("std") > 1.0) | (F.col("max") - F.col("min") > 10))
        heavy = F.col("iqr_outliers") / F.col("present") > 0.05
        return F.when(~useful, "none").when(heavy, "RobustScaler").when(skew > 1, "MinMaxScaler").otherwise("StandardScaler")
    pct = F.round(F.floor((F.col("z_outliers") + F.col("iqr_outliers")) / 2) / F.col("present") * 100, 2)  # rules == "advice"
    return F.when(pct > 2, "RobustScaler").when(F.col("std") <= 1, "none").when(skew < 1, "StandardScaler").otherwise("MinMaxScaler")


def suggest_encoding_column(rules: str):
    k = F.col("distinct")
    if rules == "simple":
        steps = ["LabelEncoding", "OneHotEncoding", "OrdinalEncoding or TargetEncoding", "TargetEncoding or Drop"]
    elif rules == "plan":
        steps = ["LabelEncoding", "OneHotEncoding", "OrdinalEncoding", "drop"]
    else:
        steps = ["LabelEncoding", "OneHotEncoding", "TargetEncoding", "HashEncoding"]
    return F.when(k == 2, steps[0]).when(k <= 10, steps[1]).when(k <= 50, steps[2]).otherwise(steps[3])


def suggest_transform_column(rules: str):
    skew, low = F.coalesce(F.col("skew"), F.lit(0.0)), F.col("min") >= 0
    if rules == "simple":
        return F.when((F.abs(skew) > 2) & low, "log1p").when(F.abs(skew) > 2, "yeo-johnson").otherwise("none")
    if rules == "strict":
        return (
            F.when((skew > 2) & low, "log1p").when(skew < -2, "reflect_log1p")
            .when((F.abs(skew) > 1) & (F.abs(skew) <= 2) & low, "sqrt").otherwise("none")
        )
    return F.when((F.abs(skew) > 2) & low, "log1p").when((F.abs(skew) > 1) & low, "sqrt").otherwise("none")


def suggest_impute_column(rules: str):
    skew = F.abs(F.coalesce(F.col("skew"), F.lit(0.0)))
    share = F.col("missing") / F.col("rows")
    numeric = F.col("kind") == "numeric"
    if rules == "simple":
        how = F.when(numeric & (skew > 1), "median").when(numeric, "mean").otherwise("mode")
        return F.when(share == 0, "none").otherwise(how)
    how = (
        F.when(share > 0.6, "drop").when(numeric & (skew > 1), "median").when(numeric, "mean")
        .when(F.col("distinct") / F.col("rows") < 0.05, "mode").otherwise("constant")
    )
    return F.when(share == 0, "none").otherwise(how)


def suggest_scaling(df, rules: str = "simple") -> DataFrame:
    return as_facts(df).table("outliers").where("kind = 'numeric' and present > 0").select("column", suggest_scaling_column(rules).alias("scaling"))


def suggest_encoding(df, rules: str = "simple") -> DataFrame:
    return as_facts(df).table("distinct").where("kind <> 'numeric'").select("column", F.col("distinct").alias("unique_values"), suggest_encoding_column(rules).alias("encoding"))


def suggest_transform(df, rules: str = "strict") -> DataFrame:
    t = as_facts(df).table().where("kind = 'numeric' and present > 0")
    return t.select("column", rounded(F.coalesce(F.col("skew"), F.lit(0.0)), 3).alias("skewness"), suggest_transform_column(rules).alias("transform"))


def suggest_impute(df, rules: str = "strict") -> DataFrame:
    return as_facts(df).table("distinct").select("column", suggest_impute_column(rules).alias("strategy"))


def collinear(df, threshold: float = 0.9) -> DataFrame:
    """Per column: the partners it is correlated with beyond the threshold."""
    f = as_facts(df)
    rows = [(x, y, r) for (a, b), r in f.corr().items() if r is not None and abs(r) > threshold for x, y in ((a, b), (b, a))]
    t = small_table(f.spark, rows, [("column", "string"), ("partner", "string"), ("correlation", "double")])
    return t.select("column", "partner", rounded(F.col("correlation")).alias("correlation"))


# ---- class balance -----------------------------------------------------------------------------

def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(c(target).isNotNull()).groupBy(c(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("cnt"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Imbalance ratio largest/smallest class with the bands of the three rule sets."""
    t = class_counts(df, target).agg(F.count(F.lit(1)).alias("classes"), F.max("cnt").alias("largest"), F.min("cnt").alias("smallest"))
    r = ratio(F.col("largest"), F.col("smallest"))
    return t.select(
        "classes", "largest", "smallest", rounded(r).alias("imbalance_ratio"),
        band(r, [(10, "HIGH"), (5, "MODERATE"), (2, "LOW")], "NONE").alias("simple_band"),
        (r > 3).alias("needs_weights"), band(r, [(10, "SEVERE"), (3, "MODERATE")], "NONE", strict=True).alias("advice_band"),
    )


def gini_balance(df: DataFrame, target: str) -> DataFrame:
    """Gini impurity of the classes as a percentage of its maximum."""
    t = class_counts(df, target).agg(F.count(F.lit(1)).alias("k"), F.sum("cnt").alias("n"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("ss"))
    gini = 1 - F.col("ss") / (F.col("n").cast("double") * F.col("n"))
    most = 1 - 1 / F.col("k")
    return t.select(F.col("k").alias("classes"), rounded(F.when(F.col("k") > 1, gini / F.nullif(most, F.lit(0.0)) * 100).otherwise(100.0)).alias("balance"))
