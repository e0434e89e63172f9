"""Registered queries: sources, summaries, profiles and suggestions."""

from __future__ import annotations

from queryset.base import Registry, columns_of, corr_sql, facts_sql, numeric_of, over_facts, quote, r4, read, src, t4
from tablefit.functions.exprs import NORMAL_BELOW, NORMAL_TOP
from tablefit.operators import profile as P

REG = Registry()


def _q(fn, name, *args, **kw):
    return lambda spark, sf: fn(read(spark, sf, name), *args, **kw)


def summary_sql(name: str) -> str:
    cols = columns_of(name)
    k = len(cols)
    num = [n for n, x in cols if x in "in"]
    cat = [n for n, x in cols if x in "sb"]
    missing = " + ".join(f"sum(CASE WHEN {quote(n)} IS NULL THEN 1 ELSE 0 END)" for n, _ in cols)
    return (
        f"WITH t AS {src(name)}, d AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM t)), "
        f"s AS (SELECT count(*) AS n, CAST({missing} AS BIGINT) AS m FROM t) "
        f"SELECT n AS rows, CAST({k} AS BIGINT) AS columns, m AS missing_values, {r4(f'm * 100.0 / (n * {k})')} AS missing_percent, "
        f"n - dn AS duplicate_rows, CAST({len(num)} AS BIGINT) AS numeric_columns, CAST({len(cat)} AS BIGINT) AS categorical_columns, "
        f"'{','.join(num)}' AS numeric_names, '{','.join(cat)}' AS categorical_names FROM s, d"
    )


for name in ("orders_dirty", "documents"):
    REG.add(f"table_summary_{name}", _q(P.table_summary, name), summary_sql(name))

for name in ("orders_nulls", "lineitem", "lineitem_skew"):
    REG.add(
        f"profile_numeric_{name}", _q(P.profile_numeric, name),
        over_facts(
            name,
            f"\"column\", missing AS missing_count, {t4('missing * 100.0 / rows')} AS missing_percent, \"distinct\" AS unique_values, "
            f"{t4('\"distinct\" * 1.0 / rows')} AS unique_ratio, {t4('mean')} AS mean, {t4('q50')} AS median, {t4('std')} AS std, {t4('min')} AS min, "
            f"{t4('max')} AS max, {t4('q25')} AS q25, {t4('q75')} AS q75, {t4('skew')} AS skewness, {t4('kurt')} AS kurtosis, zeros AS zero_count, "
            f"negatives AS negative_count, CASE WHEN present < 4 THEN 0 ELSE iqr_outliers END AS outlier_count",
            "kind = 'numeric'",
        ),
    )


def _counts_sql(name: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", CAST({quote(n)} AS VARCHAR) AS value, count(*) AS cnt FROM {src(name)} WHERE {quote(n)} IS NOT NULL GROUP BY ALL" for n in cols
    )


def _categorical_sql(name: str) -> str:
    cols = [n for n, k in columns_of(name) if k in "sb"]
    return (
        f"WITH {facts_sql(name)}, v AS ({_counts_sql(name, cols)}), "
        "w AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY cnt DESC, value) AS rk, cnt * 1.0 / sum(cnt) OVER (PARTITION BY \"column\") AS p FROM v), "
        "e AS (SELECT \"column\", count(*) AS k, sum(-p * log2(p + 1e-10)) AS h, max(value) FILTER (WHERE rk = 1) AS top, max(cnt) AS top_n FROM w GROUP BY 1) "
        f"SELECT e.\"column\", missing AS missing_count, k AS unique_values, top AS top_category, {r4('top_n * 100.0 / rows')} AS top_category_freq, "
        f"{t4('h')} AS category_entropy FROM e JOIN facts USING (\"column\")"
    )


for name, cols in (("events", ["event_type", "props"]), ("orders_dirty", None), ("part_mixed", None)):
    cat = [n for n, k in columns_of(name) if k in "sb"]
    REG.add(f"profile_categorical_{name}", _q(P.profile_categorical, name, cat), _categorical_sql(name))
for name in ("events", "part"):
    cat = [n for n, k in columns_of(name) if k in "sb"]
    REG.add(
        f"value_counts_{name}", _q(P.value_counts, name),
        f"WITH v AS ({_counts_sql(name, cat)}), w AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY cnt DESC, value) AS rank, "
        f"{r4('cnt * 1.0 / sum(cnt) OVER (PARTITION BY \"column\")')} AS share FROM v) SELECT \"column\", value, cnt, share, rank FROM w WHERE rank <= 10",
    )

_role = (
    "CASE WHEN \"distinct\" = rows THEN 'identifier' WHEN ordinal = (SELECT max(ordinal) FROM facts) THEN 'target_candidate' ELSE 'feature' END AS likely_role"
)
for name in ("lineitem_skew", "labels"):
    REG.add(
        f"profile_extended_{name}", _q(P.profile_extended, name),
        over_facts(
            name,
            f"\"column\", {_role}, {r4('max - min')} AS \"range\", {r4('q75 - q25')} AS iqr, {r4('std / (abs(mean) + 1e-9)')} AS coefficient_of_variation, "
            "CASE WHEN abs(skew) < 0.5 THEN 'approximately_normal' WHEN skew > 1.5 THEN 'heavy_right_skew' WHEN skew > 0.5 THEN 'mild_right_skew' "
            "WHEN skew < -1.5 THEN 'heavy_left_skew' ELSE 'mild_left_skew' END AS distribution_shape, iqr_outliers AS iqr_outlier_count, "
            f"{r4('iqr_outliers * 100.0 / rows', 2)} AS iqr_outlier_percent, is_unit AS is_binary, "
            "CASE WHEN is_unit THEN 'none' WHEN std > 50 OR max - min > 100 THEN CASE WHEN iqr_outliers > rows * 0.05 THEN 'RobustScaler' ELSE 'StandardScaler' END "
            "ELSE 'optional' END AS scaling_suggestion, "
            "CASE WHEN abs(skew) > 2 AND min >= 0 THEN 'log1p' WHEN abs(skew) > 1 AND min >= 0 THEN 'sqrt' ELSE 'none' END AS transformation_suggestion",
            "kind = 'numeric' AND present > 0",
        ),
    )
name = "orders_dirty"
REG.add(
    "profile_dominance_orders_dirty", _q(P.profile_dominance, name),
    f"WITH {facts_sql(name)}, v AS ({_counts_sql(name, ['o_orderstatus', 'o_orderpriority', 'memo', 'o_orderdate'])}), "
    "m AS (SELECT \"column\", max(cnt) AS top_n FROM v GROUP BY 1) "
    f"SELECT facts.\"column\", {_role}, {r4('top_n * 100.0 / present', 2)} AS top_category_percent, {r4('\"distinct\" * 1.0 / rows')} AS cardinality_ratio, "
    "CASE WHEN top_n * 1.0 / present > 0.9 THEN 'SEVERE' WHEN top_n * 1.0 / present > 0.8 THEN 'MODERATE' ELSE 'NONE' END AS bias_warning, "
    "CASE WHEN \"distinct\" = 2 THEN 'LabelEncoding' WHEN \"distinct\" <= 10 THEN 'OneHotEncoding' WHEN \"distinct\" <= 50 THEN 'TargetEncoding' ELSE 'HashEncoding' END AS encoding_suggestion "
    "FROM facts JOIN m USING (\"column\")",
)

for name in ("orders_dirty", "lineitem"):
    cols = columns_of(name)
    num = numeric_of(name)
    REG.add(
        f"fast_stats_{name}", _q(P.fast_stats, name),
        f"WITH {facts_sql(name)}, d AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM {src(name)})) "
        f"SELECT max(rows) AS rows, count(*) AS columns, CAST({len(num)} AS BIGINT) AS numeric_columns, CAST({len(cols) - len(num)} AS BIGINT) AS categorical_columns, "
        f"{r4('avg(missing * 1.0 / rows) * 100', 2)} AS missing_percent, {r4('(max(rows) - max(dn)) * 100.0 / max(rows)', 2)} AS duplicate_percent, "
        f"CAST(sum(iqr_outliers) AS BIGINT) AS total_outliers, {r4('sum(iqr_outliers) * 100.0 / max(rows)', 2)} AS outlier_percent FROM facts, d",
    )

REG.add(
    "missing_bands_orders_dirty", _q(P.missing_bands, "orders_dirty"),
    over_facts(
        "orders_dirty",
        f"\"column\", missing AS missing_count, {r4('missing * 100.0 / rows', 2)} AS missing_percent, "
        "CASE WHEN missing = 0 THEN 'none' WHEN missing * 100.0 / rows > 60 THEN 'over_60' WHEN missing * 100.0 / rows > 20 THEN '20_to_60' WHEN missing * 100.0 / rows > 5 THEN '5_to_20' ELSE 'up_to_5' END AS band, "
        "CASE WHEN missing = 0 THEN 'none' WHEN missing * 100.0 / rows > 60 THEN 'drop_column' WHEN missing * 100.0 / rows > 20 THEN 'impute_and_flag' WHEN missing * 100.0 / rows > 5 THEN 'impute' ELSE 'impute_low_priority' END AS action",
    ),
)
_both = "CAST(floor((z_outliers + iqr_outliers) / 2) AS BIGINT)"
REG.add(
    "outliers_dual_lineitem_skew", _q(P.outliers_dual, "lineitem_skew"),
    over_facts(
        "lineitem_skew",
        f"\"column\", z_outliers, iqr_outliers, {_both} AS consensus_outliers, {r4(_both + ' * 100.0 / present', 2)} AS outlier_percent, "
        f"CASE WHEN round({_both} * 100.0 / present, 2) > 10 THEN 'HIGH' WHEN round({_both} * 100.0 / present, 2) > 2 THEN 'MODERATE' WHEN {_both} > 0 THEN 'LOW' ELSE 'NONE' END AS severity",
        "kind = 'numeric'",
    ),
)
REG.add(
    "low_variance_lineitem", _q(P.low_variance, "lineitem"),
    over_facts("lineitem", f"\"column\", {r4('var')} AS variance, {r4('\"distinct\" * 1.0 / present')} AS unique_ratio, var < 0.01 OR \"distinct\" * 1.0 / present < 0.01 AS near_zero_variance", "kind = 'numeric'"),
)


def normality_sql(name):
    """Largest gap between the counted values and the normal distribution, column by column."""
    def poly(coefs):
        out = repr(coefs[0])
        for k in coefs[1:]:
            out = f"({out} * x + {k!r})"
        return out

    tail = f"CASE WHEN x > 37 THEN 0 WHEN x < 7.07106781186547 THEN exp(-x * x / 2) * {poly(NORMAL_TOP)} / {poly(NORMAL_BELOW)} ELSE exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631 END"
    tail_of_t = (
        "CASE WHEN t < 1.18 THEN 1 - sqrt(2 * pi()) / t * (exp(-pi() * pi() / (8 * t * t)) + exp(-9 * pi() * pi() / (8 * t * t)) + exp(-25 * pi() * pi() / (8 * t * t)) + exp(-49 * pi() * pi() / (8 * t * t))) "
        "ELSE (SELECT greatest(0, least(1, 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * t * t)))) FROM range(1, 101) r(j)) END"
    )
    one = lambda n: (
        f"SELECT '{n}' AS \"column\", d, any_n, jb FROM (WITH v AS (SELECT CAST({quote(n)} AS DOUBLE) AS v FROM {src(name)} WHERE {quote(n)} IS NOT NULL), "
        "m AS (SELECT count(*) AS n, avg(v) AS mu, stddev_samp(v) AS sd, count(*) / 6.0 * (skewness(v) ** 2 + kurtosis(v) ** 2 / 4) AS jb FROM v), "
        "k AS (SELECT v, count(*) AS c, sum(count(*)) OVER (ORDER BY v) AS upto FROM v GROUP BY v), "
        f"z AS (SELECT k.*, n, abs((v - mu) / (sd + 1e-9)) AS x, v > mu AS above FROM k, m), p AS (SELECT *, CASE WHEN above THEN 1 - {tail} ELSE {tail} END AS p FROM z) "
        "SELECT max(greatest(upto * 1.0 / n - p, p - (upto - c) * 1.0 / n)) AS d, any_value(n) AS any_n, (SELECT jb FROM m) AS jb FROM p)"
    )
    rows = " UNION ALL ".join(one(n) for n in numeric_of(name))
    return (
        f"SELECT \"column\", {r4('d')} AS ks_statistic, {r4('p')} AS p_value, p > 0.05 AS is_normal, {r4('jb', 2)} AS jarque_bera FROM (SELECT *, {tail_of_t} AS p FROM (SELECT *, (sqrt(any_n) + 0.12 + 0.11 / sqrt(any_n)) * d AS t FROM ({rows})))"
    )


REG.add("normality_lineitem", _q(P.normality, "lineitem_numbers"), normality_sql("lineitem_numbers"))
REG.add("normality_lineitem_all", _q(P.normality, "lineitem"), normality_sql("lineitem"))
REG.add("normality_supplier", _q(P.normality, "supplier"), normality_sql("supplier"))

_types = (
    "CASE WHEN kind = 'datetime' THEN 'datetime' WHEN \"distinct\" * 1.0 / rows > 0.9 AND (regexp_matches(lower(\"column\"), '(^|_)?id$') OR \"column\" IN ({mono})) THEN 'id' "
    "WHEN kind = 'string' AND \"distinct\" * 1.0 / rows > 0.5 AND avg_length > 10 AND spaced * 1.0 / present > 0.5 THEN 'text' WHEN \"distinct\" = 2 THEN 'binary' "
    "WHEN kind <> 'numeric' OR (is_int AND \"distinct\" * 1.0 / rows < 0.05) THEN CASE WHEN \"distinct\" * 1.0 / rows < 0.05 OR \"distinct\" < 15 THEN 'categorical_low' "
    "WHEN \"distinct\" * 1.0 / rows <= 0.3 THEN 'categorical_medium' ELSE 'categorical_high' END "
    "WHEN is_int OR integers = present THEN 'numeric_int' ELSE 'numeric_float' END AS semantic_type"
)
for name, order in (("documents", "doc_id"), ("customer", "c_custkey"), ("conversations", "conv_id"), ("part_mixed", None)):
    mono = "''"
    if order:
        mono = " UNION ALL ".join(
            f"SELECT '{n}' FROM (SELECT x - lag(x) OVER (ORDER BY k) AS d FROM (SELECT CAST({n} AS DOUBLE) AS x, {order} AS k FROM {src(name)})) HAVING NOT (bool_or(d < 0) AND bool_or(d > 0))"
            for n in numeric_of(name)
        ) if name != "conversations" else "SELECT 'conv_id'"
    use = None if name == "conversations" else order
    mono = mono if name != "conversations" else "''"
    REG.add(
        f"semantic_types_{name}", _q(P.semantic_types, name, use),
        over_facts(name, f"\"column\", {_types.format(mono=mono)}, {r4('\"distinct\" * 1.0 / rows')} AS unique_ratio"),
    )
REG.add(
    "numeric_like_rate_part_mixed", _q(P.numeric_like_rate, "part_mixed"),
    over_facts("part_mixed", "\"column\", " + ", ".join(f"{r4(m + ' * 1.0 / present')} AS {m}" for m in ("numberlike", "numberlike_any", "castable")), "kind = 'string'"),
)

_adv_pct = f"round({_both} * 100.0 / present, 2)"
_scaling = {
    "simple": "CASE WHEN abs(skew) > 2 AND negatives = 0 THEN 'log_transform + StandardScaler' WHEN abs(skew) > 2 THEN 'Yeo-Johnson + StandardScaler' WHEN abs(skew) > 1 THEN 'RobustScaler (moderate skew)' ELSE 'StandardScaler' END",
    "strict": "CASE WHEN is_unit OR NOT (std > 1 OR max - min > 10) THEN 'none' WHEN iqr_outliers * 1.0 / present > 0.05 THEN 'RobustScaler' WHEN abs(skew) > 1 THEN 'MinMaxScaler' ELSE 'StandardScaler' END",
    "advice": f"CASE WHEN {_adv_pct} > 2 THEN 'RobustScaler' WHEN std <= 1 THEN 'none' WHEN abs(skew) < 1 THEN 'StandardScaler' ELSE 'MinMaxScaler' END",
}
for rules, sql in _scaling.items():
    REG.add(f"suggest_scaling_{rules}", _q(P.suggest_scaling, "lineitem_skew", rules), over_facts("lineitem_skew", f"\"column\", {sql} AS scaling", "kind = 'numeric'"))
_labels = {
    "simple": ["LabelEncoding", "OneHotEncoding", "OrdinalEncoding or TargetEncoding", "TargetEncoding or Drop"],
    "strict": ["LabelEncoding", "OneHotEncoding", "TargetEncoding", "HashEncoding"],
}
for rules, x in _labels.items():
    REG.add(
        f"suggest_encoding_{rules}", _q(P.suggest_encoding, "part", rules),
        over_facts("part", f"\"column\", \"distinct\" AS unique_values, CASE WHEN \"distinct\" = 2 THEN '{x[0]}' WHEN \"distinct\" <= 10 THEN '{x[1]}' WHEN \"distinct\" <= 50 THEN '{x[2]}' ELSE '{x[3]}' END AS encoding", "kind <> 'numeric'"),
    )
_change = {
    "simple": "CASE WHEN abs(skew) > 2 AND min >= 0 THEN 'log1p' WHEN abs(skew) > 2 THEN 'yeo-johnson' ELSE 'none' END",
    "strict": "CASE WHEN skew > 2 AND min >= 0 THEN 'log1p' WHEN skew < -2 THEN 'reflect_log1p' WHEN abs(skew) > 1 AND abs(skew) <= 2 AND min >= 0 THEN 'sqrt' ELSE 'none' END",
    "advice": "CASE WHEN abs(skew) > 2 AND min >= 0 THEN 'log1p' WHEN abs(skew) > 1 AND min >= 0 THEN 'sqrt' ELSE 'none' END",
}
for rules, sql in _change.items():
    REG.add(f"suggest_transform_{rules}", _q(P.suggest_transform, "lineitem_skew", rules), over_facts("lineitem_skew", f"\"column\", {t4('skew', 3)} AS skewness, {sql} AS transform", "kind = 'numeric'"))
_fill = {
    "simple": "CASE WHEN missing = 0 THEN 'none' WHEN kind = 'numeric' AND abs(skew) > 1 THEN 'median' WHEN kind = 'numeric' THEN 'mean' ELSE 'mode' END",
    "strict": "CASE WHEN missing = 0 THEN 'none' WHEN missing * 1.0 / rows > 0.6 THEN 'drop' WHEN kind = 'numeric' AND abs(skew) > 1 THEN 'median' WHEN kind = 'numeric' THEN 'mean' WHEN \"distinct\" * 1.0 / rows < 0.05 THEN 'mode' ELSE 'constant' END",
}
for rules, sql in _fill.items():
    REG.add(f"suggest_impute_{rules}", _q(P.suggest_impute, "orders_dirty", rules), over_facts("orders_dirty", f"\"column\", {sql} AS strategy"))
REG.add(
    "collinear_lineitem_skew", _q(P.collinear, "lineitem_skew"),
    f"WITH p AS ({corr_sql('lineitem_skew')}) SELECT feature_1 AS \"column\", feature_2 AS partner, {r4('r')} AS correlation FROM p WHERE abs(r) > 0.9 "
    f"UNION ALL SELECT feature_2, feature_1, {r4('r')} FROM p WHERE abs(r) > 0.9",
)


def _classes(name, y):
    return f"SELECT count(*) AS k, CAST(sum(cnt) AS DOUBLE) AS n, max(cnt) AS hi, min(cnt) AS lo, sum(CAST(cnt AS DOUBLE) * cnt) AS ss FROM (SELECT {y}, count(*) AS cnt FROM {src(name)} WHERE {y} IS NOT NULL GROUP BY 1)"


for name, y in (("labels", "toxic"), ("orders_nulls", "o_orderpriority"), ("orders", "o_orderstatus")):
    REG.add(
        f"class_balance_{name}", _q(P.class_balance, name, y),
        f"SELECT k AS classes, hi AS largest, lo AS smallest, {r4('hi * 1.0 / lo')} AS imbalance_ratio, "
        "CASE WHEN hi * 1.0 / lo >= 10 THEN 'HIGH' WHEN hi * 1.0 / lo >= 5 THEN 'MODERATE' WHEN hi * 1.0 / lo >= 2 THEN 'LOW' ELSE 'NONE' END AS simple_band, "
        "hi * 1.0 / lo > 3 AS needs_weights, CASE WHEN hi * 1.0 / lo > 10 THEN 'SEVERE' WHEN hi * 1.0 / lo > 3 THEN 'MODERATE' ELSE 'NONE' END AS advice_band "
        f"FROM ({_classes(name, y)})",
    )
    REG.add(
        f"gini_balance_{name}", _q(P.gini_balance, name, y),
        f"SELECT k AS classes, {r4('CASE WHEN k > 1 THEN (1 - ss / (n * n)) / (1 - 1.0 / k) * 100 ELSE 100 END')} AS balance FROM ({_classes(name, y)})",
    )
