"""Registered queries: correlation, leakage, statistics, target, quality, issues."""

from __future__ import annotations

from queryset.base import Registry, columns_of, corr_sql, facts_sql, numeric_of, over_facts, quote, r4, read, src
from queryset.profiling import _q
from tablefit.functions import names as N
from tablefit.operators import anomaly as A
from tablefit.operators import issues as I
from tablefit.operators import quality as Q
from tablefit.operators import relate as R
from tablefit.operators import target as T

REG = Registry()

for name in ("lineitem", "lineitem_skew"):
    REG.add(
        f"corr_pairs_{name}", _q(R.corr_pairs, name),
        f"SELECT feature_1, feature_2, {r4('r')} AS pearson, CASE WHEN abs(r) > 0.95 THEN 'CRITICAL' WHEN abs(r) > 0.85 THEN 'HIGH' ELSE 'MODERATE' END AS severity "
        f"FROM ({corr_sql(name)}) WHERE abs(r) > 0.75",
    )
    REG.add(
        f"corr_all_{name}", _q(R.corr_pairs, name, -1.0),
        f"SELECT feature_1, feature_2, {r4('r')} AS pearson, CASE WHEN abs(r) > 0.95 THEN 'CRITICAL' WHEN abs(r) > 0.85 THEN 'HIGH' ELSE 'MODERATE' END AS severity "
        f"FROM ({corr_sql(name)}) WHERE r IS NOT NULL",
    )


def _rank_sql(name, a, b):
    avg = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return f"SELECT corr({avg('x')}, {avg('y')}) AS s FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src(name)}) WHERE x IS NOT NULL AND y IS NOT NULL"


def _spearman_sql(name):
    cols = numeric_of(name)
    # the window must be evaluated before corr
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append(
                f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r4('corr(rx, ry)')} AS spearman FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
                f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src(name)}) "
                "WHERE x IS NOT NULL AND y IS NOT NULL)"
            )
    return " UNION ALL ".join(out)


for name in ("part", "orders_nulls", "lineitem_numbers"):
    REG.add(f"spearman_pairs_{name}", _q(R.spearman_pairs, name), _spearman_sql(name))


def kendall_part(spark, sf):
    from tablefit.operators.facts import small_table
    from pyspark.sql import functions as F
    from tablefit.functions.exprs import rounded

    df = read(spark, sf, "part")
    t = small_table(spark, [("p_size", "p_retailprice", R.kendall(df, "p_size", "p_retailprice"))], [("feature_1", "string"), ("feature_2", "string"), ("kendall", "double")])
    return t.withColumn("kendall", rounded(F.col("kendall"), 6))


REG.add(
    "kendall_part", kendall_part,
    "WITH t AS (SELECT p_size AS x, p_retailprice AS y FROM part), "
    "p AS (SELECT sum(CAST(sign(a.x - b.x) * sign(a.y - b.y) AS DOUBLE)) / 2 AS s, sum(CASE WHEN a.x <> b.x THEN 1.0 ELSE 0 END) / 2 AS dx, sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END) / 2 AS dy FROM t a, t b) "
    f"SELECT 'p_size' AS feature_1, 'p_retailprice' AS feature_2, {r4('s / sqrt(dx * dy)', 6)} AS kendall FROM p",
)
REG.add("corr_methods_lineitem_skew", _q(R.corr_methods, "SELECT l_quantity, l_extendedprice, l_extendedprice * l_extendedprice AS price_sq, -l_quantity AS negated FROM {lineitem}"))
_part_nulls = (
    "SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 3 + p_partkey % 3 END AS noisy, CASE WHEN p_partkey % 5 <> 0 THEN -p_size * p_size END AS mirrored, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price FROM {part}"
)
_part_cols = ["size", "noisy", "mirrored", "price"]
_part_pairs = [(a, b) for i, a in enumerate(_part_cols) for b in _part_cols[i + 1:]]


def rank_pair_sql(a, b):
    """Pearson, Spearman and Kendall of two columns over the rows where both are present."""
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return (
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, * FROM (WITH t AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src(_part_nulls)} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), "
        f"k AS (SELECT x, y, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT sum(CAST(sign(p.x - q.x) * sign(p.y - q.y) AS DOUBLE) * p.n * q.n) AS s, sum(CASE WHEN p.x <> q.x THEN p.n * q.n * 1.0 ELSE 0 END) AS dx, sum(CASE WHEN p.y <> q.y THEN p.n * q.n * 1.0 ELSE 0 END) AS dy FROM k p, k q) "
        f"SELECT (SELECT corr(x, y) FROM t) AS pearson, (SELECT corr(rx, ry) FROM (SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM t)) AS spearman, s / sqrt(dx * dy) AS kendall, "
        f"(SELECT var_samp(CAST({a} AS DOUBLE)) FROM {src(_part_nulls)}) AS va, (SELECT var_samp(CAST({b} AS DOUBLE)) FROM {src(_part_nulls)}) AS vb FROM g)"
    )


_three = " UNION ALL ".join(rank_pair_sql(a, b) for a, b in _part_pairs)
REG.add("spearman_pairs_part_nulls", _q(R.spearman_pairs, _part_nulls), f"SELECT feature_1, feature_2, {r4('spearman')} AS spearman FROM ({_three})")
REG.add(
    "corr_methods_part_nulls", _q(R.corr_methods, _part_nulls),
    f"SELECT feature_1, feature_2, {r4('pearson')} AS pearson, {r4('spearman')} AS spearman, {r4('kendall')} AS kendall, CASE WHEN abs(pearson) > 0.95 THEN 'CRITICAL' WHEN abs(pearson) > 0.9 THEN 'HIGH' ELSE 'MODERATE' END AS severity, "
    f"abs(spearman) > 0.8 AND abs(kendall) > 0.8 AS all_methods_agree, CASE WHEN va < vb THEN feature_1 ELSE feature_2 END AS drop_suggestion FROM ({_three}) WHERE abs(pearson) > 0.8",
)

for name, y in (("part", "p_retailprice"), ("lineitem_skew", "l_extendedprice"), ("orders_nulls", "o_totalprice")):
    REG.add(
        f"target_corr_{name}", _q(R.target_corr, name, y),
        f"SELECT CASE WHEN feature_1 = '{y}' THEN feature_2 ELSE feature_1 END AS feature, {r4('coalesce(r, 0)')} AS correlation FROM ({corr_sql(name)}) WHERE '{y}' IN (feature_1, feature_2)",
    )


def leak_sql(name, y):
    out = []
    y_num = y in numeric_of(name)
    for n, k in columns_of(name):
        if n == y:
            continue
        if y_num and k in "in":
            out.append(f"SELECT '{n}' AS feature, abs(corr({n}, {y})) AS r, 'near_perfect_correlation' AS reason FROM {src(name)} HAVING abs(corr({n}, {y})) > 0.95")
        out.append(
            f"SELECT '{n}' AS feature, 1.0 AS r, 'one_to_one_mapping' AS reason FROM (SELECT {n}, count(DISTINCT {y}) AS k FROM {src(name)} WHERE {n} IS NOT NULL GROUP BY 1) "
            f"HAVING max(k) = 1 AND (SELECT count(DISTINCT {n}) = count(DISTINCT {y}) FROM {src(name)})"
        )
    return " UNION ALL ".join(out)


for name, y in (("nation_region", "r_name"), ("lineitem_skew", "l_extendedprice"), ("orders", "o_totalprice")):
    REG.add(f"leakage_{name}", _q(R.leakage, name, y), f"SELECT feature, {r4('r')} AS correlation, reason FROM ({leak_sql(name, y)})")
y = "l_discount"
_lp = (
    f"WITH p AS ({corr_sql('lineitem_skew')}), k AS (SELECT 'target' AS kind, CASE WHEN feature_1 = '{{y}}' THEN feature_2 ELSE feature_1 END AS feature_1, '{{y}}' AS feature_2, r, 'CRITICAL' AS severity "
    "FROM p WHERE '{y}' IN (feature_1, feature_2) AND abs(r) > 0.95 UNION ALL SELECT 'pair', feature_1, feature_2, r, CASE WHEN abs(r) > 0.95 THEN 'HIGH' ELSE 'MODERATE' END FROM p "
    "WHERE '{y}' NOT IN (feature_1, feature_2) AND abs(r) > 0.9) "
    f"SELECT kind, feature_1, feature_2, {r4('r')} AS correlation, severity, CASE WHEN (SELECT count(*) FROM k WHERE kind = 'target') > 0 THEN 'CRITICAL' "
    "WHEN (SELECT count(*) FROM k) > 5 THEN 'HIGH' WHEN (SELECT count(*) FROM k) > 0 THEN 'MODERATE' ELSE 'NONE' END AS overall FROM k"
)
REG.add("leakage_with_pairs_lineitem_skew", _q(R.leakage_with_pairs, "lineitem_skew", "price_copy"), _lp.replace("{y}", "price_copy"))
_dup = "SELECT l_quantity, l_tax, l_quantity + 0.0 AS quantity_again, l_returnflag, l_returnflag AS flag_again, l_linenumber FROM {lineitem}"
REG.add(
    "duplicate_columns_lineitem", _q(R.duplicate_columns, _dup.replace("+ 0.0", "* CAST(1 AS DOUBLE)")),
    "SELECT * FROM (VALUES ('l_quantity', 'quantity_again'), ('l_returnflag', 'flag_again')) t(feature_1, feature_2) WHERE (SELECT count(*) FROM lineitem WHERE l_quantity IS DISTINCT FROM l_quantity * CAST(1 AS DOUBLE)) = 0",
)


def mi_sql(name, y, bins=10):
    """Plug-in mutual information; numbers with more distinct values than bins are cut at quantiles."""
    out = []
    for n, k in columns_of(name):
        if n == y or k == "d":
            continue
        if k in "in":
            qs = ", ".join(str(i / bins) for i in range(1, bins))
            b = (
                f"(SELECT {y} AS y, CASE WHEN (SELECT count(DISTINCT {n}) FROM {src(name)}) > {bins} THEN CAST(len(list_filter(list_distinct((SELECT quantile_cont(CAST({n} AS DOUBLE), [{qs}]) FROM {src(name)})), lambda e: e < {n})) AS VARCHAR) "
                f"ELSE CAST({n} AS VARCHAR) END AS b FROM {src(name)} WHERE {n} IS NOT NULL AND {y} IS NOT NULL)"
            )
        else:
            b = f"(SELECT {y} AS y, CAST({n} AS VARCHAR) AS b FROM {src(name)} WHERE {n} IS NOT NULL AND {y} IS NOT NULL)"
        out.append(
            f"SELECT '{n}' AS feature, {r4('greatest(sum(p * ln(p / (pb * py))), 0)')} AS mutual_information FROM (SELECT n * 1.0 / sum(n) OVER () AS p, "
            f"sum(n) OVER (PARTITION BY b) * 1.0 / sum(n) OVER () AS pb, sum(n) OVER (PARTITION BY y) * 1.0 / sum(n) OVER () AS py FROM (SELECT b, y, count(*) AS n FROM {b} GROUP BY ALL))"
        )
    return " UNION ALL ".join(out)


for name, y in (("documents_labels", "quality"), ("lineitem", "l_returnflag")):
    REG.add(f"mutual_info_{name}", _q(R.mutual_info, name, y), mi_sql(name, y))


def f_sql(name, y):
    out = []
    for n in numeric_of(name):
        if n == y:
            continue
        out.append(
            f"SELECT '{n}' AS feature, (sum(c * (m - g) * (m - g)) / (count(*) - 1)) / (sum(c * v) / (sum(c) - count(*))) AS f FROM (SELECT {y}, count({n}) AS c, avg({n}) AS m, var_pop({n}) AS v FROM {src(name)} "
            f"WHERE {n} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1), (SELECT avg({n}) AS g FROM {src(name)} WHERE {n} IS NOT NULL AND {y} IS NOT NULL)"
        )
    return f"SELECT feature, {r4('f')} AS f_statistic FROM ({' UNION ALL '.join(out)})"


for name, y in (("lineitem", "l_returnflag"), ("orders_nulls", "o_orderpriority"), ("documents_labels", "quality")):
    REG.add(f"f_test_{name}", lambda spark, sf, name=name, y=y: R.f_test(read(spark, sf, name), y).drop("p_value"), f_sql(name, y))
REG.add("f_test_p_values_part", _q(R.f_test, "part", "p_type"))
REG.add(
    "f_regression_part", lambda spark, sf: R.f_test(read(spark, sf, "part"), "p_retailprice", True).drop("p_value"),
    "SELECT CASE WHEN feature_1 = 'p_retailprice' THEN feature_2 ELSE feature_1 END AS feature, "
    f"{r4('r * r / (1 - r * r) * ((SELECT count(*) FROM part) - 2)', 2)} AS f_statistic FROM ({corr_sql('part')}) WHERE 'p_retailprice' IN (feature_1, feature_2)",
)
_both = "o_totalprice IS NOT NULL"
_reg_f = lambda n: f"SELECT '{n}' AS feature, r * r / (1 - r * r) * (n - 2) AS f FROM (SELECT corr({n}, o_totalprice) AS r, count(*) AS n FROM {src('orders_nulls')} WHERE {n} IS NOT NULL AND {_both})"
REG.add(
    "f_regression_orders_nulls", lambda spark, sf: R.f_test(read(spark, sf, "orders_nulls"), "o_totalprice", True).drop("p_value"),
    f"SELECT feature, {r4('f', 2)} AS f_statistic FROM ({_reg_f('o_orderkey')} UNION ALL {_reg_f('o_custkey')})",
)
REG.add(
    "signal_strength_documents_labels", _q(R.signal_strength, "documents_labels", "quality"),
    f"SELECT CASE WHEN feature_1 = 'quality' THEN feature_2 ELSE feature_1 END AS feature, {r4('abs(coalesce(r, 0))')} AS signal FROM ({corr_sql('documents_labels')}) WHERE 'quality' IN (feature_1, feature_2) "
    f"UNION ALL SELECT feature, {r4('least(mutual_information / 0.5, 1)')} FROM ({mi_sql('documents_labels', 'quality')}) WHERE feature IN ('lang', 'source')",
)

# ---- target ----------------------------------------------------------------------------------
_words = ", ".join(f"('{w}')" for w in N.TARGET_WORDS)


def target_score_sql(name):
    return (
        f"{facts_sql(name)}, words AS (SELECT * FROM (VALUES {_words}) w(w)), "
        "points AS (SELECT \"column\", sum(CASE WHEN lower(\"column\") = w THEN 0.6 WHEN contains(lower(\"column\"), w) THEN 0.3 ELSE 0 END) AS pts FROM facts, words GROUP BY 1), "
        "scored AS (SELECT ordinal, \"column\", \"distinct\", kind, "
        + r4(
            "pts + CASE WHEN ordinal = (SELECT max(ordinal) FROM facts) THEN 0.2 ELSE 0 END + CASE WHEN \"distinct\" = 2 THEN 0.25 ELSE 0 END + CASE WHEN \"distinct\" BETWEEN 2 AND 20 THEN 0.15 ELSE 0 END "
            "+ CASE WHEN kind = 'numeric' AND \"distinct\" > 20 THEN 0.05 ELSE 0 END - CASE WHEN \"distinct\" = rows THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(lower(\"column\"), '^id$|_id$|^index$|^row') THEN 0.4 ELSE 0 END", 3,
        )
        + " AS score FROM facts JOIN points USING (\"column\"))"
    )


_task = "CASE WHEN \"distinct\" = 2 THEN 'classification_binary' WHEN \"distinct\" <= 20 THEN 'classification_multiclass' ELSE 'regression' END"
for name in ("labels", "orders_dirty", "documents"):
    REG.add(
        f"detect_target_{name}", _q(T.detect_target, name),
        f"WITH {target_score_sql(name)}, best AS (SELECT * FROM scored ORDER BY score DESC, ordinal LIMIT 1), "
        "pick AS (SELECT * FROM best WHERE score > 0 UNION ALL SELECT ordinal, \"column\", \"distinct\", kind, 0.3 FROM scored WHERE ordinal = (SELECT max(ordinal) FROM scored) AND (SELECT score FROM best) <= 0) "
        f"SELECT \"column\" AS target, CAST(score AS DOUBLE) AS score, {_task} AS task_type, score < 0.4 AS low_confidence FROM pick",
    )
    REG.add(f"target_scores_{name}", lambda spark, sf, name=name: T.target_scores(read(spark, sf, name)).select("column", "score"), f"WITH {target_score_sql(name)} SELECT \"column\", score FROM scored")
_ent_words = ", ".join(f"'{w}'" for w in N.TARGET_WORDS_ENTROPY)
_id_words = ", ".join(f"'{w}'" for w in N.ID_WORDS_ENTROPY)


def entropy_target_sql(name):
    ent = " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS h FROM (SELECT count(*) * 1.0 / sum(count(*)) OVER () AS p FROM {src(name)} WHERE {quote(n)} IS NOT NULL GROUP BY {quote(n)})"
        for n, _ in columns_of(name)
    )
    return (
        f"WITH {facts_sql(name)}, e AS ({ent}), s AS (SELECT \"column\", ordinal, CASE WHEN list_any_value(list_filter([{_id_words}], lambda w: contains(lower(\"column\"), w))) IS NOT NULL THEN -10.0 "
        f"WHEN \"distinct\" * 1.0 / rows > 0.95 THEN -8.0 ELSE CASE WHEN list_contains([{_ent_words}], lower(\"column\")) THEN 5 WHEN len(list_filter([{_ent_words}], lambda w: contains(lower(\"column\"), w))) > 0 THEN 3 ELSE 0 END "
        "+ CASE WHEN kind = 'string' OR \"distinct\" <= 10 THEN 3 ELSE 2 END + CASE WHEN h > 0.2 AND h < 0.8 THEN 1.5 ELSE 0 END - CASE WHEN h > 0.95 THEN 1 ELSE 0 END - missing * 3.0 / rows END AS score "
        "FROM facts JOIN e USING (\"column\")), x AS (SELECT *, exp(score - max(score) OVER ()) AS ex FROM s) "
        f"SELECT \"column\", {r4('score', 2)} AS score, {r4('ex / sum(ex) OVER ()', 3)} AS confidence, row_number() OVER (ORDER BY score DESC, ordinal) AS rank FROM x"
    )


for name in ("labels", "orders_dirty", "part"):
    REG.add(f"detect_target_entropy_{name}", _q(T.detect_target_entropy, name), entropy_target_sql(name))
REG.add(
    "task_types_part", _q(T.task_types, "part"),
    over_facts("part", f"\"column\", {_task} AS simple_task, CASE WHEN kind IN ('string', 'boolean') OR \"distinct\" <= 15 THEN 'classification' ELSE 'regression' END AS strict_task"),
)

# ---- quality -----------------------------------------------------------------------------------


def _class_ratio(name, y):
    return f"(SELECT count(*) AS k, max(cnt) * 1.0 / min(cnt) AS r, sum(cnt) AS cn, sum(CAST(cnt AS DOUBLE) * cnt) AS ss FROM (SELECT {y}, count(*) AS cnt FROM {src(name)} WHERE {y} IS NOT NULL GROUP BY 1))"


def simple_quality_cte(name, y):
    return (
        f"{facts_sql(name)}, dd AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM {src(name)})), cb AS {_class_ratio(name, y)}, "
        "a AS (SELECT max(rows) AS n, count(*) AS k, sum(missing) * 100.0 / (max(rows) * count(*)) AS miss, "
        "count(*) FILTER (WHERE kind = 'string' AND present > 0 AND numberlike * 1.0 / present > 0.3 AND numberlike * 1.0 / present < 0.8) AS mixed, "
        f"coalesce(avg(iqr_outliers * 100.0 / present) FILTER (WHERE kind = 'numeric' AND \"column\" <> '{y}' AND present > 3), 0) AS outp FROM facts), "
        f"dims AS (SELECT {r4('greatest(0, 100 - miss * 2.5)', 1)} AS completeness, {r4('greatest(0, 100 - (a.n - dn) * 200.0 / a.n)', 1)} AS uniqueness, {r4('greatest(0, 100 - mixed * 10)', 1)} AS consistency, "
        f"{r4('CASE WHEN cb.k >= 2 THEN greatest(0, 100 - log10(greatest(r, 1)) * 30) ELSE 100 END', 1)} AS class_balance, {r4('greatest(0, 100 - outp * 3)', 1)} AS feature_quality, {r4('least(100, a.n * 5.0 / a.k)', 1)} AS adequacy, "
        "a.n AS rows, a.k AS cols, miss, a.n - dn AS dups FROM a, dd, cb), "
        f"q AS (SELECT *, {r4('(completeness + uniqueness + consistency + class_balance + feature_quality + adequacy) / 6', 1)} AS overall_score FROM dims)"
    )


def weighted_quality_cte(name, y):
    return (
        f"{facts_sql(name)}, dd AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM {src(name)})), cb AS {_class_ratio(name, y)}, pr AS ({corr_sql(name) if len(numeric_of(name)) > 1 else 'SELECT NULL AS r WHERE false'}), "
        "a AS (SELECT max(rows) AS n, count(*) AS k, sum(missing) * 100.0 / (max(rows) * count(*)) AS miss, coalesce(sum((z_outliers + iqr_outliers) / 2.0), 0) * 100.0 / max(rows) AS outp, "
        "count(*) FILTER (WHERE std < 0.01) * 10 + (SELECT count(*) FROM pr WHERE abs(r) > 0.95) * 5 AS pen FROM facts), "
        f"dims AS (SELECT {r4('100 - miss', 2)} AS completeness, {r4('100 - (a.n - dn) * 100.0 / a.n', 2)} AS uniqueness, {r4('greatest(0, 100 - outp * 2)', 2)} AS consistency, "
        f"{r4('CASE WHEN cb.k > 1 THEN (1 - ss / (CAST(cn AS DOUBLE) * cn)) / (1 - 1.0 / cb.k) * 100 ELSE 100 END', 2)} AS class_balance, {r4('greatest(0, 100 - pen)', 2)} AS feature_quality, "
        "CASE WHEN a.n * 1.0 / a.k >= 10 THEN 100.0 WHEN a.n * 1.0 / a.k >= 5 THEN 70.0 WHEN a.n * 1.0 / a.k >= 2 THEN 40.0 ELSE 10.0 END::DOUBLE AS adequacy FROM a, dd, cb), "
        f"q AS (SELECT *, {r4('completeness * 0.25 + uniqueness * 0.1 + consistency * 0.2 + class_balance * 0.15 + feature_quality * 0.15 + adequacy * 0.15', 2)} AS overall_score FROM dims)"
    )


_d = "completeness, uniqueness, consistency, class_balance, feature_quality, adequacy, overall_score"
_grade = "CASE WHEN overall_score >= 85 THEN 'A' WHEN overall_score >= 70 THEN 'B' WHEN overall_score >= 55 THEN 'C' WHEN overall_score >= 40 THEN 'D' ELSE 'F' END"
for name, y in (("orders_dirty", "o_orderstatus"), ("lineitem_skew", "l_returnflag"), ("part_mixed", "p_type"), ("lineitem_wide", "l_returnflag")):
    REG.add(
        f"quality_simple_{name}", _q(Q.quality_score, name, y),
        f"WITH {simple_quality_cte(name, y)} SELECT {_d}, CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' ELSE 'Poor' END AS status FROM q",
    )
for name in ("lineitem_skew", "orders_dirty"):
    y = columns_of(name)[-1][0]
    REG.add(
        f"quality_weighted_{name}", _q(Q.quality_score, name, None, "weighted", True),
        f"WITH {weighted_quality_cte(name, y)} SELECT {_d}, CASE WHEN overall_score >= 85 THEN 'Excellent' WHEN overall_score >= 70 THEN 'Good' WHEN overall_score >= 50 THEN 'Moderate' ELSE 'Poor' END AS status, {_grade} AS grade FROM q",
    )
_sens = ", ".join(f"'{w}'" for w in N.SENSITIVE_WORDS)
REG.add(
    "sensitive_scan_events", _q(Q.sensitive_scan, "SELECT event_id, user_id, value AS income, event_type AS gender_code, ts AS page_time FROM {events}"),
    f"SELECT \"column\", len(list_filter([{_sens}], lambda w: contains(lower(\"column\"), w))) > 0 AS sensitive FROM (SELECT unnest(['event_id', 'user_id', 'income', 'gender_code', 'page_time']) AS \"column\") WHERE (SELECT count(*) FROM events) > 0",
)
for name in ("customer", "part_mixed"):
    sens = 0
    REG.add(
        f"fair_simple_{name}", _q(Q.fair_score, name),
        f"WITH {facts_sql(name)}, d AS (SELECT 100.0::DOUBLE AS findable, {r4('greatest(0, 100 - sum(missing) * 200.0 / (max(rows) * count(*)))', 1)} AS accessible, "
        f"{r4('greatest(0, 100 - 10 * count(*) FILTER (WHERE kind = ' + chr(39) + 'string' + chr(39) + ' AND castable = present))', 1)} AS interoperable, "
        f"{r4(f'greatest(0, 100 - 15 * count(*) FILTER (WHERE len(list_filter([{_sens}], lambda w: contains(lower(' + chr(34) + 'column' + chr(34) + '), w))) > 0))', 1)} AS reusable FROM facts), "
        f"o AS (SELECT *, {r4('(findable + accessible + interoperable + reusable) / 4', 1)} AS overall_fair_score FROM d) SELECT *, CASE WHEN overall_fair_score >= 90 THEN 'Fully FAIR' WHEN overall_fair_score >= 75 THEN 'Mostly FAIR' WHEN overall_fair_score >= 55 THEN 'Partially FAIR' ELSE 'Not FAIR' END AS fair_grade FROM o",
    )
    REG.add(
        f"fair_detailed_{name}", _q(Q.fair_score, name, "detailed"),
        f"WITH {facts_sql(name)}, d AS (SELECT greatest(0, 100 - 10 * count(*) FILTER (WHERE regexp_matches(lower(\"column\"), '^(col|column|var|x|field)[0-9]*$')))::DOUBLE AS findable, "
        "greatest(0, 100 - 20 * count(*) FILTER (WHERE present = 0) - 10 * count(*) FILTER (WHERE missing * 1.0 / rows > 0.9) - CASE WHEN max(rows) < 10 THEN 50 ELSE 0 END)::DOUBLE AS accessible, "
        "greatest(0, 100 - 8 * count(*) FILTER (WHERE regexp_matches(\"column\", '[^a-zA-Z0-9_]')) - 10 * count(*) FILTER (WHERE kind = 'string' AND numberlike_any * 1.0 / present > 0.2 AND numberlike_any * 1.0 / present < 0.8))::DOUBLE AS interoperable, "
        "greatest(0, 100 - CASE WHEN max(rows) < 50 THEN 40 WHEN max(rows) < 200 THEN 20 ELSE 0 END - CASE WHEN count(*) FILTER (WHERE length(\"column\") <= 2) > count(*) * 0.5 THEN 25 ELSE 0 END - 10 * count(*) FILTER (WHERE kind = 'string' AND \"distinct\" = rows))::DOUBLE AS reusable FROM facts), "
        f"o AS (SELECT *, {r4('(findable + accessible + interoperable + reusable) / 4', 1)} AS overall_fair_score FROM d) SELECT *, CASE WHEN overall_fair_score >= 85 THEN 'FAIR-compliant' WHEN overall_fair_score >= 65 THEN 'Partially FAIR' WHEN overall_fair_score >= 40 THEN 'Needs improvement' ELSE 'Not FAIR' END AS fair_grade FROM o",
    )


def table_score_sql(name):
    y = columns_of(name)[-1][0]
    return (
        f"SELECT * FROM (WITH {weighted_quality_cte(name, y)} SELECT '{name}' AS \"table\", (SELECT max(rows) FROM facts) AS rows, (SELECT count(*) FROM facts) AS columns, {_d}, "
        "(SELECT count(*) FROM facts WHERE missing * 100.0 / rows > 60) AS critical, (SELECT count(*) FILTER (WHERE missing * 100.0 / rows > 20 AND missing * 100.0 / rows <= 60) + count(*) FILTER (WHERE \"distinct\" = rows) FROM facts) "
        "+ least(3, (SELECT count(*) FROM pr WHERE abs(r) > 0.95)) AS high, (SELECT count(*) FROM facts WHERE missing * 100.0 / rows > 5 AND missing * 100.0 / rows <= 20) AS moderate FROM q)"
    )


_ranked = ["nation", "supplier", "customer", "part", "orders_dirty", "labels"]
_rank_base = "WITH t AS (" + " UNION ALL ".join(table_score_sql(n) for n in _ranked) + f"), r AS (SELECT *, {_grade} AS grade, rank() OVER (ORDER BY overall_score DESC) AS rank FROM t)"
REG.add(
    "rank_tables", lambda spark, sf: Q.rank_tables({n: read(spark, sf, n) for n in _ranked}),
    f"{_rank_base} SELECT *, {r4('(1 - (rank - 1) * 1.0 / count(*) OVER ()) * 100', 1)} AS percentile, {r4('overall_score - avg(overall_score) OVER ()', 2)} AS vs_average FROM r",
)
_dim_list = ["completeness", "uniqueness", "consistency", "class_balance", "feature_quality", "adequacy"]
_means = " UNION ALL ".join(f"SELECT {i} AS o, '{d}' AS d, {r4(f'avg({d})', 2)} AS v FROM r" for i, d in enumerate(_dim_list))
REG.add(
    "rank_insights", lambda spark, sf: Q.rank_insights(Q.rank_tables({n: read(spark, sf, n) for n in _ranked})),
    f"{_rank_base}, m AS ({_means}) SELECT count(*) AS tables, {r4('avg(overall_score)', 2)} AS average_score, {r4('stddev_pop(overall_score)', 2)} AS score_std, arg_max(\"table\", {{'a': overall_score, 'b': \"table\"}}) AS best_table, arg_min(\"table\", {{'a': overall_score, 'b': \"table\"}}) AS worst_table, "
    "(SELECT d FROM m ORDER BY v DESC, o LIMIT 1) AS strongest_dimension, (SELECT d FROM m ORDER BY v, o LIMIT 1) AS weakest_dimension, count(*) FILTER (WHERE grade IN ('A', 'B')) AS ready_tables, "
    "CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(moderate) AS BIGINT) AS moderate FROM r",
)


def _compare_sql(a, b, y):
    side = lambda n: (
        f"(WITH {simple_quality_cte(n, y)} SELECT completeness, uniqueness, consistency, class_balance, feature_quality, adequacy, overall_score, (SELECT avg(missing * 100.0 / rows) FROM facts) AS missing_percent, "
        "CAST(rows AS DOUBLE) AS rows, CAST(cols AS DOUBLE) AS columns FROM q)"
    )
    ca, cb = {n for n, _ in columns_of(a)}, {n for n, _ in columns_of(b)}
    overlap = len(ca & cb) * 100.0 / len(ca | cb)
    metrics = ["completeness", "uniqueness", "consistency", "class_balance", "feature_quality", "adequacy", "overall_score", "missing_percent", "rows", "columns"]
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, {r4(f'a.{m}')} AS table_1, {r4(f'b.{m}')} AS table_2, {r4(f'b.{m} - a.{m}')} AS delta FROM a, b" for m in metrics)
    return f"WITH a AS {side(a)}, b AS {side(b)} {rows} UNION ALL SELECT 'column_overlap_percent', {r4(str(overlap))}, {r4(str(overlap))}, 0.0"


REG.add("compare_tables_orders", lambda spark, sf: Q.compare_tables(read(spark, sf, "orders"), read(spark, sf, "orders_dirty"), "o_orderstatus"), _compare_sql("orders", "orders_dirty", "o_orderstatus"))
for name, y in (("orders_dirty", "o_orderstatus"), ("part", "p_retailprice")):
    clf = y != "p_retailprice"
    ratio = f"(SELECT max(cnt) / (min(cnt) + 1e-9) FROM (SELECT {y}, count(*) AS cnt FROM {src(name)} WHERE {y} IS NOT NULL GROUP BY 1))" if clf else "NULL::DOUBLE"
    REG.add(
        f"ml_sizing_{name}", _q(Q.ml_sizing, name, y),
        f"WITH {facts_sql(name)}, a AS (SELECT max(rows) AS rows, count(*) AS columns, max(rows) * 1.0 / count(*) AS per, avg(missing * 100.0 / rows) AS miss, count(*) FILTER (WHERE kind = 'numeric') AS numeric_columns, "
        f"count(*) FILTER (WHERE kind <> 'numeric') AS categorical_columns, {ratio} AS ratio FROM facts) "
        f"SELECT rows, columns, '{'classification' if clf else 'regression'}' AS task, numeric_columns, categorical_columns, CASE WHEN rows < 1000 THEN 'small' WHEN rows < 10000 THEN 'medium' ELSE 'large' END AS size_category, "
        "CASE WHEN rows < 500 THEN 'small' WHEN rows < 10000 THEN 'medium' ELSE 'large' END AS size_note, "
        f"{r4('per', 2)} AS rows_per_feature, CASE WHEN per < 5 THEN 'DANGER' WHEN per < 10 THEN 'CAUTION' ELSE 'OK' END AS ratio_warning, {r4('ratio', 2)} AS imbalance_ratio, "
        "CASE WHEN ratio IS NULL THEN NULL WHEN ratio > 10 THEN 'SEVERE' WHEN ratio > 3 THEN 'MODERATE' ELSE 'NONE' END AS imbalance_severity, "
        f"{r4('miss')} AS missing_percent, miss > 0 AS needs_imputation, categorical_columns > 0 AS needs_encoding, numeric_columns > 0 AS needs_scaling, per < 10 AS needs_selection FROM a",
    )


# ---- issues ------------------------------------------------------------------------------------

def issues_cte(name, y, anomaly=None):
    found = f"UNION ALL SELECT 'HIGH', 'Anomalies', 'table', 'anomaly_detection' FROM ({anomaly}) WHERE pct >= 8 " if anomaly else ""
    return (
        f"{simple_quality_cte(name, y)}, leaks AS ({leak_sql(name, y)}), pairs AS ({corr_sql(name)}), iss AS ("
        "SELECT CASE WHEN miss > 30 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'Completeness' AS category, 'table' AS subject, 'dataset_summary' AS source FROM q WHERE miss > 10 "
        "UNION ALL SELECT CASE WHEN dups * 100.0 / rows > 5 THEN 'HIGH' ELSE 'MODERATE' END, 'Uniqueness', 'table', 'dataset_summary' FROM q WHERE dups > 0 "
        "UNION ALL SELECT 'HIGH', 'Missing Values', \"column\", 'feature_analysis' FROM facts WHERE missing * 1.0 / rows > 0.5 "
        f"UNION ALL SELECT 'MODERATE', 'Feature Quality', \"column\", 'feature_analysis' FROM facts WHERE \"distinct\" <= 1 AND \"column\" <> '{y}' "
        "UNION ALL SELECT 'HIGH', 'Multicollinearity', feature_1 || '|' || feature_2, 'correlation_analysis' FROM pairs WHERE abs(r) > 0.9 "
        "UNION ALL SELECT 'CRITICAL', 'Data Leakage', feature, 'leakage_analysis' FROM leaks "
        f"{found}UNION ALL SELECT 'MODERATE', 'Class Balance', '{y}', 'quality_score' FROM q WHERE class_balance < 60 "
        "UNION ALL SELECT 'MODERATE', 'Data Adequacy', 'table', 'dataset_summary' FROM q WHERE rows * 1.0 / cols < 10 "
        "UNION ALL SELECT 'LOW', 'Feature Distribution', 'table', 'feature_analysis' FROM facts WHERE abs(skew) > 3 HAVING count(*) > 3), "
        f"ready AS (SELECT {r4('greatest(10, least(100, overall_score - 12 * (SELECT count(*) FROM iss WHERE severity = ' + chr(39) + 'CRITICAL' + chr(39) + ') - 5 * (SELECT count(*) FROM iss WHERE severity = ' + chr(39) + 'HIGH' + chr(39) + ')))', 1)} AS readiness_score FROM q)"
    )


_counts = ", ".join(f"(SELECT count(*) FROM iss WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MODERATE", "LOW"))
for name, y in (("orders_dirty", "o_orderstatus"), ("lineitem_skew", "l_extendedprice")):
    REG.add(f"issues_{name}", _q(I.issues, name, y), f"WITH {issues_cte(name, y)} SELECT * FROM iss")
    REG.add(
        f"readiness_{name}", _q(I.readiness, name, y),
        f"WITH {issues_cte(name, y)} SELECT readiness_score, {_counts}, CASE WHEN readiness_score >= 90 THEN 'A' WHEN readiness_score >= 75 THEN 'B' WHEN readiness_score >= 60 THEN 'C' WHEN readiness_score >= 45 THEN 'D' ELSE 'F' END AS grade, readiness_score >= 75 AS ready FROM ready",
    )
REG.add(
    "action_plan_lineitem_skew", lambda spark, sf: I.action_plan(I.issues(read(spark, sf, "lineitem_skew"), "l_extendedprice")),
    f"WITH {issues_cte('lineitem_skew', 'l_extendedprice')} SELECT row_number() OVER (ORDER BY o, category, subject) AS step, severity, category, subject FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 ELSE 3 END AS o FROM iss) ORDER BY step LIMIT 10",
)
REG.add(
    "module_health_orders_dirty", _q(I.module_health, "orders_dirty", "o_orderstatus"),
    f"WITH {issues_cte('orders_dirty', 'o_orderstatus')} SELECT 'completeness' AS module, CASE WHEN miss >= 5 THEN 1 ELSE 0 END AS issues_found, miss < 5 AS clean FROM q UNION ALL SELECT 'uniqueness', CASE WHEN dups > 0 THEN 1 ELSE 0 END, dups = 0 FROM q "
    "UNION ALL SELECT 'correlation', count(*), count(*) = 0 FROM pairs WHERE abs(r) > 0.75 UNION ALL SELECT 'leakage', count(*), count(*) = 0 FROM leaks "
    f"UNION ALL SELECT 'sensitive_names', count(*), count(*) = 0 FROM facts WHERE len(list_filter([{_sens}], lambda w: contains(lower(\"column\"), w))) > 0 "
    "UNION ALL SELECT 'class_balance', CASE WHEN class_balance < 70 THEN 1 ELSE 0 END, class_balance >= 70 FROM q UNION ALL SELECT 'feature_quality', count(*), count(*) <= 3 FROM facts WHERE abs(skew) > 3",
)


def penalty_cte(name, y):
    dup = " UNION ALL ".join(
        f"SELECT 'HIGH', 'Data Leakage', '{a}|{b}', 'leakage_detection' FROM {src(name)} HAVING count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) = 0"
        for i, (a, ka) in enumerate(columns_of(name)) for b, kb in columns_of(name)[i + 1:] if ka == kb
    )
    dims = " UNION ALL ".join(f"SELECT CASE WHEN {d} < 50 THEN 'HIGH' ELSE 'MODERATE' END, 'Dataset Quality', '{d}', 'data_quality_score' FROM q WHERE {d} < 70" for d in _dim_list)
    return (
        f"{weighted_quality_cte(name, y)}, iss AS (SELECT CASE WHEN round(missing * 100.0 / rows, 2) > 60 THEN 'CRITICAL' WHEN round(missing * 100.0 / rows, 2) > 15 THEN 'HIGH' ELSE 'MODERATE' END AS severity, 'Missing Data' AS category, \"column\" AS subject, "
        f"'preprocessing_suggestions' AS source FROM facts WHERE round(missing * 100.0 / rows, 2) > 5 UNION ALL {dims} "
        f"UNION ALL SELECT 'CRITICAL', 'Data Leakage', CASE WHEN feature_1 = '{y}' THEN feature_2 ELSE feature_1 END, 'leakage_detection' FROM pr WHERE '{y}' IN (feature_1, feature_2) AND abs(r) > 0.95 "
        f"UNION ALL SELECT 'HIGH', 'Data Leakage', feature_1 || '|' || feature_2, 'leakage_detection' FROM pr WHERE '{y}' NOT IN (feature_1, feature_2) AND abs(r) > 0.95 UNION ALL {dup})"
    )


for name, y in (("orders_dirty", "o_totalprice"), ("lineitem_skew", "price_copy")):
    REG.add(f"penalty_issues_{name}", _q(I.penalty_issues, name, y), f"WITH {penalty_cte(name, y)} SELECT * FROM iss")
    REG.add(
        f"readiness_penalty_{name}", _q(I.readiness, name, y, "penalty"),
        f"WITH {penalty_cte(name, y)}, k AS (SELECT {_counts}), s AS (SELECT *, CAST(greatest(0, least(100, 100 - least(60, critical * 12 + high * 7 + moderate * 4 + low) + CASE WHEN critical = 0 THEN 5 ELSE 0 END)) AS DOUBLE) AS readiness_score FROM k) "
        "SELECT *, CASE WHEN readiness_score >= 85 THEN 'A' WHEN readiness_score >= 70 THEN 'B' WHEN readiness_score >= 55 THEN 'C' WHEN readiness_score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s",
    )


def gate_sql(name, y, confidence, anomaly=None):
    checks = [
        ("row_count", "rows >= 100", "rows"), ("rows_per_feature", "rows * 1.0 / cols >= 10", "rows * 1.0 / cols"), ("missing_rate", "miss < 20", "miss"), ("no_duplicates", "dups = 0", "dups"),
        ("target_detected", f"{confidence} >= 0.4", str(confidence)), ("no_leakage", "(SELECT count(*) FROM leaks) = 0", "(SELECT count(*) FROM leaks)"), ("class_balance", "class_balance >= 60", "class_balance"),
        ("anomaly_rate", f"(SELECT pct FROM ({anomaly})) < 8" if anomaly else "true", f"(SELECT pct FROM ({anomaly}))" if anomaly else "0"), ("completeness", "completeness >= 70", "completeness"), ("no_constant_columns", "(SELECT count(*) FROM facts WHERE \"distinct\" <= 1) = 0", "(SELECT count(*) FROM facts WHERE \"distinct\" <= 1)"),
        ("no_sparse_columns", "(SELECT count(*) FROM facts WHERE missing * 1.0 / rows > 0.6) = 0", "(SELECT count(*) FROM facts WHERE missing * 1.0 / rows > 0.6)"),
        ("readiness", "(SELECT readiness_score FROM ready) >= 70", "(SELECT readiness_score FROM ready)"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, {r4(v, 2)} AS value FROM q" for n, ok, v in checks)
    return (
        f"WITH {issues_cte(name, y, anomaly)}, g AS ({rows}) SELECT *, CASE WHEN (SELECT count(*) FILTER (WHERE status = 'PASS') * 1.0 / count(*) FROM g) >= 0.75 AND "
        "(SELECT count(*) FROM g WHERE \"check\" IN ('no_leakage', 'target_detected') AND status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall FROM g"
    )


for name, y in (("orders_dirty", "o_orderstatus"), ("orders", "o_orderpriority")):
    REG.add(f"validate_{name}", _q(I.validate, name, y), gate_sql(name, y, 1.0))


# rows flagged by a rule that both engines know, in place of a forest: many in one table, few in the other
_FLAGS = {"orders_dirty": ("o_orderstatus", "o_totalprice > 350000"), "orders": ("o_orderpriority", "o_totalprice < 1200")}
for name, (y, odd) in _FLAGS.items():
    flagged = f"SELECT {odd} AS is_anomaly FROM {src(name)}"
    share = f"SELECT {r4('count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*)', 2)} AS pct FROM ({flagged})"
    flags = lambda spark, sf, name=name, odd=odd: A.flag_summary(read(spark, sf, name).selectExpr(f"{odd} AS is_anomaly"))
    with_flags = lambda fn, name=name, y=y, flags=flags: lambda spark, sf: fn(read(spark, sf, name), y, anomalies=flags(spark, sf))
    REG.add(
        f"flag_summary_{name}", flags,
        f"SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) AS rows, any_value(pct) AS anomaly_percent, CASE WHEN any_value(pct) < 3 THEN 'LOW' WHEN any_value(pct) < 8 THEN 'MODERATE' ELSE 'HIGH' END AS severity FROM ({flagged}), ({share})",
    )
    REG.add(f"issues_flagged_{name}", with_flags(I.issues), f"WITH {issues_cte(name, y, share)} SELECT * FROM iss")
    REG.add(f"validate_flagged_{name}", with_flags(I.validate), gate_sql(name, y, 1.0, share))
    REG.add(
        f"positive_signals_{name}", with_flags(I.positive_signals),
        f"WITH {issues_cte(name, y, share)} SELECT 'near_complete' AS signal, {r4('miss', 2)} AS value FROM q WHERE miss < 2 UNION ALL SELECT 'no_duplicates', 0.0 FROM q WHERE dups = 0 "
        "UNION ALL SELECT 'no_multicollinearity', 0.0 FROM pairs WHERE abs(r) > 0.75 HAVING count(*) = 0 UNION ALL SELECT 'no_leakage', 0.0 FROM leaks HAVING count(*) = 0 "
        f"UNION ALL SELECT 'few_anomalies', pct FROM ({share}) WHERE pct < 2 UNION ALL SELECT 'ready', readiness_score FROM ready WHERE readiness_score >= 80",
    )


def ci_sql(name, key, y, n):
    """Subsamples as unions of hash blocks, everything recomputed per subsample over the rows."""
    cols = columns_of(name)
    num, texts = [c for c in numeric_of(name)], [c for c, kind in cols if kind == "s"]
    k = len(cols)
    out_cols = [c for c in num if c != y]
    iqr = lambda c: f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
    fences = "fen AS (SELECT i, " + ", ".join(f"quantile_cont({c}, 0.25) - 1.5 * {iqr(c)} AS lo_{c}, quantile_cont({c}, 0.75) + 1.5 * {iqr(c)} AS hi_{c}" for c in out_cols) + " FROM s GROUP BY i)"
    missing = " + ".join(f"count(*) - count({c})" for c, _ in cols)
    rates = " + ".join(f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) * 100.0 / count({c})" for c in out_cols)
    pairs = [(a, b) for i, a in enumerate(num) for b in num[i + 1:]]
    safe = lambda a, b: f"abs(CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END)"
    crit = " + ".join(f"CASE WHEN {safe(a, b)} > 0.95 THEN 1 ELSE 0 END" for a, b in pairs if y in (a, b)) or "0"
    single = lambda c: f"SELECT i, bool_and(lo = hi) AS one FROM (SELECT i, min({y}) AS lo, max({y}) AS hi FROM s WHERE {c} IS NOT NULL AND {y} IS NOT NULL GROUP BY i, {c}) GROUP BY i"
    maps = "mp AS (" + " UNION ALL ".join(
        f"SELECT i FROM (SELECT i, count(DISTINCT {c}) AS dc, count(DISTINCT {y}) AS dy FROM s GROUP BY i) JOIN ({single(c)}) USING (i) WHERE dc = dy AND dc > 0 AND one" for c, _ in cols if c != y) + ")"
    digits = lambda c: (
        f"(count(*) FILTER (WHERE regexp_matches(replace(replace({c}, '.', ''), '-', ''), '^[0-9]+$') AND length({c}) - length(replace({c}, '.', '')) <= 1 AND length({c}) - length(replace({c}, '-', '')) <= 1) * 1.0 / nullif(count({c}), 0))")
    mixed = " + ".join(f"CASE WHEN {digits(c)} > 0.3 AND {digits(c)} < 0.8 THEN 1 ELSE 0 END" for c in texts) or "0"
    high = " + ".join([f"CASE WHEN {safe(a, b)} > 0.9 THEN 1 ELSE 0 END" for a, b in pairs] + [f"CASE WHEN count({c}) < count(*) * 0.5 THEN 1 ELSE 0 END" for c, _ in cols])
    names = ", ".join(c for c, _ in cols)
    return (
        f"WITH t AS {src(name)}, it AS (SELECT i, b FROM (SELECT i, b, row_number() OVER (PARTITION BY i ORDER BY md5(i || '-' || b)) AS o FROM range({n}) x(i), range(64) z(b)) WHERE o <= 51), "
        f"tb AS (SELECT *, CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 2) AS INT) % 64 AS b FROM t), s AS (SELECT it.i, tb.* EXCLUDE (b) FROM it JOIN tb USING (b)), {fences}, {maps}, "
        f"a AS (SELECT i, count(*) AS n, ({missing}) * 100.0 / (count(*) * {k}) AS miss, ({rates}) / {len(out_cols)} AS outp, {crit} AS crit0, {high} AS high, {mixed} AS mixed FROM s JOIN fen USING (i) GROUP BY i), "
        f"d AS (SELECT i, count(*) AS dn FROM (SELECT DISTINCT i, {names} FROM s) GROUP BY i), cb AS (SELECT i, count(*) AS ky, max(cnt) * 1.0 / min(cnt) AS r FROM (SELECT i, {y}, count(*) AS cnt FROM s WHERE {y} IS NOT NULL GROUP BY 1, 2) GROUP BY i), "
        f"q AS (SELECT i, n, miss, crit0 + (SELECT count(*) FROM mp WHERE mp.i = a.i) AS crit, high, (n - dn) * 100.0 / n AS dup, {r4('greatest(0, 100 - miss * 2.5)', 1)} + {r4('greatest(0, 100 - (n - dn) * 200.0 / n)', 1)} + {r4('greatest(0, 100.0 - mixed * 10)', 1)} + {r4('CASE WHEN ky >= 2 THEN greatest(0, 100 - log10(r) * 30) ELSE 100 END', 1)} "
        f"+ {r4('greatest(0, 100 - outp * 3)', 1)} + {r4(f'least(100, n * 5.0 / {k})', 1)} AS total FROM a JOIN d USING (i) JOIN cb USING (i)) "
        f"SELECT CAST(i AS INT) AS i, n AS rows, {r4('greatest(10, least(100, ' + r4('total / 6', 1) + ' - 12 * (crit + CASE WHEN miss > 30 THEN 1 ELSE 0 END) - 5 * (high + CASE WHEN miss > 10 AND miss <= 30 THEN 1 ELSE 0 END + CASE WHEN dup > 5 THEN 1 ELSE 0 END)))', 1)} AS readiness_score FROM q"
    )


REG.add("readiness_samples_part_mixed", lambda spark, sf: I.readiness_samples(read(spark, sf, "part_mixed"), ["p_partkey"], "p_size", 50), ci_sql("part_mixed", "p_partkey", "p_size", 50))
REG.add("readiness_samples_orders_dirty", lambda spark, sf: I.readiness_samples(read(spark, sf, "orders_dirty"), ["o_orderkey"], "o_orderstatus", 50), ci_sql("orders_dirty", "o_orderkey", "o_orderstatus", 50))
_ci = ci_sql("orders_dirty", "o_orderkey", "o_orderstatus", 50)
REG.add(
    "readiness_ci_orders_dirty", lambda spark, sf: I.readiness_ci(read(spark, sf, "orders_dirty"), ["o_orderkey"], "o_orderstatus", 50),
    f"SELECT count(*) AS iterations, {r4('avg(readiness_score)')} AS mean_readiness_score, {r4('stddev_pop(readiness_score)')} AS std_dev, {r4('quantile_cont(readiness_score, 0.025)')} AS ci_95_lower, "
    f"{r4('quantile_cont(readiness_score, 0.975)')} AS ci_95_upper, CASE WHEN stddev_pop(readiness_score) < 3 THEN 'HIGH' WHEN stddev_pop(readiness_score) < 7 THEN 'MODERATE' ELSE 'LOW' END AS stability FROM ({_ci})",
)
