"""Registered queries: drift between tables, stored baselines, drift on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queryset.base import Registry, r4, read, src
from tablefit.functions.exprs import rounded
from tablefit.operators import drift as D
from tablefit.sources.tables import shared_folder
from tablefit.streaming.drift_stream import drift_stream, judge_open

REG = Registry()

PAIRS = {
    "lineitem_by_year": ("lineitem_before", "lineitem_after", ["l_discount", "l_extendedprice", "l_quantity", "l_tax"], ["l_linestatus", "l_returnflag"]),
    "events_by_half": ("events_before", "events_after", ["user_id", "value"], ["event_type"]),
}


def _two(fn, a, b, *args):
    return lambda spark, sf: fn(read(spark, sf, a), read(spark, sf, b), *args)


def ks_sql(a, b, n):
    return (
        f"SELECT max(abs(fa - fb)) AS ks FROM (SELECT sum(sum(s)) OVER (ORDER BY v) * 1.0 / (SELECT count({n}) FROM {src(a)}) AS fa, sum(sum(1 - s)) OVER (ORDER BY v) * 1.0 / (SELECT count({n}) FROM {src(b)}) AS fb "
        f"FROM (SELECT CAST({n} AS DOUBLE) AS v, 1 AS s FROM {src(a)} WHERE {n} IS NOT NULL UNION ALL SELECT CAST({n} AS DOUBLE), 0 FROM {src(b)} WHERE {n} IS NOT NULL) GROUP BY v)"
    )


def psi_sql(a, b, n):
    qs = ", ".join(str(k / 10) for k in range(11))
    return (
        f"(WITH ed AS (SELECT unnest(list_sort(list_distinct(quantile_cont(CAST({n} AS DOUBLE), [{qs}])))) AS e FROM {src(a)}), "
        "bins AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) = (SELECT count(*) - 1 FROM ed) AS last FROM ed QUALIFY hi IS NOT NULL), "
        f"x AS (SELECT lo, (SELECT count(*) FROM {src(a)} WHERE ({n} >= lo AND {n} < hi) OR (last AND {n} = hi)) * 1.0 / (SELECT count({n}) FROM {src(a)}) + 1e-8 AS e, "
        f"(SELECT count(*) FROM {src(b)} WHERE ({n} >= lo AND {n} < hi) OR (last AND {n} = hi)) * 1.0 / (SELECT count({n}) FROM {src(b)}) + 1e-8 AS o FROM bins), "
        "y AS (SELECT e / sum(e) OVER () AS e, o / sum(o) OVER () AS o FROM x) SELECT coalesce(abs(sum((o - e) * ln(o / e))), 0) FROM y)"
    )


def js_sql(a, b, n):
    return (
        f"(WITH v AS (SELECT CAST({n} AS DOUBLE) AS v, 1 AS s FROM {src(a)} WHERE {n} IS NOT NULL UNION ALL SELECT CAST({n} AS DOUBLE), 0 FROM {src(b)} WHERE {n} IS NOT NULL), "
        "r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM v), c AS (SELECT least(CAST(floor((v - lo) / w) AS INT), 19) AS bin, sum(s) AS na, sum(1 - s) AS nb FROM v, r GROUP BY 1), "
        "g AS (SELECT coalesce(na, 0) + 1e-8 AS p, coalesce(nb, 0) + 1e-8 AS q FROM range(20) t(bin) LEFT JOIN c USING (bin)), h AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM g) "
        "SELECT sqrt(greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0)) FROM h)"
    )


_band = "CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END"


def numeric_sql(a, b, cols):
    """KS with its p-value, PSI, JS, shifts and severity per column."""
    out = []
    for n in cols:
        s = lambda f, t: f"(SELECT {f}({n}) FROM {src(t)})"
        med = lambda t: f"(SELECT quantile_cont(CAST({n} AS DOUBLE), 0.5) FROM {src(t)})"
        pct = lambda x, y: f"(abs({y} - {x}) / (abs({x}) + 1e-9) * 100)"
        shift = lambda x, y: r4(pct(x, y), 2)
        outside = f"(SELECT count(*) FROM {src(b)} WHERE {n} < {s('min', a)} OR {n} > {s('max', a)})"
        out.append(
            f"(WITH m AS (SELECT *, {ks_p_of(a, b, n)} AS p, {r4(psi_sql(a, b, n))} AS psi, {pct(s('avg', a), s('avg', b))} AS moved FROM ({ks_sql(a, b, n)})), "
            f"l AS (SELECT *, CASE WHEN p < 0.001 AND moved > 20 THEN 'SIGNIFICANT_DRIFT' WHEN p < 0.05 AND psi < 0.1 THEN 'MODERATE_DRIFT' ELSE {_band} END AS drift_severity FROM m) "
            f"SELECT '{n}' AS \"column\", 'numeric' AS dtype, drift_severity, drift_severity <> 'STABLE' AS drift_detected, {r4('ks')} AS ks_statistic, {r4('p')} AS p_value, psi, {r4(js_sql(a, b, n))} AS js_distance, {r4('moved', 2)} AS mean_shift_pct, "
            f"{shift(s('stddev_pop', a), s('stddev_pop', b))} AS std_shift_pct, {shift(med(a), med(b))} AS median_shift_pct, "
            f"{outside} AS out_of_range, {r4(f'{outside} * 100.0 / {s('count', b)}', 2)} AS out_of_range_pct FROM l)"
        )
    return " UNION ALL ".join(out)


def chi_sql(a, b, n):
    return (
        f"(SELECT '{n}' AS \"column\", chi2, js, new_categories, vanished_categories FROM (WITH c AS (SELECT v, sum(s) AS na, sum(1 - s) AS nb FROM (SELECT {n} AS v, 1 AS s FROM {src(a)} WHERE {n} IS NOT NULL UNION ALL SELECT {n}, 0 FROM {src(b)} WHERE {n} IS NOT NULL) GROUP BY 1), "
        "t AS (SELECT *, CAST(sum(na) OVER () AS DOUBLE) AS ta, CAST(sum(nb) OVER () AS DOUBLE) AS tb, CASE WHEN count(*) OVER () = 2 THEN 0.5 ELSE 0 END AS fix, na / sum(na) OVER () + 1e-8 AS p0, nb / sum(nb) OVER () + 1e-8 AS q0 FROM c), "
        "u AS (SELECT *, (na + nb) * ta / (ta + tb) AS ea, (na + nb) * tb / (ta + tb) AS eb, p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM t) "
        "SELECT sum((abs(na - ea) - least(fix, abs(na - ea))) ** 2 / ea + (abs(nb - eb) - least(fix, abs(nb - eb))) ** 2 / eb) AS chi2, "
        "sqrt(greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0)) AS js, count(*) FILTER (WHERE na = 0) AS new_categories, count(*) FILTER (WHERE nb = 0) AS vanished_categories FROM u))"
    )


def chi_p_sql(chi2, dof):
    """Upper tail of the chi-square distribution by Simpson's rule on the square root of the variable."""
    steps = 4000
    return (
        f"(SELECT least(1.0, sum(CASE WHEN g IN (0, {steps}) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * h / 3 * 2 * pow(x, {dof} - 1) * exp(-x * x / 2)) / (pow(2, {dof} / 2.0) * gamma({dof} / 2.0))) "
        f"FROM (SELECT g, h, sqrt({chi2}) + g * h AS x FROM (SELECT g, 12.0 / {steps} AS h FROM range({steps + 1}) r(g))))"
    )


def repeated_psi_sql(a, b, n):
    """PSI of category indexes repeated by their shares in per mille, cut at quantiles of the first side."""
    side = lambda t: f"SELECT {n} AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM {src(t)} WHERE {n} IS NOT NULL GROUP BY 1"
    bins = "CASE WHEN pos = last_edge THEN n_edges - 1 ELSE len(list_filter(edges, lambda e: e <= pos)) END"
    return (
        f"(WITH c AS (SELECT row_number() OVER (ORDER BY coalesce(x.v, y.v)) - 1 AS pos, CAST(round_even(coalesce(x.p, 0) * 1000, 0) AS INT) AS wa, CAST(round_even(coalesce(y.p, 0) * 1000, 0) AS INT) AS wb FROM ({side(a)}) x FULL JOIN ({side(b)}) y USING (v)), "
        "k AS (SELECT count(*) AS k FROM c), ra AS (SELECT pos FROM c, range(1000) r(i) WHERE i < wa), rb AS (SELECT pos FROM c, range(1000) r(i) WHERE i < wb), "
        "y AS (SELECT list_sort(list(CAST(pos AS DOUBLE))) AS s FROM ra), "
        "z AS (SELECT list_sort(list_distinct(list_transform(range(0, k + 1), lambda j: s[CAST(floor((len(s) - 1) * j * 1.0 / k) AS INT) + 1] + coalesce(s[CAST(floor((len(s) - 1) * j * 1.0 / k) AS INT) + 2] - "
        "s[CAST(floor((len(s) - 1) * j * 1.0 / k) AS INT) + 1], 0) * ((len(s) - 1) * j * 1.0 / k - floor((len(s) - 1) * j * 1.0 / k))))) AS edges FROM y, k), "
        "ed AS (SELECT edges, len(edges) AS n_edges, edges[len(edges)] AS last_edge FROM z), "
        f"ha AS (SELECT {bins} AS bin, count(*) AS n FROM ra, ed GROUP BY 1), hb AS (SELECT {bins} AS bin, count(*) AS n FROM rb, ed WHERE pos >= edges[1] AND pos <= last_edge GROUP BY 1), "
        "e AS (SELECT bin, coalesce(ha.n, 0) * 1.0 / (SELECT count(*) FROM ra) + 1e-8 AS e, coalesce(hb.n, 0) * 1.0 / (SELECT count(*) FROM rb) + 1e-8 AS o FROM (SELECT unnest(range(1, n_edges)) AS bin FROM ed) LEFT JOIN ha USING (bin) LEFT JOIN hb USING (bin)), "
        "s AS (SELECT e / sum(e) OVER () AS e, o / sum(o) OVER () AS o FROM e) SELECT coalesce(abs(sum((o - e) * ln(o / e))), 0) FROM s)"
    )


def categorical_sql(a, b, cats):
    """All columns of the categorical operator."""
    p = r4(chi_p_sql("chi2", "(k - 1)"))
    k = lambda n: f"(SELECT count(*) FROM (SELECT {n} FROM {src(a)} WHERE {n} IS NOT NULL UNION SELECT {n} FROM {src(b)} WHERE {n} IS NOT NULL))"
    rows = " UNION ALL ".join(f"SELECT *, {k(n)} AS k, {repeated_psi_sql(a, b, n)} AS psi0 FROM {chi_sql(a, b, n)}" for n in cats)
    return (
        f"SELECT \"column\", 'categorical' AS dtype, s AS drift_severity, s <> 'STABLE' AS drift_detected, {r4('chi2')} AS chi2_statistic, p_value, {r4('js')} AS js_distance, {r4('psi0')} AS psi, new_categories, vanished_categories "
        "FROM (SELECT *, CASE WHEN p_value < 0.001 OR new_categories > 3 THEN 'SIGNIFICANT_DRIFT' WHEN p_value < 0.05 OR new_categories > 0 OR vanished_categories > 0 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS s "
        f"FROM (SELECT *, {p} AS p_value FROM ({rows})))"
    )


def ks_p_rows(given):
    """(id, p) for rows (id, ks, n, m): p-value of the statistic ``ks`` with n and m values a side. Beyond
    10,000 values a side the asymptotic one. Up to there the exact one: the probability of having taken i
    values of the first side after t steps inside the band, step by step."""
    root = "sqrt(n * 1.0 * m / (n + m))"
    raw = "(CASE WHEN i >= lo THEN coalesce(here[i - lo + 1], 0) ELSE 0 END * greatest(m - (t - i), 0) + CASE WHEN i - 1 >= lo THEN coalesce(here[i - lo], 0) ELSE 0 END * greatest(n - i + 1, 0)) / (n + m - t)"
    out = "abs((nlo + k - 1) / n - (t + 1 - (nlo + k - 1)) / m) > band"
    return (
        f"WITH RECURSIVE g AS ({given}), prm AS (SELECT id, ks, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, (floor(ks * n * m - 1e-7) + 0.5) / (n * m) AS band, "
        f"(SELECT greatest(0, least(1, 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * pow(({root} + 0.12 + 0.11 / {root}) * ks, 2))))) FROM range(1, 101) r(j)) AS far FROM g), "
        "walk AS (SELECT id, 0::BIGINT AS t, 0::BIGINT AS lo, [1.0::DOUBLE] AS here, 0.0::DOUBLE AS gone FROM prm WHERE greatest(n, m) <= 10000 AND far > 1e-12 AND ks > 0 UNION ALL "
        f"SELECT id, t + 1, nlo, list_transform(moved, lambda x, k: CASE WHEN {out} THEN 0.0 ELSE x END), gone + coalesce(list_sum(list_transform(moved, lambda x, k: CASE WHEN {out} THEN x ELSE 0.0 END)), 0) "
        f"FROM (SELECT *, list_transform(range(nlo, nhi + 1), lambda i: {raw}) AS moved FROM "
        "(SELECT *, CAST(greatest(0, floor((t / m - band) / (1 / n + 1 / m)) - 1) AS BIGINT) AS nlo, CAST(least(n, ceil(((t + 1) / m + band) / (1 / n + 1 / m)) + 1) AS BIGINT) AS nhi FROM walk JOIN prm USING (id) WHERE t < n + m))), "
        "done AS (SELECT id, least(1.0, gone) AS p FROM walk JOIN prm USING (id) WHERE t = n + m) "
        "SELECT id, CASE WHEN ks = 0 THEN 1.0 WHEN greatest(n, m) <= 10000 AND far > 1e-12 THEN done.p ELSE far END AS p FROM prm LEFT JOIN done USING (id)"
    )


def ks_p_sql(given):
    """The same for a relation of one row, as a value."""
    return f"(SELECT p FROM ({ks_p_rows(f'SELECT 1 AS id, * FROM ({given})')}))"


def ks_p_of(a, b, n):
    return ks_p_sql(f"SELECT ks, (SELECT count({n}) FROM {src(a)}) AS n, (SELECT count({n}) FROM {src(b)}) AS m FROM ({ks_sql(a, b, n)})")


for label, (a, b, cols, cats) in PAIRS.items():
    REG.add(f"psi_{label}", _two(D.psi, a, b), f"SELECT *, {_band} AS band FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {r4(psi_sql(a, b, n))} AS psi" for n in cols) + ")")
    REG.add(f"js_distance_{label}", _two(D.js_distance, a, b), " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {r4(js_sql(a, b, n))} AS js_distance" for n in cols))
    REG.add(
        f"ks_2samp_{label}", _two(D.ks_2samp, a, b),
        " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {r4('ks')} AS ks_statistic, {r4(ks_p_of(a, b, n))} AS p_value FROM ({ks_sql(a, b, n)})" for n in cols),
    )
    REG.add(f"drift_numeric_{label}", _two(D.drift_numeric, a, b), numeric_sql(a, b, cols))
    REG.add(
        f"drift_categorical_{label}", _two(D.drift_categorical, a, b, cats), categorical_sql(a, b, cats),
    )
    REG.add(
        f"category_shifts_{label}", _two(D.category_shifts, a, b, cats),
        "SELECT \"column\", value, " + f"{r4('pa * 100', 2)} AS share_a, {r4('pb * 100', 2)} AS share_b, {r4('(pb - pa) * 100', 2)} AS shift, CASE WHEN pa = 0 THEN 'new' WHEN pb = 0 THEN 'vanished' ELSE 'kept' END AS state FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS \"column\", v AS value, sum(s) / sum(sum(s)) OVER () AS pa, sum(1 - s) / sum(sum(1 - s)) OVER () AS pb FROM (SELECT {n} AS v, 1 AS s FROM {src(a)} WHERE {n} IS NOT NULL UNION ALL SELECT {n}, 0 FROM {src(b)} WHERE {n} IS NOT NULL) GROUP BY v" for n in cats
        ) + ")",
    )
    both = f"SELECT \"column\", dtype, drift_detected, drift_severity, psi, js_distance, p_value FROM ({numeric_sql(a, b, cols)}) UNION ALL SELECT \"column\", dtype, drift_detected, drift_severity, psi, js_distance, p_value FROM ({categorical_sql(a, b, cats)})"
    REG.add(f"drift_columns_{label}", _two(D.drift_columns, a, b), both)
    REG.add(
        f"drift_ranking_{label}", _two(D.drift_ranking, a, b),
        f"SELECT *, CAST(row_number() OVER (ORDER BY CASE drift_severity WHEN 'SIGNIFICANT_DRIFT' THEN 0 WHEN 'MODERATE_DRIFT' THEN 1 ELSE 2 END, \"column\") AS INT) AS position FROM ({both})",
    )
    REG.add(
        f"drift_report_{label}", _two(D.drift_report, a, b),
        "WITH n AS (SELECT count(*) AS total_columns, count(*) FILTER (WHERE NOT drift_detected) AS stable_columns, count(*) FILTER (WHERE drift_severity = 'MODERATE_DRIFT') AS moderate_columns, "
        f"count(*) FILTER (WHERE drift_severity = 'SIGNIFICANT_DRIFT') AS significant_columns FROM ({both})) SELECT *, {r4('(total_columns - stable_columns) * 100.0 / total_columns', 1)} AS drift_percent, "
        "CASE WHEN significant_columns > 0 THEN 'HIGH' WHEN moderate_columns > 0 THEN 'MODERATE' ELSE 'LOW' END AS overall_risk FROM n",
    )
    REG.add(
        f"size_compare_{label}", _two(D.size_compare, a, b),
        f"WITH x AS (SELECT (SELECT count(*) FROM {src(a)}) AS rows_a, (SELECT count(*) FROM {src(b)}) AS rows_b, CAST({len(cols) + len(cats)} AS BIGINT) AS columns_a, CAST({len(cols) + len(cats)} AS BIGINT) AS columns_b), "
        f"y AS (SELECT *, {r4('rows_b * 1.0 / rows_a', 3)} AS ratio FROM x) SELECT *, ratio > 2 AS larger_warning, ratio < 0.1 AS small_warning, columns_a <> columns_b AS width_warning FROM y",
    )
_types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string", "memo": "string", "constant_col": "int"}
REG.add(
    "schema_diff_orders", _two(D.schema_diff, "orders", "SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_totalprice, 1 AS extra FROM {orders}"),
    "SELECT * FROM (VALUES ('extra', NULL, 'int', 'only_b'), ('o_custkey', 'bigint', 'string', 'type_mismatch'), ('o_orderdate', 'timestamp_ntz', NULL, 'only_a'), ('o_orderkey', 'bigint', 'bigint', 'common'), "
    "('o_orderpriority', 'string', NULL, 'only_a'), ('o_orderstatus', 'string', NULL, 'only_a'), ('o_totalprice', 'double', 'double', 'common')) t(\"column\", type_a, type_b, state) WHERE (SELECT count(*) FROM orders) > 0",
)
_miss = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", {r4(f'(SELECT avg(CAST({n} IS NULL AS INT)) * 100 FROM {src('orders')})', 2)} AS missing_a, {r4(f'(SELECT avg(CAST({n} IS NULL AS INT)) * 100 FROM {src('orders_nulls')})', 2)} AS missing_b" for n in ("o_totalprice", "o_orderpriority", "o_custkey")
)
REG.add(
    "missing_drift_orders", _two(D.missing_drift, "orders", "orders_nulls"),
    f"SELECT *, {r4('missing_b - missing_a', 2)} AS shift, CASE WHEN abs(missing_b - missing_a) > 20 THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM ({_miss}) WHERE abs(missing_b - missing_a) > 5",
)

# ---- baseline ----------------------------------------------------------------------------------
_b, _a = src("events_before"), src("events_after")
REG.add(
    "baseline_columns_events", lambda spark, sf: D.Baseline.of(read(spark, sf, "events_before")).columns.select("column", "kind", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "present"),
    " UNION ALL ".join(f"SELECT '{n}' AS \"column\", 'numeric' AS kind, {r4(f'avg({n})')} AS mean, {r4(f'stddev_samp({n})')} AS std, count({n}) AS present FROM {_b}" for n in ("user_id", "value"))
    + f" UNION ALL SELECT 'event_type', 'categorical', 0.0, 0.0, count(event_type) FROM {_b}",
)
REG.add(
    "baseline_categories_events", lambda spark, sf: D.Baseline.of(read(spark, sf, "events_before")).categories.select("column", "value", rounded(F.col("share")).alias("share")),
    f"SELECT 'event_type' AS \"column\", event_type AS value, {r4('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM {_b} GROUP BY event_type",
)
_qs = ", ".join(str(k / 1000) for k in range(1001))
_grid_sql = lambda n: f"SELECT '{n}' AS \"column\", unnest(range(1001)) / 1000.0 AS p, unnest(quantile_cont(CAST({n} AS DOUBLE), [{_qs}])) AS v FROM {_b}"
REG.add(
    "baseline_grid_events", lambda spark, sf: D.Baseline.of(read(spark, sf, "events_before")).grid.select("column", rounded(F.col("p")).alias("p"), rounded(F.col("v"), 6).alias("v")),
    f"SELECT \"column\", {r4('p')} AS p, {r4('v', 6)} AS v FROM ({_grid_sql('user_id')} UNION ALL {_grid_sql('value')})",
)


def vs_baseline(spark, sf):
    path = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}"
    D.Baseline.of(read(spark, sf, "events_before")).save(path)
    return D.drift_vs_baseline(D.Baseline.load(spark, path), read(spark, sf, "events_after"))


_ks_grid = lambda n: (
    f"SELECT '{n}' AS \"column\", 'ks' AS \"check\", max(abs(fa - fb)) AS value FROM (SELECT sum(sum(s)) OVER (ORDER BY v) / 1001.0 AS fa, sum(sum(1 - s)) OVER (ORDER BY v) * 1.0 / (SELECT count({n}) FROM {_a}) AS fb "
    f"FROM (SELECT v, 1 AS s FROM ({_grid_sql(n)}) UNION ALL SELECT CAST({n} AS DOUBLE), 0 FROM {_a} WHERE {n} IS NOT NULL) GROUP BY v)"
)
_psi_cat = (
    f"SELECT 'event_type' AS \"column\", 'psi' AS \"check\", sum((o - e) * ln(o / e)) AS value FROM (SELECT greatest(coalesce(pe, 1e-4), 1e-4) AS e, greatest(coalesce(po, 1e-4), 1e-4) AS o "
    f"FROM (SELECT event_type AS v, count(*) * 1.0 / sum(count(*)) OVER () AS pe FROM {_b} GROUP BY 1) x FULL JOIN (SELECT event_type AS v, count(*) * 1.0 / sum(count(*)) OVER () AS po FROM {_a} GROUP BY 1) y USING (v))"
)
_sev = " UNION ALL ".join(
    f"SELECT *, CASE WHEN p_value < 0.01 THEN 'HIGH' WHEN p_value < 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT *, {ks_p_of('events_before', 'events_after', n)} AS p_value FROM ({_ks_grid(n)}))" for n in ("user_id", "value"))
REG.add(
    "drift_vs_baseline_events", vs_baseline,
    f"WITH d AS ({_sev} UNION ALL SELECT *, NULL, CASE WHEN value > 0.2 THEN 'HIGH' WHEN value > 0.1 THEN 'MEDIUM' ELSE 'LOW' END FROM ({_psi_cat})), k AS (SELECT count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) FILTER (WHERE severity = 'MEDIUM') AS m FROM d) "
    f"SELECT \"column\", \"check\", {r4('value')} AS value, {r4('p_value')} AS p_value, severity, CASE WHEN h / 3.0 > 0.2 THEN 'HIGH' WHEN h > 0 OR m / 3.0 > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS overall FROM d, k",
)


def stream_verdicts(spark, sf, cols=("event_type",)):
    """The events table as a stream of files; daily windows judged against its first half."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    base = D.Baseline.of(read(spark, sf, f"SELECT {', '.join(cols)} FROM {{events}} WHERE ts < timestamp '2024-01-15 00:00:00'"))
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = drift_stream(stream, base, "ts", list(cols), f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    judge_open(spark, base, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "column", "psi", "ks", "p_value", "severity")


REG.add(
    "drift_stream_events", lambda spark, sf: stream_verdicts(spark, sf).drop("ks", "p_value"),
    "WITH b AS (SELECT event_type AS v, count(*) * 1.0 / sum(count(*)) OVER () AS then_share FROM events WHERE ts < timestamp '2024-01-15 00:00:00' AND event_type IS NOT NULL GROUP BY 1), "
    "s AS (SELECT date_trunc('day', ts) AS w, event_type AS v, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)) AS now_share FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), "
    "k AS (SELECT w, v FROM (SELECT DISTINCT w FROM s), (SELECT v FROM b) UNION SELECT w, v FROM s), "
    "j AS (SELECT k.w, greatest(coalesce(then_share, 1e-4), 1e-4) AS e, greatest(coalesce(now_share, 1e-4), 1e-4) AS o FROM k LEFT JOIN b ON b.v = k.v LEFT JOIN s ON s.w = k.w AND s.v = k.v), "
    "p AS (SELECT w, sum((o - e) * ln(o / e)) AS psi FROM j GROUP BY w) "
    f"SELECT CAST(w AS TIMESTAMP) AS window_start, 'event_type' AS \"column\", {r4('psi')} AS psi, CASE WHEN psi > 0.2 THEN 'HIGH' WHEN psi > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p",
)
_first = "FROM events WHERE ts < timestamp '2024-01-15 00:00:00'"


def _window_ks(n):
    """KS of each day against the first half at the first half's 1001 quantiles and just below them."""
    then = lambda op: f"(SELECT count(*) FILTER (WHERE {n} {op} v) * 1.0 / count({n}) {_first})"
    return (
        f"(WITH e AS (SELECT DISTINCT unnest(quantile_cont(CAST({n} AS DOUBLE), [{_qs}])) AS v {_first}), f AS (SELECT v, (SELECT count({n}) {_first}) AS m, {then('<=')} AS f1, {then('<')} AS f0 FROM e), "
        f"d AS (SELECT date_trunc('day', ts) AS w, CAST({n} AS DOUBLE) AS x FROM events WHERE {n} IS NOT NULL), t AS (SELECT w, count(*) AS n FROM d GROUP BY 1), "
        "g AS (SELECT d.w, f.v, any_value(f1) AS f1, any_value(f0) AS f0, any_value(m) AS m, count(*) FILTER (WHERE x <= v) AS c1, count(*) FILTER (WHERE x < v) AS c0 FROM d, f GROUP BY 1, 2) "
        f"SELECT w, '{n}' AS \"column\", max(greatest(abs(c1 * 1.0 / n - f1), abs(c0 * 1.0 / n - f0))) AS ks, any_value(n) AS n, any_value(m) AS m FROM g JOIN t USING (w) GROUP BY w)"
    )


_named = lambda n: f"SELECT date_trunc('day', ts) AS w, ts < timestamp '2024-01-15 00:00:00' AS old, '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value FROM events WHERE {n} IS NOT NULL"
_ks_windows = "SELECT *, row_number() OVER (ORDER BY \"column\", w) AS id FROM (" + " UNION ALL ".join(f"SELECT * FROM {_window_ks(n)}" for n in ("event_id", "user_id", "value")) + ")"
REG.add(
    "drift_stream_events_columns", lambda spark, sf: stream_verdicts(spark, sf, ("event_id", "user_id", "event_type", "value", "props")),
    "WITH x AS (" + " UNION ALL ".join(_named(n) for n in ("event_type", "props")) + "), "
    "b AS (SELECT \"column\", value, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY \"column\") AS then_share FROM x WHERE old GROUP BY 1, 2), "
    "s AS (SELECT w, \"column\", value, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY w, \"column\") AS now_share FROM x GROUP BY 1, 2, 3), "
    "k AS (SELECT d.w, d.\"column\", b.value FROM (SELECT DISTINCT w, \"column\" FROM s) d JOIN b ON b.\"column\" = d.\"column\" UNION SELECT w, \"column\", value FROM s), "
    "j AS (SELECT k.w, k.\"column\", greatest(coalesce(then_share, 1e-4), 1e-4) AS e, greatest(coalesce(now_share, 1e-4), 1e-4) AS o FROM k LEFT JOIN b ON b.\"column\" = k.\"column\" AND b.value = k.value "
    "LEFT JOIN s ON s.w = k.w AND s.\"column\" = k.\"column\" AND s.value = k.value), "
    f"p AS (SELECT w, \"column\", sum((o - e) * ln(o / e)) AS psi FROM j GROUP BY 1, 2), q AS (SELECT z.w, z.\"column\", z.ks, y.p FROM ({_ks_windows}) z JOIN ({ks_p_rows(_ks_windows)}) y USING (id)) "
    f"SELECT CAST(w AS TIMESTAMP) AS window_start, \"column\", {r4('psi')} AS psi, NULL AS ks, NULL AS p_value, CASE WHEN psi > 0.2 THEN 'HIGH' WHEN psi > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p "
    f"UNION ALL SELECT CAST(w AS TIMESTAMP), \"column\", NULL, {r4('ks')}, {r4('p')}, CASE WHEN p < 0.01 THEN 'HIGH' WHEN p < 0.05 THEN 'MEDIUM' ELSE 'LOW' END FROM q",
)
