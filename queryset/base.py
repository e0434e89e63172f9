"""Inputs and SQL helpers of the registered queries.

``INPUTS`` holds each input as one SQL text that Spark and DuckDB both run on the driver tables:
dirt (nulls, duplicates, sparse and constant columns) is derived from key arithmetic, so both
engines see the same rows. ``facts_sql`` gives the oracle per-column facts in plain SQL.
"""

from __future__ import annotations

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

_ORDERS = (
    "o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority"
)
_NOTE = "CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS memo, 1 AS constant_col"

INPUTS = {
    "orders": "SELECT * FROM {orders}",
    "lineitem": "SELECT * FROM {lineitem}",
    "customer": "SELECT * FROM {customer}",
    "supplier": "SELECT * FROM {supplier}",
    "part": "SELECT * FROM {part}",
    "events": "SELECT * FROM {events}",
    "documents": "SELECT * FROM {documents}",
    "labels": "SELECT * FROM {labels}",
    "conversations": "SELECT * FROM {conversations}",
    "nation": "SELECT * FROM {nation}",
    "orders_nulls": f"SELECT {_ORDERS} FROM {{orders}}",
    "orders_dirty": (
        f"SELECT {_ORDERS}, {_NOTE} FROM {{orders}} UNION ALL SELECT {_ORDERS}, {_NOTE} FROM {{orders}} WHERE o_orderkey % 20 = 0"
    ),
    "lineitem_numbers": "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}",
    "lineitem_skew": (
        "SELECT l_orderkey, l_linenumber, l_quantity, exp(l_quantity / 5) AS skewed, -exp(l_quantity / 5) AS mirrored, "
        "l_quantity * l_quantity AS squared, l_extendedprice, l_extendedprice * 1.0001 AS price_copy, l_discount, "
        "l_returnflag FROM {lineitem}"
    ),
    # more numeric columns than any fixed prefix
    "lineitem_wide": (
        "SELECT l_returnflag, " + ", ".join(f"l_quantity * {i % 5} + l_extendedprice * {i // 5 % 5} * l_discount + l_tax * l_linenumber * {i} AS w{i}" for i in range(1, 19))
        + " FROM {lineitem}"
    ),
    "part_mixed": (
        "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, "
        "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE p_brand END AS mixed, "
        "CAST(p_size AS STRING) AS size_text, p_partkey % 2 = 0 AS is_even FROM {part}"
    ),
    "nation_region": "SELECT n_nationkey, n_name, n_regionkey, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "documents_labels": (
        "SELECT d.doc_id, d.lang, d.source, d.n_chars, length(d.text) - length(replace(d.text, ' ', '')) AS spaces, "
        "l.toxic, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"
    ),
    "lineitem_before": "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM {lineitem} WHERE year(l_shipdate) <= 1996",
    "lineitem_after": (
        "SELECT l_quantity, l_extendedprice * 1.3 AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus "
        "FROM {lineitem} WHERE year(l_shipdate) > 1996"
    ),
    "events_before": "SELECT user_id, event_type, value FROM {events} WHERE ts < timestamp '2024-01-15 00:00:00'",
    "events_after": (
        "SELECT user_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, value * 1.1 AS value "
        "FROM {events} WHERE ts >= timestamp '2024-01-15 00:00:00'"
    ),
}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark, sf_dir: str, name: str):
    """One of ``INPUTS`` (or any SQL text) as a DataFrame over the driver tables."""
    sql = INPUTS.get(name, name)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def src(name: str) -> str:
    """The same input as DuckDB SQL, in brackets."""
    return "(" + INPUTS.get(name, name).format(**{t: t for t in TABLES}) + ")"


def r4(x: str, digits: int = 4) -> str:
    return f"(round(CAST(({x}) AS DOUBLE), {digits}) + 0.0)"


def t4(x: str, digits: int = 4) -> str:
    """Null, NaN and infinite become 0, then round."""
    return f"coalesce(CASE WHEN isfinite(CAST(({x}) AS DOUBLE)) THEN round(CAST(({x}) AS DOUBLE), {digits}) + 0.0 ELSE 0.0 END, 0.0)"


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def fact_row(source: str, ordinal: int, name: str, kind: str, is_int: bool = False) -> str:
    q = quote(name)
    head = f"SELECT {ordinal} AS ordinal, '{name}' AS \"column\", '{kind}' AS kind, {str(is_int).lower()} AS is_int, "
    counts = f"count(*) AS rows, count(x) AS present, count(*) - count(x) AS missing, count(DISTINCT x) AS \"distinct\", "
    if kind == "numeric":
        mid = (
            "avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var, stddev_pop(x) AS std_pop, min(x) AS min, max(x) AS max, "
            "CASE WHEN stddev_pop(x) = 0 THEN 0 ELSE skewness(x) END AS skew, CASE WHEN stddev_pop(x) = 0 THEN 0 ELSE kurtosis(x) END AS kurt, "
            "count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x < 0) AS negatives, "
            "count(*) FILTER (WHERE x IN (0, 1)) = count(x) AS is_unit, count(*) FILTER (WHERE x = floor(x)) AS integers, "
            "any_value(qa) AS q25, any_value(qb) AS q50, any_value(qc) AS q75, "
            "count(*) FILTER (WHERE abs((x - mu) / (sd + 1e-9)) > 3) AS z_outliers, "
            "count(*) FILTER (WHERE x < qa - 1.5 * (qc - qa) OR x > qc + 1.5 * (qc - qa)) AS iqr_outliers, "
            "NULL::DOUBLE AS avg_length, NULL::BIGINT AS spaced, NULL::BIGINT AS numberlike, NULL::BIGINT AS numberlike_any, NULL::BIGINT AS castable "
        )
        inner = f"(SELECT CAST({q} AS DOUBLE) AS x FROM {source})"
        frm = (
            f"FROM {inner} CROSS JOIN (SELECT quantile_cont(x, 0.25) AS qa, quantile_cont(x, 0.5) AS qb, quantile_cont(x, 0.75) AS qc, "
            f"avg(x) AS mu, stddev_samp(x) AS sd FROM {inner})"
        )
        return head + counts + mid + frm
    nulls = (
        "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS var, NULL::DOUBLE AS std_pop, NULL::DOUBLE AS min, NULL::DOUBLE AS max, "
        "NULL::DOUBLE AS skew, NULL::DOUBLE AS kurt, NULL::BIGINT AS zeros, NULL::BIGINT AS negatives, NULL::BOOLEAN AS is_unit, "
        "NULL::BIGINT AS integers, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::BIGINT AS z_outliers, NULL::BIGINT AS iqr_outliers, "
    )
    if kind == "string":
        text = (
            "avg(length(x)) AS avg_length, count(*) FILTER (WHERE contains(x, ' ')) AS spaced, "
            "count(*) FILTER (WHERE regexp_matches(replace(replace(x, '.', ''), '-', ''), '^[0-9]+$') "
            "AND length(x) - length(replace(x, '.', '')) <= 1 AND length(x) - length(replace(x, '-', '')) <= 1) AS numberlike, "
            "count(*) FILTER (WHERE regexp_matches(replace(replace(x, '.', ''), '-', ''), '^[0-9]+$')) AS numberlike_any, "
            "count(TRY_CAST(x AS DOUBLE)) AS castable "
        )
    else:
        text = "NULL::DOUBLE AS avg_length, NULL::BIGINT AS spaced, NULL::BIGINT AS numberlike, NULL::BIGINT AS numberlike_any, NULL::BIGINT AS castable "
    return head + counts + nulls + text + f"FROM (SELECT {q} AS x FROM {source})"


KINDS = {
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
    "orders_nulls": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
    "orders_dirty": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s memo:s constant_col:i",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:d",
    "lineitem_numbers": "l_linenumber:i l_quantity:n l_extendedprice:n l_discount:n l_tax:n",
    "lineitem_wide": "l_returnflag:s " + " ".join(f"w{i}:n" for i in range(1, 19)),
    "lineitem_skew": "l_orderkey:i l_linenumber:i l_quantity:n skewed:n mirrored:n squared:n l_extendedprice:n price_copy:n l_discount:n l_returnflag:s",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:n",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:n",
    "part_mixed": "p_partkey:i p_brand:s p_type:s p_size:i p_retailprice:n mixed:s size_text:s is_even:b",
    "events": "event_id:i ts:d user_id:i event_type:s value:n props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "labels": "doc_id:i quality:i toxic:i",
    "documents_labels": "doc_id:i lang:s source:s n_chars:i spaces:i toxic:i quality:i",
    "nation_region": "n_nationkey:i n_name:s n_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
_KIND = {"i": "numeric", "n": "numeric", "s": "string", "d": "datetime", "b": "boolean"}


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(p.rsplit(":", 1)) for p in KINDS[name].split()]


def numeric_of(name: str) -> list[str]:
    return [n for n, k in columns_of(name) if k in "in"]


def facts_sql(name: str) -> str:
    """CTE text ``facts AS (...)`` with one row per column of an input."""
    rows = [fact_row(src(name), i, n, _KIND[k], k == "i") for i, (n, k) in enumerate(columns_of(name))]
    return "facts AS (" + " UNION ALL ".join(rows) + ")"


def over_facts(name: str, select: str, where: str = "true") -> str:
    return f"WITH {facts_sql(name)} SELECT {select} FROM facts WHERE {where}"


def corr_sql(name: str, cols: list[str] | None = None) -> str:
    """Rows (i, j, feature_1, feature_2, r) for every numeric pair; null r for a constant side."""
    cols = cols or numeric_of(name)
    out = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            qa, qb = f"CAST({quote(a)} AS DOUBLE)", f"CAST({quote(b)} AS DOUBLE)"
            out.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_1, '{b}' AS feature_2, CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 THEN NULL ELSE corr(x, y) END AS r "
                f"FROM (SELECT {qa} AS x, {qb} AS y FROM {src(name)}) WHERE x IS NOT NULL AND y IS NOT NULL"
            )
    return " UNION ALL ".join(out)


class Registry:
    """Collects queries and their oracles under one name each."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, fn, sql: str | None = None):
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = fn
        if sql is not None:
            self.oracles[name] = sql
