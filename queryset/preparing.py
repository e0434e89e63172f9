"""Registered queries: sources and sinks, drop rules, cleaning, encoding, plans, features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queryset.base import Registry, columns_of, corr_sql, facts_sql, numeric_of, over_facts, quote, r4, read, src, table
from queryset.profiling import _change, _q, _scaling
from queryset.relations import mi_sql
from tablefit.functions.exprs import c, rounded
from tablefit.operators import clean as C
from tablefit.operators import encode as E
from tablefit.operators import features as X
from tablefit.operators.facts import small_table
from tablefit.plans import modes as M
from tablefit.plans import plan as PL
from tablefit.plans import rules as RU
from tablefit.sources import runs as RN
from tablefit.sources import tables as S

REG = Registry()


def neat(df, digits: int = 4):
    """Round float columns for comparison."""
    return df.select(*[rounded(c(n), digits).alias(n) if t in ("double", "float") else c(n) for n, t in df.dtypes])


# ---- sources and sinks -------------------------------------------------------------------------

def _scratch(spark):
    return f"{S.shared_folder(spark)}/run-{uuid.uuid4().hex}"


def csv_round_trip(name):
    def run(spark, sf):
        path = _scratch(spark)
        S.write_table(read(spark, sf, name), path, "csv")
        back = S.read_table(spark, path, "csv")
        return back.withColumn("size", F.col("size").cast("double")) if "size" in back.columns else back
    return run


REG.add("csv_round_trip_customer", csv_round_trip("customer"), "SELECT * FROM customer")
REG.add(
    "csv_round_trip_orders_nulls", lambda spark, sf: csv_round_trip("orders_nulls")(spark, sf).drop("o_orderdate"),
    f"SELECT * EXCLUDE (o_orderdate) FROM {src('orders_nulls')}",
)
REG.add(
    "csv_null_tokens_part", csv_round_trip("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'N/A' WHEN p_partkey % 3 = 1 THEN 'null' ELSE p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN 'nan' ELSE CAST(p_size AS STRING) END AS size FROM {part}"),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part",
)
REG.add(
    "nan_to_null_part", lambda spark, sf: S.normalise(read(spark, sf, "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS price FROM {part}")),
    "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS price FROM part",
)
REG.add("parquet_scan_supplier", lambda spark, sf: S.read_table(spark, f"{sf}/supplier.parquet"), "SELECT * FROM supplier")


def row_guard(spark, sf):
    rows = []
    for name in ("region", "nation", "orders"):
        for need in (2, 5, 10):
            try:
                S.require_rows(table(spark, sf, name), need)
                ok = True
            except ValueError:
                ok = False
            rows.append((name, need, ok))
    return small_table(spark, rows, [("table", "string"), ("needed", "bigint"), ("enough", "boolean")])


REG.add("row_guard", row_guard, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST({n} AS BIGINT) AS needed, count(*) >= {n} AS enough FROM {t}" for t in ("region", "nation", "orders") for n in (2, 5, 10)))
REG.add(
    "column_types_part_mixed", _q(RU.column_types, "part_mixed"),
    over_facts("part_mixed", "\"column\", kind = 'numeric' AS numeric, kind IN ('string', 'boolean') AS categorical"),
)


def run_log(spark, sf):
    path = _scratch(spark)
    ids = []
    for name, y in (("orders", "o_totalprice"), ("part", "p_retailprice")):
        score = table(spark, sf, name).agg(F.avg(y)).first()[0]
        ids.append(RN.log_run(spark, path, name, "regression", [y], "mean", score, {"mean": score}))
    return RN.compare_runs(spark, path, ids[0], ids[1]).select("table_1", "table_2", rounded(F.col("score_diff")).alias("score_diff"))


REG.add("run_log_compare", run_log, f"SELECT 'orders' AS table_1, 'part' AS table_2, {r4('(SELECT avg(p_retailprice) FROM part) - (SELECT avg(o_totalprice) FROM orders)')} AS score_diff")

# ---- drop rules --------------------------------------------------------------------------------
_share = "\"distinct\" * 1.0 / rows"
_low = "lower(\"column\")"
_clean_id = f"(regexp_matches(replace({_low}, ' ', ''), '(^|_)(id)$|^id_|^(row|index|rowid|passengerid|customerid|userid|recordid)$') OR (is_int AND \"distinct\" = rows AND rows > 10))"
_meta = f"regexp_matches({_low}, '(timestamp|created_at|updated_at|modified_at|date_added)')"


def _case(rules):
    return "CASE " + " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in rules) + " END"


_clean_rules = lambda th, text: [("identifier", _clean_id), ("metadata", _meta), ("missing", f"missing * 1.0 / rows > {th}"), ("constant", "\"distinct\" <= 1")] + (
    [("free_text", f"kind = 'string' AND {_share} > 0.4 AND coalesce(avg_length, 0) > 4")] if text else [])
RULE_SQL = {
    "clean": _case(_clean_rules(0.7, False)), "ml": _case(_clean_rules(0.6, True)),
    "simple": _case([
        ("identifier", f"regexp_matches({_low}, '^id$|.*_id$|^id_|.*uuid.*|.*index$|^row') AND {_share} > 0.9"), ("metadata", f"regexp_matches({_low}, 'timestamp|created|updated')"),
        ("text", f"regexp_matches({_low}, '.*name$|.*address.*|.*email.*|.*description.*|.*comment.*') AND kind = 'string' AND {_share} > 0.5"), ("missing", "missing * 1.0 / rows > 0.6"),
        ("constant", "\"distinct\" <= 1"), ("high_cardinality", "kind = 'string' AND \"distinct\" > 50")]),
    "strict": _case([
        ("identifier", f"regexp_matches({_low}, '^id$|.*_id$|^id_.*|.*uuid.*|.*index.*|^row.*num.*|.*serial.*|.*ticket.*|.*ref.*num.*')"), ("near_unique", f"kind = 'string' AND {_share} > 0.95"),
        ("text", f"kind = 'string' AND regexp_matches({_low}, '.*name$|.*address.*|.*email.*|.*phone.*|.*description.*|.*comment.*|.*note.*')"),
        ("metadata", f"regexp_matches({_low}, '.*timestamp.*|.*created.*at.*|.*updated.*at.*|.*date.*|.*time.*')"), ("missing", "missing * 1.0 / rows > 0.6"), ("constant", "\"distinct\" <= 1")]),
    "near_unique": _case([("near_unique", f"{_share} > 0.95")]),
}
for rules, names in (("clean", ["orders_dirty", "documents"]), ("ml", ["customer", "documents"]), ("simple", ["events", "customer"]), ("strict", ["events", "orders_dirty"]), ("near_unique", ["documents"])):
    for name in names:
        REG.add(f"drop_rules_{rules}_{name}", _q(RU.drop_rules, name, rules), f"WITH {facts_sql(name)} SELECT * FROM (SELECT \"column\", {RULE_SQL[rules]} AS reason FROM facts) WHERE reason IS NOT NULL")
REG.add(
    "rule_flags_events", _q(RU.rule_flags, "events"),
    over_facts(
        "events",
        f"\"column\", regexp_matches(replace({_low}, ' ', ''), '(^|_)(id)$|^id_|^(row|index|rowid|passengerid|customerid|userid|recordid)$') AS id_name, is_int AND \"distinct\" = rows AND rows > 10 AS id_unique, {_meta} AS meta_name, "
        f"missing * 1.0 / rows > 0.7 AS missing_over_70, missing * 1.0 / rows > 0.6 AS missing_over_60, \"distinct\" <= 1 AS constant, kind = 'string' AND {_share} > 0.4 AND coalesce(avg_length, 0) > 4 AS free_text, {_share} > 0.95 AS near_unique",
    ),
)


def select_sql(name, y):
    types = (
        f"CASE WHEN kind = 'datetime' THEN 'datetime' WHEN {_share} > 0.9 AND regexp_matches({_low}, '(^|_)?id$') THEN 'id' WHEN kind = 'string' AND {_share} > 0.5 AND avg_length > 10 AND spaced * 1.0 / present > 0.5 THEN 'text' "
        f"WHEN \"distinct\" = 2 THEN 'binary' WHEN kind <> 'numeric' OR (is_int AND {_share} < 0.05) THEN CASE WHEN {_share} < 0.05 OR \"distinct\" < 15 THEN 'categorical_low' WHEN {_share} <= 0.3 THEN 'categorical_medium' ELSE 'categorical_high' END "
        "WHEN is_int OR integers = present THEN 'numeric_int' ELSE 'numeric_float' END"
    )
    rescue = "CASE WHEN s > 0.1 AND missing * 1.0 / rows < 0.99 THEN 'keep' ELSE 'drop' END"
    return (
        f"WITH {facts_sql(name)}, sig AS (SELECT CASE WHEN feature_1 = '{y}' THEN feature_2 ELSE feature_1 END AS \"column\", abs(coalesce(r, 0)) AS s FROM ({corr_sql(name)}) WHERE '{y}' IN (feature_1, feature_2) "
        f"UNION ALL SELECT feature, least(mutual_information / 0.5, 1) FROM ({mi_sql(name, y)}) WHERE feature NOT IN ({', '.join(repr(n) for n in numeric_of(name))})), "
        f"t AS (SELECT facts.*, {types} AS semantic_type, coalesce(s, 0) AS s FROM facts LEFT JOIN sig USING (\"column\") WHERE \"column\" <> '{y}') "
        f"SELECT \"column\", semantic_type, CASE WHEN \"distinct\" <= 1 THEN 'drop' WHEN missing * 1.0 / rows > 0.7 THEN {rescue} WHEN semantic_type = 'id' THEN CASE WHEN s < 0.05 THEN 'drop' ELSE 'keep' END WHEN semantic_type = 'text' THEN {rescue} "
        f"WHEN semantic_type = 'categorical_high' THEN CASE WHEN s < 0.02 THEN {rescue} ELSE 'encode' END WHEN missing > 0 THEN 'impute' ELSE 'keep' END AS action FROM t"
    )


for name, y in (("documents_labels", "quality"), ("part", "p_retailprice")):
    if name == "part":
        continue
    REG.add(f"select_columns_{name}", _q(RU.select_columns, name, y), select_sql(name, y))

# ---- rows --------------------------------------------------------------------------------------
REG.add("dedupe_orders_dirty", _q(C.dedupe, "orders_dirty"), f"SELECT DISTINCT * FROM {src('orders_dirty')}")
REG.add("dedupe_document_texts", lambda spark, sf: C.dedupe(read(spark, sf, "SELECT text, lang FROM {documents}")), "SELECT DISTINCT text, lang FROM documents")
REG.add("complete_rows_orders_nulls", lambda spark, sf: read(spark, sf, "orders_nulls").dropna(), f"SELECT * FROM {src('orders_nulls')} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")


def _bounds(name, cols):
    return ", ".join(f"quantile_cont({n}, 0.25) AS a_{n}, quantile_cont({n}, 0.75) AS b_{n}" for n in cols) + f" FROM {src(name)}"


def iqr_filter_sql(name, y=None, digits=4):
    cols = [n for n in numeric_of(name) if n != y]
    out = " OR ".join(f"(b_{n} > a_{n} AND coalesce({n} < a_{n} - 1.5 * (b_{n} - a_{n}) OR {n} > b_{n} + 1.5 * (b_{n} - a_{n}), false))" for n in cols)
    vals = ", ".join(f"{r4(n, digits)} AS {n}" if k == "n" else n for n, k in columns_of(name))
    return f"WITH q AS (SELECT {_bounds(name, cols)}), m AS (SELECT t.*, {out} AS gone FROM {src(name)} t, q) SELECT {vals} FROM m WHERE NOT gone OR (SELECT count(*) FILTER (WHERE gone) * 1.0 / count(*) FROM m) >= 0.15"


for name in ("customer", "lineitem_skew", "documents_labels"):
    REG.add(f"drop_iqr_outliers_{name}", lambda spark, sf, name=name: neat(C.drop_iqr_outliers(read(spark, sf, name))), iqr_filter_sql(name))
_cols = numeric_of("lineitem_skew")
_key = ["l_orderkey", "l_linenumber"]
_sc = [n for n in _cols if n not in _key]
REG.add(
    "row_outlier_score_lineitem_skew", lambda spark, sf: neat(C.row_outlier_score(read(spark, sf, "lineitem_skew"), _key)),
    "WITH q AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in _sc) + f", {_bounds('lineitem_skew', _sc)}) SELECT l_orderkey, l_linenumber, "
    + "CAST(" + " + ".join(f"CASE WHEN {n} < a_{n} - 1.5 * (b_{n} - a_{n}) OR {n} > b_{n} + 1.5 * (b_{n} - a_{n}) THEN 1 ELSE 0 END" for n in _sc) + " AS BIGINT) AS columns_outside, "
    + r4("greatest(0, " + ", ".join(f"abs(({n} - m_{n}) / (s_{n} + 1e-9))" for n in _sc) + ")") + f" AS max_abs_z FROM {src('lineitem_skew')}, q",
)
REG.add(
    "drop_correlated_lineitem_skew", lambda spark, sf: neat(C.drop_correlated(read(spark, sf, "lineitem_skew"))),
    f"SELECT l_orderkey, l_linenumber, {r4('l_quantity')} AS l_quantity, {r4('skewed')} AS skewed, {r4('l_discount')} AS l_discount, l_returnflag, {r4('l_extendedprice')} AS l_extendedprice FROM {src('lineitem_skew')}",
)
_copies = "FROM (SELECT *, row_number() OVER (PARTITION BY {y} ORDER BY md5(CAST({k} AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY {y}) AS n FROM {t}), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM {t} GROUP BY {y}))"
for t, y, k in (("orders", "o_orderstatus", "o_orderkey"), ("labels", "toxic", "doc_id")):
    REG.add(
        f"oversample_{t}", lambda spark, sf, t=t, y=y, k=k: C.oversample(read(spark, sf, t), y, [k]).groupBy(k, y).agg(F.count(F.lit(1)).alias("copies")),
        f"SELECT {k}, {y}, CAST(floor(m / n) + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS BIGINT) AS copies {_copies.format(y=y, k=k, t=t)}",
    )

# ---- fills and transforms ----------------------------------------------------------------------

def fill_expr(name, n, kind, how):
    q = quote(n)
    if how == "none":
        return q
    if how == "mean":
        return f"coalesce({q}, (SELECT avg({q}) FROM {src(name)}))"
    if how == "median":
        return f"coalesce({q}, (SELECT quantile_cont({q}, 0.5) FROM {src(name)}))"
    if how == "mode":
        return f"coalesce({q}, (SELECT {q} FROM {src(name)} WHERE {q} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, CAST({q} AS VARCHAR) LIMIT 1))"
    return f"coalesce({q}, 'Unknown')"


def projection(name, new, drop=()):
    """Columns of an input with some replaced; floats rounded."""
    out = []
    for n, k in columns_of(name):
        if n in drop:
            continue
        e = new.get(n, quote(n))
        out.append(f"{r4(e)} AS {quote(n)}" if k == "n" or (n in new and k == "i") else f"{e} AS {quote(n)}")
    return ", ".join(out)


_fills = {"o_totalprice": "mean", "o_orderpriority": "mode"}
REG.add(
    "impute_auto_orders_nulls", lambda spark, sf: neat(C.impute_auto(read(spark, sf, "orders_nulls"))),
    f"SELECT {projection('orders_nulls', {n: fill_expr('orders_nulls', n, None, h) for n, h in _fills.items()})} FROM {src('orders_nulls')}",
)
REG.add(
    "impute_median_orders_nulls", lambda spark, sf: neat(C.impute_auto(read(spark, sf, "orders_nulls"), None, "median")),
    f"SELECT {projection('orders_nulls', {'o_totalprice': fill_expr('orders_nulls', 'o_totalprice', None, 'median'), 'o_orderpriority': fill_expr('orders_nulls', 'o_orderpriority', None, 'mode')})} FROM {src('orders_nulls')}",
)
REG.add(
    "impute_plan_orders_dirty", lambda spark, sf: neat(C.impute(read(spark, sf, "orders_dirty"), {"o_totalprice": "median", "o_orderpriority": "constant", "memo": "drop"})),
    f"SELECT {projection('orders_dirty', {'o_totalprice': fill_expr('orders_dirty', 'o_totalprice', None, 'median'), 'o_orderpriority': fill_expr('orders_dirty', 'o_orderpriority', None, 'constant')}, ['memo'])} FROM {src('orders_dirty')}",
)
REG.add(
    "missing_flag_orders_nulls", lambda spark, sf: C.missing_flag(read(spark, sf, "orders_nulls"), ["o_totalprice", "o_orderpriority"]),
    f"SELECT *, CAST(o_totalprice IS NULL AS INT) AS o_totalprice_missing, CAST(o_orderpriority IS NULL AS INT) AS o_orderpriority_missing FROM {src('orders_nulls')}",
)
_ls = src("lineitem_skew")
REG.add("log_transform_lineitem_skew", lambda spark, sf: neat(C.log_transform(read(spark, sf, "lineitem_skew"))), f"SELECT {projection('lineitem_skew', {'skewed': 'ln(1 + skewed)'})} FROM {_ls}")
REG.add(
    "transform_plan_lineitem_skew", lambda spark, sf: neat(C.transform(read(spark, sf, "lineitem_skew"), {"skewed": "log1p", "squared": "sqrt", "mirrored": "reflect_log1p"})),
    f"SELECT {projection('lineitem_skew', {'skewed': 'ln(1 + skewed)', 'squared': 'sqrt(squared)', 'mirrored': f'ln(1 + (SELECT max(mirrored) FROM {_ls}) - mirrored)'})} FROM {_ls}",
)
_wn = ["l_quantity", "skewed", "l_extendedprice"]
REG.add(
    "winsorize_lineitem_skew", lambda spark, sf: neat(C.winsorize(read(spark, sf, "lineitem_skew"), cols=_wn)),
    f"SELECT {projection('lineitem_skew', {n: f'least(greatest({n}, lo_{n}), hi_{n})' for n in _wn})} FROM {_ls}, (SELECT " + ", ".join(f"quantile_cont({n}, 0.01) AS lo_{n}, quantile_cont({n}, 0.99) AS hi_{n}" for n in _wn) + f" FROM {_ls})",
)

# ---- encoders ----------------------------------------------------------------------------------

def _label(n, source, null="nan"):
    return f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(CAST({n} AS VARCHAR), '{null}') AS v FROM {source}))"


REG.add(
    "encode_binary_lineitem", lambda spark, sf: E.encode_binary(read(spark, sf, "SELECT l_orderkey, l_linenumber, l_linestatus FROM {lineitem}"), "l_linestatus"),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS l_linestatus FROM lineitem",
)
_prios = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REG.add(
    "one_hot_orders_nulls", lambda spark, sf: E.one_hot(read(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}"), ["o_orderpriority"]),
    "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderkey % 7 <> 0 AND o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in _prios) + " FROM orders",
)
REG.add(
    "encode_freq_rank_part", lambda spark, sf: E.encode_freq_rank(read(spark, sf, "SELECT p_partkey, p_brand FROM {part}"), "p_brand"),
    "SELECT p_partkey, code AS p_brand FROM part JOIN (SELECT p_brand AS v, dense_rank() OVER (ORDER BY count(*) DESC) AS code FROM part GROUP BY 1) ON v = p_brand",
)
for n, t, k in (("p_name", "part", "p_partkey"), ("c_name", "customer", "c_custkey"), ("text", "documents", "doc_id")):
    REG.add(
        f"encode_freq_{t}", lambda spark, sf, n=n, t=t, k=k: neat(E.encode_freq(read(spark, sf, f"SELECT {k}, {n} FROM {{{t}}}"), n), 6),
        f"SELECT {k}, {r4(f'count(*) OVER (PARTITION BY {n}) * 1.0 / count(*) OVER ()', 6)} AS {n} FROM {t}",
    )
    REG.add(
        f"encode_label_{t}", lambda spark, sf, n=n, t=t, k=k: E.encode_label(read(spark, sf, f"SELECT {k}, {n} FROM {{{t}}}"), n),
        f"SELECT {k}, code AS {n} FROM {t} JOIN {_label(n, t)} ON v = {n}",
    )
REG.add(
    "encode_label_nulls_orders", lambda spark, sf: E.encode_label(read(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}"), "o_orderpriority"),
    f"SELECT o_orderkey, code AS o_orderpriority FROM {src('orders_nulls')} JOIN {_label('o_orderpriority', src('orders_nulls'))} ON v = coalesce(o_orderpriority, 'nan')",
)
REG.add(
    "encode_target_part", lambda spark, sf: neat(E.encode_target(read(spark, sf, "SELECT p_partkey, p_brand, p_retailprice FROM {part}"), "p_brand", "p_retailprice")),
    f"SELECT p_partkey, {r4('avg(p_retailprice) OVER (PARTITION BY p_brand)')} AS p_brand, {r4('p_retailprice')} AS p_retailprice FROM part",
)
REG.add(
    "encode_hash_customer", lambda spark, sf: E.encode_hash(read(spark, sf, "SELECT c_custkey, c_name FROM {customer}"), "c_name"),
    "SELECT c_custkey, CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 32 AS c_name FROM customer",
)


def encoded_sql(name, how, keep, source=None):
    """Projection of an input with per-column encodings: label, hot, share, bool, zero."""
    source = source or src(name)
    cols, joins = [], []
    for n in keep:
        h = how.get(n)
        q = quote(n)
        if h == "label":
            joins.append(f"JOIN {_label(q, source)} L_{n} ON L_{n}.v = coalesce(CAST({q} AS VARCHAR), 'nan')")
            cols.append(f"L_{n}.code AS {q}")
        elif h == "share":
            cols.append(f"{r4(f'count(*) OVER (PARTITION BY {q}) * 1.0 / count({q}) OVER ()')} AS {q}")
        elif h == "bool":
            cols.append(f"CAST({q} AS INT) AS {q}")
        elif isinstance(h, list):
            cols += [f"CASE WHEN {q} = '{v}' THEN 1 ELSE 0 END AS {quote(n + '_' + v)}" for v in h]
        else:
            cols.append(f"{q}")
    return f"SELECT {', '.join(cols)} FROM {source} t {' '.join(joins)}"


_types = ["PROMO", "SMALL", "STANDARD"]
REG.add(
    "ensure_numeric_part_mixed", lambda spark, sf: neat(E.ensure_numeric(read(spark, sf, "part_mixed").drop("p_type"))),
    encoded_sql("part_mixed", {"p_brand": "share", "mixed": "share", "size_text": "share", "is_even": "bool"}, ["p_partkey", "p_brand", "p_size", "p_retailprice", "mixed", "size_text", "is_even"]).replace('"p_retailprice"', f"{r4('p_retailprice')} AS p_retailprice", 1),
)
for fn, label, expr in (
    (E.scale_standard, "standard", "({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1 ELSE stddev_pop({n}) OVER () END"),
    (E.scale_minmax, "minmax", "({n} - min({n}) OVER ()) * 1.0 / CASE WHEN max({n}) OVER () = min({n}) OVER () THEN 1 ELSE max({n}) OVER () - min({n}) OVER () END"),
    (E.scale_robust, "robust", "({n} - (SELECT quantile_cont({n}, 0.5) FROM {t})) / (SELECT CASE WHEN quantile_cont({n}, 0.75) = quantile_cont({n}, 0.25) THEN 1 ELSE quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) END FROM {t})"),
):
    for name in ("part", "orders_dirty"):
        cols = [n for n in numeric_of(name) if n not in ("p_partkey", "o_orderkey")]
        new = {n: expr.replace("{n}", n).replace("{t}", src(name)) for n in cols}
        REG.add(f"scale_{label}_{name}", lambda spark, sf, fn=fn, name=name, cols=cols: neat(fn(read(spark, sf, name), cols)), f"SELECT {projection(name, new)} FROM {src(name)}")

# ---- plans and modes ---------------------------------------------------------------------------

def plan_sql(name, y, rules):
    enc = ["LabelEncoding", "OneHotEncoding", "OrdinalEncoding", "drop"] if rules == "simple" else ["LabelEncoding", "OneHotEncoding", "TargetEncoding", "HashEncoding"]
    encode = f"CASE WHEN \"distinct\" = 2 THEN '{enc[0]}' WHEN \"distinct\" <= 10 THEN '{enc[1]}' WHEN \"distinct\" <= 50 THEN '{enc[2]}' ELSE '{enc[3]}' END"
    simple_fill = "CASE WHEN missing = 0 THEN 'none' WHEN kind = 'numeric' AND abs(skew) > 1 THEN 'median' WHEN kind = 'numeric' THEN 'mean' ELSE 'mode' END"
    strict_fill = f"CASE WHEN missing = 0 THEN 'none' WHEN missing * 1.0 / rows > 0.6 THEN 'drop' WHEN kind = 'numeric' AND abs(skew) > 1 THEN 'median' WHEN kind = 'numeric' THEN 'mean' WHEN {_share} < 0.05 THEN 'mode' ELSE 'constant' END"
    text = "kind = 'string'" if rules == "simple" else "kind <> 'numeric'"
    return (
        f"WITH {facts_sql(name)}, k AS (SELECT *, {RULE_SQL[rules]} AS reason FROM facts WHERE \"column\" <> '{y}'), s AS ("
        f"SELECT \"column\", 'drop' AS step, 'drop' AS strategy, reason FROM k WHERE reason IS NOT NULL UNION ALL SELECT \"column\", 'impute', {simple_fill if rules == 'simple' else strict_fill}, '' FROM k WHERE reason IS NULL "
        f"UNION ALL SELECT \"column\", 'encode', {encode}, '' FROM k WHERE reason IS NULL AND {text} UNION ALL SELECT \"column\", 'transform', {_change[rules]}, '' FROM k WHERE reason IS NULL AND kind = 'numeric' "
        f"UNION ALL SELECT \"column\", 'scale', {_scaling[rules]}, '' FROM k WHERE reason IS NULL AND kind = 'numeric') SELECT * FROM s WHERE strategy <> 'none'"
    )


for rules in ("simple", "strict"):
    for name, y in (("orders_dirty", "o_orderstatus"), ("lineitem_skew", "l_returnflag")):
        REG.add(f"plan_{rules}_{name}", _q(PL.plan_table, name, y, rules), plan_sql(name, y, rules))
    name, y = "orders_dirty", "o_orderstatus"
    one = lambda s: f"(SELECT count(*) FROM p WHERE step = '{s}')"
    REG.add(
        f"plan_summary_{rules}_{name}", _q(PL.plan_summary, name, y, rules),
        f"WITH p AS ({plan_sql(name, y, rules)}) SELECT CAST(7 AS BIGINT) AS total_features, {one('drop')} AS dropped, CAST(4 AS BIGINT) AS numeric_features, CAST(3 AS BIGINT) AS categorical_features, "
        f"{one('impute')} AS needing_imputation, {one('encode')} AS needing_encoding, {one('scale')} AS needing_scaling, {one('transform')} AS needing_transform",
    )
_od = src("orders_dirty")
_z = lambda e: r4(f"({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER ()")
_hot = ", ".join(f"CASE WHEN coalesce(o_orderpriority, (SELECT o_orderpriority FROM {_od} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in _prios)
_price = f"coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {_od}))"
_apply = (
    f"SELECT {_z('o_orderkey')} AS o_orderkey, {_z('o_custkey')} AS o_custkey, code AS o_orderstatus, {_z(_price)} AS o_totalprice, o_orderdate, {_hot} "
    f"FROM {_od} JOIN {_label('o_orderstatus', _od)} ON v = o_orderstatus"
)
REG.add("apply_plan_orders_dirty", lambda spark, sf: (lambda d: neat(PL.apply_plan(d, PL.build_plan(d, "o_orderstatus"))))(read(spark, sf, "orders_dirty")), _apply)


def saved_plan(spark, sf):
    df, path = read(spark, sf, "orders_dirty"), _scratch(spark)
    PL.fit_plan(df, PL.build_plan(df, "o_orderstatus")).save(path)
    return neat(PL.Fitted.load(spark, path).apply(df))


REG.add("save_load_plan_orders_dirty", saved_plan, _apply)
REG.add(
    "plan_stats_orders_dirty", lambda spark, sf: (lambda d: PL.plan_stats(d, PL.build_plan(d, "o_orderstatus")))(read(spark, sf, "orders_dirty")),
    f"SELECT count(*) AS rows_before, CAST(8 AS BIGINT) AS columns_before, count(*) AS rows_after, CAST(9 AS BIGINT) AS columns_after, CAST(2 AS BIGINT) AS columns_dropped, "
    f"CAST(sum(CAST(o_totalprice IS NULL AS INT) + CAST(o_orderpriority IS NULL AS INT) + CAST(memo IS NULL AS INT)) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after, false AS all_numeric FROM {_od}",
)
REG.add(
    "plan_log_orders_dirty", lambda spark, sf: (lambda d: PL.fit_plan(d, PL.build_plan(d, "o_orderstatus")).log().select("column", "step", "strategy"))(read(spark, sf, "orders_dirty")),
    f"SELECT \"column\", CASE WHEN step = 'encode' THEN 'onehot' ELSE step END AS step, strategy FROM ({plan_sql('orders_dirty', 'o_orderstatus', 'simple')}) UNION ALL SELECT 'o_orderstatus', 'lookup', 'LabelEncoding'",
)
_dd = f"(SELECT DISTINCT * FROM {_od})"
_mode = f"(SELECT o_orderpriority FROM {_dd} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
REG.add(
    "clean_orders_dirty", lambda spark, sf: neat(M.clean(read(spark, sf, "orders_dirty"), "o_orderstatus")),
    f"SELECT o_custkey, o_orderstatus, {r4(f'coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {_dd}))')} AS o_totalprice, o_orderdate, coalesce(o_orderpriority, {_mode}) AS o_orderpriority FROM {_dd}",
)
_zz = lambda e, n: f"{r4(f'({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER ()')} AS {quote(n)}"
REG.add(
    "to_ml_orders_dirty", lambda spark, sf: neat(M.to_ml(read(spark, sf, "orders_dirty"), "o_orderstatus")),
    f"SELECT {_zz('o_custkey', 'o_custkey')}, code AS o_orderstatus, {_zz(f'coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {_dd}))', 'o_totalprice')}, "
    + ", ".join(_zz(f"CASE WHEN coalesce(o_orderpriority, {_mode}) = '{p}' THEN 1 ELSE 0 END", f"o_orderpriority_{p}") for p in _prios)
    + f" FROM {_dd} JOIN {_label('o_orderstatus', _dd)} ON v = o_orderstatus",
)
_pm = src("part_mixed")
_sh = lambda n: f"(SELECT {n} AS v_{n}, count(*) * 1.0 / sum(count(*)) OVER () AS s_{n} FROM {_pm} GROUP BY 1)"
REG.add(
    "to_ml_part_mixed", lambda spark, sf: neat(M.to_ml(read(spark, sf, "part_mixed"), "p_type")),
    f"SELECT {_zz('rk', 'p_brand')}, code AS p_type, {_zz('p_size', 'p_size')}, {_zz('p_retailprice', 'p_retailprice')}, {_zz('s_mixed', 'mixed')}, {_zz('size_code', 'size_text')}, {_zz('CAST(is_even AS INT)', 'is_even')} FROM {_pm} "
    f"JOIN (SELECT p_brand AS vb, dense_rank() OVER (ORDER BY count(*) DESC) AS rk FROM {_pm} GROUP BY 1) ON vb = p_brand JOIN {_sh('mixed')} ON v_mixed = mixed "
    f"JOIN (SELECT size_text AS vs, CASE WHEN count(*) OVER () > 50 THEN count(*) * 1.0 / sum(count(*)) OVER () ELSE dense_rank() OVER (ORDER BY count(*) DESC) END AS size_code FROM {_pm} GROUP BY 1) ON vs = size_text JOIN {_label('p_type', _pm)} ON v = p_type",
)
_on = src("orders_nulls")
REG.add(
    "training_frame_orders_nulls", lambda spark, sf: neat(M.training_frame(read(spark, sf, "orders_nulls"), "o_orderstatus")),
    f"SELECT o_orderkey, o_custkey, a.code AS o_orderstatus, {r4(fill_expr('orders_nulls', 'o_totalprice', None, 'median'))} AS o_totalprice, b.code AS o_orderpriority FROM {_on} "
    f"JOIN {_label('o_orderstatus', _on)} a ON a.v = o_orderstatus JOIN {_label('o_orderpriority', _on)} b ON b.v = coalesce(o_orderpriority, 'nan')",
)

# ---- features ----------------------------------------------------------------------------------

def interactions_sql(name, y, logs=()):
    num = [n for n in numeric_of(name) if n != y]
    out = [f"{r4(n)} AS {n}" if k == "n" else n for n, k in columns_of(name)]
    d = {n: f"CAST({n} AS DOUBLE)" for n in num}
    out += [f"{r4(f'{d[a]} * {d[b]}')} AS {a}_x_{b}" for i, a in enumerate(num) for b in num[i + 1:]]
    out += [f"{r4(f'coalesce({d[a]} / nullif({d[b]}, 0), 0)')} AS {a}_div_{b}" for i, a in enumerate(num) for b in num[i + 1:]]
    out += [f"{r4(f'ln(1 + {d[n]})')} AS log_{n}" for n in logs]
    out += [f"{r4(f'{d[n]} * {d[n]}')} AS {n}_sq" for n in num]
    return f"SELECT {', '.join(out)} FROM {src(name)}"


REG.add("interactions_part", lambda spark, sf: neat(X.interactions(read(spark, sf, "part"), "p_retailprice")), interactions_sql("part", "p_retailprice"))
REG.add("interactions_lineitem_numbers", lambda spark, sf: neat(X.interactions(read(spark, sf, "lineitem_numbers"), "l_tax")), interactions_sql("lineitem_numbers", "l_tax"))
_dates = "SELECT o_orderkey, CAST(o_orderdate AS STRING) AS placed, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day_text FROM {orders}"
_part = lambda e, n: f"coalesce(CAST(year({e}) AS INT), 0) AS {n}_year, coalesce(CAST(month({e}) AS INT), 0) AS {n}_month, coalesce(CAST(day({e}) AS INT), 0) AS {n}_day, coalesce(CAST(isodow({e}) - 1 AS INT), 0) AS {n}_dow"
REG.add(
    "date_parts_orders", lambda spark, sf: X.date_parts(read(spark, sf, _dates)).drop("placed"),
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day_text, {_part('o_orderdate', 'placed')}, {_part('CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END', 'day_text')} FROM orders",
)
REG.add("rank_features_documents_labels", _q(X.rank_features, "documents_labels", "quality"))
_gate = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * l_discount + l_tax AS outcome FROM {lineitem}"
REG.add("gated_interactions_lineitem", lambda spark, sf: X.gated_plan(read(spark, sf, _gate), "outcome")[0].transform(neat))


def gate_scores(spark, sf):
    kept = X.gated_plan(read(spark, sf, _gate), "outcome")[1]
    t = small_table(spark, [(n, r) for n, r in kept], [("feature", "string"), ("correlation", "double")])
    return t.withColumn("correlation", rounded(F.col("correlation")))


_g = src(_gate)
_gnum = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_own = " UNION ALL ".join(f"SELECT '{n}' AS n, {i} AS o, abs(corr({n}, outcome)) AS r FROM {_g}" for i, n in enumerate(_gnum))
_cand = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, '{m}' AS m, corr({e}, outcome) AS r FROM {_g}"
    for a in _gnum for b in _gnum if a != b for m, e in (("x", f"{a} * {b}"), ("div", f"{a} / ({b} + 1e-8)"))
)
REG.add(
    "gated_scores_lineitem", gate_scores,
    f"WITH own AS ({_own}), rk AS (SELECT n, row_number() OVER (ORDER BY r DESC, o) AS p, r FROM own), cand AS ({_cand}), "
    "k AS (SELECT a || '__' || m || '__' || b AS feature, c.r, row_number() OVER (ORDER BY x.p, y.p, m DESC) AS pos FROM cand c JOIN rk x ON x.n = a JOIN rk y ON y.n = b WHERE x.p < y.p AND (abs(c.r) > (SELECT max(r) FROM own) OR abs(c.r) > 0.03)) "
    f"SELECT feature, {r4('r')} AS correlation FROM k WHERE pos <= 5",
)
REG.add(
    "extract_map_part", lambda spark, sf: X.extract_map(read(spark, sf, "SELECT p_partkey, p_name FROM {part}"), "p_name", r"^([a-z]+) ", {"small": "S", "large": "L", "red": "colour", "blue": "colour"}, "other", "kind"),
    "SELECT p_partkey, p_name, CASE regexp_extract(p_name, '^([a-z]+) ', 1) WHEN 'small' THEN 'S' WHEN 'large' THEN 'L' WHEN 'red' THEN 'colour' WHEN 'blue' THEN 'colour' ELSE 'other' END AS kind FROM part",
)
REG.add(
    "sum_plus_lineitem", lambda spark, sf: X.sum_plus(read(spark, sf, "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 AS a, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 3 AS DOUBLE) END AS b FROM {lineitem}"), "a", "b"),
    "SELECT *, coalesce(a, 0) + coalesce(b, 0) + 1 AS FamilySize, CAST(coalesce(a, 0) + coalesce(b, 0) = 0 AS INT) AS IsAlone FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 AS a, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 3 AS DOUBLE) END AS b FROM lineitem)",
)
REG.add(
    "first_letter_orders_nulls", lambda spark, sf: X.first_letter(read(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substring(o_orderpriority, 3) END AS words FROM {orders}"), "words"),
    "SELECT o_orderkey, words, coalesce(substr(words, 1, 1), 'U') AS Deck FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substring(o_orderpriority, 3) END AS words FROM orders)",
)
_ages = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size * 3 - 2 AS DOUBLE) END AS age FROM {part}"
REG.add(
    "bin_right_part", lambda spark, sf: X.bin_right(read(spark, sf, _ages), "age"),
    f"SELECT p_partkey, age, CASE WHEN v > 0 AND v <= 12 THEN 0.0 WHEN v > 12 AND v <= 18 THEN 1.0 WHEN v > 18 AND v <= 35 THEN 2.0 WHEN v > 35 AND v <= 60 THEN 3.0 WHEN v > 60 AND v <= 120 THEN 4.0 END::DOUBLE AS AgeBin FROM (SELECT *, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM {src(_ages)})) AS v FROM {src(_ages)})",
)
