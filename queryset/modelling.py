"""Registered queries: splits, metrics, score tables, MLlib models, anomalies, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.base import Registry, r4, read, src
from queryset.preparing import iqr_filter_sql
from tablefit.functions.exprs import rounded
from tablefit.operators import anomaly as A
from tablefit.operators import cluster as K
from tablefit.operators import issues as I
from tablefit.operators import scoring as SC
from tablefit.operators import training as TR
from tablefit.operators.facts import small_table
from tablefit.sources.tables import settle

REG = Registry()

_rn = "row_number() OVER (PARTITION BY {y} ORDER BY md5(CAST({k} AS VARCHAR)))"
for t, y, k in (("labels", "toxic", "doc_id"), ("orders", "o_orderstatus", "o_orderkey")):
    rn = _rn.format(y=y, k=k)
    REG.add(
        f"split_{t}", lambda spark, sf, t=t, y=y, k=k: SC.split(read(spark, sf, f"SELECT {k}, {y} FROM {{{t}}}"), [k], y, 0.2),
        f"SELECT {k}, {y}, {rn} <= ceil(0.2 * count(*) OVER (PARTITION BY {y})) AS is_test FROM {t}",
    )
    REG.add(
        f"folds_{t}", lambda spark, sf, t=t, y=y, k=k: SC.folds(read(spark, sf, f"SELECT {k}, {y} FROM {{{t}}}"), [k], 5, y),
        f"SELECT {k}, {y}, CAST(({rn} - 1) % 5 AS INT) AS fold FROM {t}",
    )

# rule-based predictions give metrics something to measure without a model
_pred = "SELECT CAST(l.quality AS DOUBLE) AS label, CASE WHEN d.n_chars > 400 THEN 1.0 ELSE 0.0 END AS prediction, CAST(d.n_chars AS DOUBLE) AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
_flags = "SELECT l_returnflag AS label, CASE WHEN l_shipdate < timestamp '1995-06-17 00:00:00' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END ELSE 'N' END AS prediction FROM {lineitem}"


def metrics_sql(source):
    return (
        f"WITH p AS {src(source)}, c AS (SELECT CAST(label AS VARCHAR) AS cls FROM p UNION SELECT CAST(prediction AS VARCHAR) FROM p), "
        "m AS (SELECT cls, (SELECT count(*) FROM p WHERE CAST(label AS VARCHAR) = cls) AS a, (SELECT count(*) FROM p WHERE CAST(prediction AS VARCHAR) = cls) AS s, (SELECT count(*) FROM p WHERE CAST(label AS VARCHAR) = cls AND label = prediction) AS h FROM c), "
        "n AS (SELECT *, coalesce(h * 1.0 / nullif(s, 0), 0) AS pr, coalesce(h * 1.0 / nullif(a, 0), 0) AS re FROM m), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM n) "
        f"SELECT {r4('sum(h) * 1.0 / sum(a)')} AS accuracy, {r4('sum(pr * a) / sum(a)')} AS precision_weighted, {r4('sum(re * a) / sum(a)')} AS recall_weighted, {r4('sum(f1 * a) / sum(a)')} AS f1_weighted, {r4('avg(f1)')} AS f1_macro FROM f"
    )


REG.add("clf_metrics_labels", lambda spark, sf: SC.clf_metrics(read(spark, sf, _pred)), metrics_sql(_pred))
REG.add("clf_metrics_lineitem", lambda spark, sf: SC.clf_metrics(read(spark, sf, _flags)), metrics_sql(_flags))


def auc_query(spark, sf):
    t = small_table(spark, [(SC.roc_auc(read(spark, sf, _pred), "score"),)], [("roc_auc", "double")])
    return t.withColumn("roc_auc", rounded(F.col("roc_auc")))


REG.add(
    "roc_auc_labels", auc_query,
    f"WITH p AS {src(_pred)}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p) "
    f"SELECT {r4('(sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * 1.0 * count(*) FILTER (WHERE label <> 1))')} AS roc_auc FROM r",
)
_reg = "SELECT l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM {lineitem}"
REG.add(
    "reg_metrics_lineitem", lambda spark, sf: SC.reg_metrics(read(spark, sf, _reg)),
    f"SELECT {r4('1 - avg((label - prediction) ** 2) / var_pop(label)')} AS r2_score, {r4('avg((label - prediction) ** 2)')} AS mse, {r4('sqrt(avg((label - prediction) ** 2))')} AS rmse, {r4('avg(abs(label - prediction))')} AS mae FROM {src(_reg)}",
)
# score tables made of grouped averages of the order lines
_scores = "SELECT l_returnflag AS model, l_linenumber % 5 AS fold, avg(l_discount * (1 + l_linenumber % 5) * CASE l_returnflag WHEN 'A' THEN 0.4 WHEN 'N' THEN 3 ELSE 1 END + 0.3) AS score FROM {lineitem} GROUP BY 1, 2"
for rules, bands in (("simple", "CASE WHEN pct < 5 THEN 'STABLE' WHEN pct < 15 THEN 'MODERATE' ELSE 'UNSTABLE' END"), ("strict", "CASE WHEN pct < 5 THEN 'HIGH' WHEN pct < 10 THEN 'MODERATE' WHEN pct < 20 THEN 'LOW' ELSE 'VERY LOW' END")):
    pct = "CASE WHEN avg(score) > 0 THEN stddev_pop(score) / avg(score) * 100 ELSE 0 END" if rules == "simple" else "stddev_pop(score) / (avg(score) + 1e-9) * 100"
    REG.add(
        f"cv_stability_{rules}", lambda spark, sf, rules=rules: SC.cv_stability(read(spark, sf, _scores), rules),
        f"WITH s AS {src(_scores)}, a AS (SELECT model, avg(score) AS m, stddev_pop(score) AS sd, min(score) AS lo, arg_min(fold, score) AS worst_fold, {pct} AS pct FROM s GROUP BY 1) "
        f"SELECT model, {r4('m')} AS mean_score, {r4('sd')} AS std_dev, {r4('pct', 2)} AS cv_pct, {bands} AS stability, worst_fold, {r4('m - lo')} AS drop_from_mean, m - lo > 0.15 AS worst_fold_warning FROM a",
    )
_gaps = "SELECT p_type AS model, avg(p_retailprice) / 1000 AS train_score, avg(p_retailprice) / 1000 - avg(p_size) / 250.0 * CASE p_type WHEN 'ECONOMY' THEN 0.1 WHEN 'PROMO' THEN 3 ELSE 1 END AS test_score, stddev_pop(p_size) / 250 AS cv_std, avg(p_size) / 300.0 AS curve_gap FROM {part} GROUP BY 1"
for rules, gap, risk in (
    ("simple", "train_score - test_score", "CASE WHEN g < 0.05 THEN 'LOW' WHEN g < 0.15 THEN 'MODERATE' ELSE 'HIGH' END"), ("training", "train_score - test_score", "CASE WHEN g > 0.12 THEN 'HIGH' WHEN g > 0.05 THEN 'MODERATE' ELSE 'LOW' END"),
    ("strict", "abs(train_score - test_score)", "CASE WHEN g > 0.15 OR (cv_std > 0.08 AND curve_gap > 0.15) THEN 'HIGH' WHEN g > 0.05 OR cv_std > 0.05 OR curve_gap > 0.08 THEN 'MODERATE' ELSE 'LOW' END"),
):
    REG.add(f"overfit_bands_{rules}", lambda spark, sf, rules=rules: SC.overfit_bands(read(spark, sf, _gaps), rules), f"SELECT model, {r4('g')} AS train_test_gap, {risk} AS overfitting_risk FROM (SELECT *, {gap} AS g FROM {src(_gaps)})")
_imp = "SELECT p_type AS feature, avg(p_size) / 100.0 * CASE p_type WHEN 'ECONOMY' THEN 0.01 WHEN 'PROMO' THEN 0.1 WHEN 'SMALL' THEN 0.3 ELSE 1 END AS importance, avg(p_retailprice) / 1000 - 0.99 AS permutation FROM {part} GROUP BY 1"
REG.add("importance_tiers_absolute", lambda spark, sf: SC.importance_tiers(read(spark, sf, _imp)), f"SELECT feature, {r4('importance')} AS importance, {r4('permutation')} AS permutation, CASE WHEN importance > 0.1 THEN 'HIGH' WHEN importance > 0.03 THEN 'MODERATE' WHEN importance > 0.005 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS tier, (importance > 0.01) = (permutation > 0) AS methods_agree FROM {src(_imp)}")
REG.add(
    "importance_tiers_relative", lambda spark, sf: SC.importance_tiers(read(spark, sf, _imp), "relative"),
    f"WITH x AS (SELECT *, importance / (max(importance) OVER () + 1e-9) AS s, (permutation - min(permutation) OVER ()) / (max(permutation) OVER () - min(permutation) OVER () + 1e-9) AS q FROM {src(_imp)}) SELECT feature, {r4('importance')} AS importance, {r4('permutation')} AS permutation, "
    "CASE WHEN s >= 0.5 THEN 'HIGH' WHEN s >= 0.15 THEN 'MODERATE' WHEN s >= 0.05 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS tier, abs(s - q) < 0.3 AS methods_agree FROM x",
)
_steps = "SELECT l_linenumber AS step, concat('fix', CAST(l_linenumber AS STRING)) AS fix, avg(l_discount * (l_linenumber % 3 + 1)) AS score FROM {lineitem} GROUP BY 1, 2"
REG.add(
    "step_deltas", lambda spark, sf: SC.step_deltas(read(spark, sf, _steps)),
    f"WITH s AS {src(_steps)}, d AS (SELECT *, coalesce(score - lag(score) OVER (ORDER BY step), 0) AS d, score - first_value(score) OVER (ORDER BY step) AS c FROM s) SELECT step, fix, {r4('score')} AS score, {r4('d')} AS delta, {r4('c')} AS cumulative_delta, "
    "CASE WHEN d > 0.005 THEN 'POSITIVE' WHEN d < -0.005 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS impact FROM d",
)
_runs = "SELECT l_returnflag AS model, l_linestatus AS scaler, l_linenumber % 2 = 0 AS log_transform, avg(l_tax) AS score FROM {lineitem} GROUP BY 1, 2, 3"
REG.add("choice_impact", lambda spark, sf: SC.choice_impact(read(spark, sf, _runs), "scaler").unionByName(SC.choice_impact(read(spark, sf, _runs), "log_transform")), " UNION ALL ".join(f"SELECT '{n}' AS choice, CAST({n} AS VARCHAR) AS value, {r4('avg(score)')} AS avg_score, count(*) AS runs FROM {src(_runs)} GROUP BY {n}" for n in ("scaler", "log_transform")))

# ---- models ------------------------------------------------------------------------------------
_docs = "documents_labels"
REG.add("train_compare_documents", lambda spark, sf: TR.train_compare(read(spark, sf, _docs), "quality", ["doc_id"], detailed=True).drop("training_seconds"))
REG.add("train_compare_part", lambda spark, sf: TR.train_compare(read(spark, sf, "part"), "p_retailprice", ["p_partkey"]).drop("training_seconds"))
REG.add("overfit_documents", lambda spark, sf: TR.overfit(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("learning_curve_documents", lambda spark, sf: TR.learning_curve(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("importance_documents", lambda spark, sf: TR.importance(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("consensus_select_documents", lambda spark, sf: TR.consensus_select(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add(
    "select_k_best_lineitem", lambda spark, sf: TR.select_k_best(read(spark, sf, "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_suppkey, l_returnflag FROM {lineitem}"), "l_returnflag"),
    "WITH f AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, (sum(c * (m - g) * (m - g)) / (count(*) - 1)) / (sum(c * v) / (sum(c) - count(*))) AS f FROM (SELECT l_returnflag, count({n}) AS c, avg({n}) AS m, var_pop({n}) AS v FROM lineitem GROUP BY 1), (SELECT avg({n}) AS g FROM lineitem)"
        for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")) + f") SELECT feature, {r4('f')} AS f_statistic FROM f ORDER BY f DESC LIMIT 3",
)
REG.add("search_documents", lambda spark, sf: TR.search(read(spark, sf, _docs), "quality", ["doc_id"]))
def choices_of_search(spark, sf):
    """Average score by scaler, log and model over the real search."""
    found = settle(TR.search(read(spark, sf, _docs), "quality", ["doc_id"]).where("not is_ensemble"))
    return SC.choice_impact(found, "scaler").unionByName(SC.choice_impact(found, "log_transform")).unionByName(SC.choice_impact(found, "model"))


REG.add("search_choices_documents", choices_of_search)
REG.add("train_importances_documents", lambda spark, sf: TR.train_importances(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("compare_models_orders", lambda spark, sf: TR.compare_models(read(spark, sf, "orders_nulls"), read(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"]))
REG.add("ensembles_documents", lambda spark, sf: TR.ensembles(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("ensembles_part", lambda spark, sf: TR.ensembles(read(spark, sf, "part"), "p_retailprice", ["p_partkey"]))
REG.add("fix_impact_orders", lambda spark, sf: TR.fix_impact(read(spark, sf, "orders_dirty"), "o_orderstatus", ["o_orderkey"]))
REG.add("apply_fixes_documents", lambda spark, sf: TR.apply_fixes(read(spark, sf, _docs), "quality", ["doc_id"], outliers=True, correlated=True, balance=True))
_feat = ["n_chars", "spaces", "toxic"]
REG.add(
    "fix_sizes_documents", lambda spark, sf: TR.fix_sizes(read(spark, sf, _docs), "quality", ["doc_id"], outliers=True, correlated=True, balance=True),
    f"WITH kept AS ({iqr_filter_sql(_docs, 'quality')}), k AS (SELECT quality, count(*) AS c FROM kept WHERE quality IS NOT NULL GROUP BY 1), "
    "gone AS (SELECT DISTINCT b FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS b FROM kept HAVING abs(CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END) > 0.85" for i, a in enumerate(_feat) for b in _feat[i + 1:]) + ")) "
    f"SELECT (SELECT count(*) FROM {src(_docs)}) AS rows_before, CAST(max(c) * count(*) AS BIGINT) AS rows_after, CAST(7 AS BIGINT) AS columns_before, 7 - (SELECT count(*) FROM gone) AS columns_after FROM k",
)
REG.add("fold_stability_documents", lambda spark, sf: TR.fold_stability(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("overfit_risk_documents", lambda spark, sf: SC.overall_risk(TR.overfit(read(spark, sf, _docs), "quality", ["doc_id"])))
REG.add("clean_gain_part", lambda spark, sf: TR.clean_gain(read(spark, sf, "part"), "p_type", ["p_partkey"]))
REG.add("mlp_documents", lambda spark, sf: TR.mlp(read(spark, sf, _docs), "quality", ["doc_id"]))
REG.add("attribution_documents", lambda spark, sf: TR.attribution(read(spark, sf, _docs), "quality", ["doc_id"]).summary())
REG.add("attribution_top_documents", lambda spark, sf: TR.attribution(read(spark, sf, _docs), "quality", ["doc_id"]).top())
REG.add("attribution_top_part", lambda spark, sf: TR.attribution(read(spark, sf, "part"), "p_retailprice", ["p_partkey"]).top())
REG.add("attribution_interactions_documents", lambda spark, sf: TR.attribution(read(spark, sf, _docs), "quality", ["doc_id"]).interactions())

# ---- anomalies and clusters --------------------------------------------------------------------
_prices = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}"
REG.add("anomalies_lineitem", lambda spark, sf: A.anomalies(read(spark, sf, _prices), ["l_orderkey", "l_linenumber"]).select("rows"), "SELECT count(*) AS rows FROM lineitem")
# all columns; a forest has no SQL, tests compare the flagged share with the contamination
REG.add("anomalies_lineitem_whole", lambda spark, sf: A.anomalies(read(spark, sf, _prices), ["l_orderkey", "l_linenumber"]))
REG.add("anomalies_documents", lambda spark, sf: A.anomalies(read(spark, sf, _docs), ["doc_id"], "quality", rules="auto"))
REG.add("anomaly_top_features_lineitem", lambda spark, sf: A.top_features(A.flag_anomalies(read(spark, sf, _prices), ["l_orderkey", "l_linenumber"]).drop("l_orderkey", "l_linenumber")))
REG.add("most_anomalous_lineitem", lambda spark, sf: A.most_anomalous(A.flag_anomalies(read(spark, sf, _prices), ["l_orderkey", "l_linenumber"])))
REG.add("readiness_with_anomalies_orders", lambda spark, sf: I.readiness(read(spark, sf, "orders"), "o_orderpriority", anomalies=A.anomalies(read(spark, sf, "orders"), ["o_orderkey"], "o_orderpriority")))
_flagged = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity > 48 AS odd FROM {lineitem}"
REG.add(
    "deviation_lineitem", lambda spark, sf: A.deviation(read(spark, sf, _flagged), "odd"),
    " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {r4(f'abs(avg({n}) FILTER (WHERE odd) - avg({n}) FILTER (WHERE NOT odd)) / (stddev_samp({n}) FILTER (WHERE NOT odd) + 1e-9)', 3)} AS deviation FROM {src(_flagged)}" for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
_vec = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM {embeddings}"
_vec_duck = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings)"
_dims = [f"e{i}" for i in range(64)]
REG.add("cluster_embeddings", lambda spark, sf: K.cluster(read(spark, sf, _vec), ["vec_id", "label"]))
REG.add("cluster_stability_embeddings", lambda spark, sf: K.cluster_stability(read(spark, sf, _vec), 3, ["vec_id", "label"]))
_cen = "c AS (SELECT label, count(*) AS n, " + ", ".join(f"avg(e{i}) AS m{i}" for i in range(64)) + f" FROM {_vec_duck} GROUP BY 1)"
_dist = "sqrt(" + " + ".join(f"(e{i} - m{i}) ** 2" for i in range(64)) + ")"
_gap = "sqrt(" + " + ".join(f"(a.m{i} - b.m{i}) ** 2" for i in range(64)) + ")"
REG.add(
    "cluster_report_embeddings", lambda spark, sf: K.cluster_report(read(spark, sf, _vec), "label", _dims),
    f"WITH {_cen}, s AS (SELECT label, avg({_dist}) AS d FROM {_vec_duck} JOIN c USING (label) GROUP BY 1), w AS (SELECT a.label, max((x.d + y.d) / {_gap}) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s x ON x.label = a.label JOIN s y ON y.label = b.label GROUP BY 1) "
    f"SELECT CAST(c.label AS VARCHAR) AS cluster, n AS rows, {r4('n * 100.0 / (SELECT sum(n) FROM c)', 2)} AS percent, {r4('d')} AS mean_distance, {r4('(SELECT avg(r) FROM w)')} AS davies_bouldin FROM c JOIN s USING (label)",
)
REG.add(
    "centroid_spread_embeddings", lambda spark, sf: K.centroid_spread(read(spark, sf, _vec), "label", _dims),
    f"WITH {_cen}, v AS (SELECT " + ", ".join(f"stddev_pop(m{i}) AS s{i}" for i in range(64)) + " FROM c), t AS (SELECT " + " + ".join(f"s{i}" for i in range(64)) + " AS total FROM v) "
    + " UNION ALL ".join(f"SELECT 'e{i}' AS \"column\", {r4(f's{i} / total')} AS influence FROM v, t" for i in range(64)),
)
