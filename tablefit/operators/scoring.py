"""Splits, folds, metrics and the bands read from score tables. No model is trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, rounded
from tablefit.functions.ranks import hash_row_number, running_total


def split(df: DataFrame, key: list[str], target: str | None = None, test: float = 0.2) -> DataFrame:
    """Add ``is_test``: the first ceil(test * size) rows of each class in md5 order of the key."""
    t = hash_row_number(df, [target] if target else [], key, "__rn")
    return t.withColumn("is_test", F.col("__rn") <= F.ceil(F.col("__rn_of") * F.lit(test))).drop("__rn", "__rn_of")


def folds(df: DataFrame, key: list[str], k: int, target: str | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt out in md5 order inside each class."""
    t = hash_row_number(df, [target] if target else [], key, "__rn")
    return t.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__rn_of")


def fold_count(n: int) -> int:
    return min(5, max(2, n // 20))


def clf_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, weighted precision/recall/F1 and macro F1 from (label, prediction)."""
    by = by or []
    cells = pred.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    # one record per class: what was there, what was said, what agreed
    entries = F.array(
        F.struct(F.col("label").cast("string").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").cast("string").alias("cls"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )
    per = cells.select(*by, F.explode(entries).alias("e")).groupBy(*by, "e.cls").agg(F.sum("e.actual").alias("actual"), F.sum("e.said").alias("said"), F.sum("e.hit").alias("hit"))
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hit") / F.nullif(F.col("actual"), F.lit(0)), F.lit(0.0))
    per = per.withColumn("p", precision).withColumn("r", recall)
    per = per.withColumn("f", F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0)))
    weighted = lambda m: F.sum(F.col(m) * F.col("actual")) / F.sum("actual")
    return per.groupBy(*by).agg(
        rounded(F.sum("hit") / F.sum("actual")).alias("accuracy"), rounded(weighted("p")).alias("precision_weighted"), rounded(weighted("r")).alias("recall_weighted"),
        rounded(weighted("f")).alias("f1_weighted"), rounded(F.avg("f")).alias("f1_macro"),
    )


def roc_auc(pred: DataFrame, score: str, label: str = "label") -> float | None:
    """Area under the ROC curve by ranks: equal scores share theirs, counted values are sorted in
    range buckets."""
    counted = pred.groupBy(c(score).cast("double").alias("s")).agg(F.count_if(c(label) == 1).alias("pos"), F.count_if(c(label) != 1).alias("neg"))
    run = running_total(counted, [], "s", ["neg"])
    got = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("u")).first()
    return got["u"] / (got["p"] * got["n"]) if got["p"] and got["n"] else None


def reg_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R2, MSE, RMSE and MAE from (label, prediction)."""
    e = F.col("label") - F.col("prediction")
    mse = F.avg(e * e)
    return pred.groupBy(*(by or [])).agg(
        rounded(1 - mse / F.nullif(F.var_pop("label"), F.lit(0.0))).alias("r2_score"), rounded(mse).alias("mse"), rounded(F.sqrt(mse)).alias("rmse"), rounded(F.avg(F.abs(e))).alias("mae"),
    )


def cv_stability(scores: DataFrame, rules: str = "simple") -> DataFrame:
    """Per model over (model, fold, score): mean, population deviation, CV %, stability band and
    the worst fold with a warning when it falls more than 0.15 below the mean."""
    t = scores.groupBy("model").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.min("score").alias("lo"), F.min_by("fold", F.struct("score", "fold")).alias("worst_fold"))
    pct = F.when(F.col("m") > 0, F.col("s") / F.nullif(F.col("m"), F.lit(0.0)) * 100).otherwise(0.0) if rules == "simple" else F.col("s") / (F.col("m") + 1e-9) * 100
    t = t.withColumn("pct", pct)
    band = F.when(F.col("pct") < 5, "STABLE").when(F.col("pct") < 15, "MODERATE").otherwise("UNSTABLE")
    if rules != "simple":
        band = F.when(F.col("pct") < 5, "HIGH").when(F.col("pct") < 10, "MODERATE").when(F.col("pct") < 20, "LOW").otherwise("VERY LOW")
    return t.select(
        "model", rounded(F.col("m")).alias("mean_score"), rounded(F.col("s")).alias("std_dev"), rounded(F.col("pct"), 2).alias("cv_pct"), band.alias("stability"),
        "worst_fold", rounded(F.col("m") - F.col("lo")).alias("drop_from_mean"), (F.col("m") - F.col("lo") > 0.15).alias("worst_fold_warning"),
    )


def overfit_bands(scores: DataFrame, rules: str = "simple") -> DataFrame:
    """Risk per model from (model, train_score, test_score[, cv_std, curve_gap])."""
    gap = F.col("train_score") - F.col("test_score")
    if rules == "simple":
        risk = F.when(gap < 0.05, "LOW").when(gap < 0.15, "MODERATE").otherwise("HIGH")
    elif rules == "training":
        risk = F.when(gap > 0.12, "HIGH").when(gap > 0.05, "MODERATE").otherwise("LOW")
    else:
        gap, sd, cg = F.abs(gap), F.col("cv_std"), F.col("curve_gap")
        risk = F.when((gap > 0.15) | ((sd > 0.08) & (cg > 0.15)), "HIGH").when((gap > 0.05) | (sd > 0.05) | (cg > 0.08), "MODERATE").otherwise("LOW")
    return scores.select("model", rounded(gap).alias("train_test_gap"), risk.alias("overfitting_risk"))


def overall_risk(bands: DataFrame, rules: str = "simple") -> DataFrame:
    high, moderate = (F.count_if(F.col("overfitting_risk") == s) for s in ("HIGH", "MODERATE"))
    out = F.when(high > 0, "HIGH").when(moderate >= (1 if rules == "simple" else 2), "MODERATE").when(moderate > 0, "LOW-MODERATE").otherwise("LOW")
    return bands.agg(out.alias("risk"))


def importance_tiers(t: DataFrame, rules: str = "absolute") -> DataFrame:
    """Tier per feature from (feature, importance, permutation): absolute cuts .1/.03/.005 or cuts
    relative to the largest .5/.15/.05, and whether both measures agree."""
    every = W.partitionBy(F.lit(0))  # one row per feature
    i, p = F.col("importance"), F.col("permutation")
    if rules == "absolute":
        tier = F.when(i > 0.1, "HIGH").when(i > 0.03, "MODERATE").when(i > 0.005, "LOW").otherwise("NEGLIGIBLE")
        agree = (i > 0.01) == (p > 0)
    else:
        share = i / (F.max(i).over(every) + 1e-9)
        tier = F.when(share >= 0.5, "HIGH").when(share >= 0.15, "MODERATE").when(share >= 0.05, "LOW").otherwise("NEGLIGIBLE")
        lo, hi = F.min(p).over(every), F.max(p).over(every)
        hi = F.when(hi == lo, 1.0).otherwise(hi)
        agree = F.abs(share - (p - lo) / (hi - lo + 1e-9)) < 0.3
    return t.select("feature", rounded(i).alias("importance"), rounded(p).alias("permutation"), tier.alias("tier"), agree.alias("methods_agree"))


def step_deltas(steps: DataFrame) -> DataFrame:
    """Per step of (step, fix, score): change to the step before and to the first, impact class."""
    order = W.partitionBy(F.lit(0)).orderBy("step")  # one row per fix
    delta = F.coalesce(F.col("score") - F.lag("score").over(order), F.lit(0.0))
    t = steps.select("step", "fix", "score", delta.alias("d"), (F.col("score") - F.first("score").over(order)).alias("total"))
    impact = F.when(F.col("d") > 0.005, "POSITIVE").when(F.col("d") < -0.005, "NEGATIVE").otherwise("NEUTRAL")
    return t.select("step", "fix", rounded(F.col("score")).alias("score"), rounded(F.col("d")).alias("delta"), rounded(F.col("total")).alias("cumulative_delta"), impact.alias("impact"))


def choice_impact(results: DataFrame, choice: str) -> DataFrame:
    """Average score per value of one choice of a search result."""
    return results.groupBy(F.col(choice).cast("string").alias("value")).agg(rounded(F.avg("score")).alias("avg_score"), F.count(F.lit(1)).alias("runs")).select(F.lit(choice).alias("choice"), "*")
