"""Model comparison, search, importance and attribution on MLlib."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, hash_key, rounded, row_digest
from tablefit.operators import clean as C
from tablefit.operators import scoring as SC
from tablefit.operators.encode import encode_label
from tablefit.operators.facts import Facts, pair_correlations, small_table
from tablefit.operators.forest import FlatForest, explain_rows, permuted_scores
from tablefit.operators.target import task_of
from tablefit.plans.modes import to_ml, training_frame
from tablefit.plans.rules import drop_rules
from tablefit.sources.tables import settle

SEED = 42


class Frame:
    """Training matrix: key, label, numeric features; stored once because every model reads it."""

    def __init__(self, df, target: str, key: list[str], task: str | None = None, prepared: bool = False, folds: int | None = None):
        f = df if isinstance(df, Facts) else Facts(df)
        self.task = task or task_of(f, target)
        matrix = f.df if prepared else training_frame(f, target)
        self.features = [n for n in matrix.columns if n != target and n not in key]
        ids = [c(k).cast("string").alias(f"__k{i}") for i, k in enumerate(key)]
        label = c(target).cast("double")
        slim = matrix.where(label.isNotNull()).select(*ids, label.alias("label"), *[c(n).cast("double").alias(f"f{i}") for i, n in enumerate(self.features)])
        self.key = [f"__k{i}" for i in range(len(key))]
        self.cols = [f"f{i}" for i in range(len(self.features))]
        self.k = folds or SC.fold_count(f.rows)
        self.data = settle(SC.folds(slim, self.key, self.k, "label" if self.is_clf else None))
        self.classes = self.data.select("label").distinct().count() if self.is_clf else 0
        self.vectors = VectorAssembler(inputCols=self.cols, outputCol="features", handleInvalid="keep").transform(self.data)

    @property
    def is_clf(self) -> bool:
        return self.task.startswith("classification")

    def content(self) -> tuple:
        """Names the matrix whatever the order of its rows: their number and sums of 128-bit digests."""
        digests = self.data.select(*row_digest(self.data))
        return len(self.cols), *digests.agg(F.count(F.lit(1)), *[F.sum(c(d).cast("decimal(38,0)")) for d in digests.columns]).first()

    def score(self, pred: DataFrame) -> float:
        """Weighted F1 or R2."""
        ev = MulticlassClassificationEvaluator(metricName="f1") if self.is_clf else RegressionEvaluator(metricName="r2")
        return ev.evaluate(pred)


def catalogue(frame: Frame, trees: int = 80, weight: bool = False) -> dict:
    """Models by task. Boosting of more than two classes goes through one-vs-rest."""
    if not frame.is_clf:
        return {
            "Ridge Regression": MR.LinearRegression(regParam=1.0, elasticNetParam=0.0), "Decision Tree": MR.DecisionTreeRegressor(maxDepth=6, seed=SEED),
            "Random Forest": MR.RandomForestRegressor(numTrees=trees, maxDepth=8, seed=SEED), "Gradient Boosting": MR.GBTRegressor(maxIter=trees, maxDepth=4, seed=SEED),
        }
    gbt = MC.GBTClassifier(maxIter=trees, maxDepth=4, seed=SEED)
    out = {
        "Logistic Regression": MC.LogisticRegression(maxIter=200), "Decision Tree": MC.DecisionTreeClassifier(maxDepth=6, seed=SEED),
        "Random Forest": MC.RandomForestClassifier(numTrees=trees, maxDepth=8, seed=SEED), "Gradient Boosting": gbt if frame.classes == 2 else MC.OneVsRest(classifier=gbt),
    }
    if weight:
        for name in ("Logistic Regression", "Decision Tree", "Random Forest"):
            out[name] = out[name].setWeightCol("weight")
    return out


def class_weights(data: DataFrame) -> DataFrame:
    """Add ``weight`` = n / (classes * class size); one row per class is broadcast."""
    sizes = data.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    total = sizes.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return data.join(F.broadcast(sizes), "label").withColumn("weight", F.lit(float(total["n"])) / (F.lit(total["k"]) * F.col("cnt"))).drop("cnt")


def fold_scores(frame: Frame, models: dict, parallel: int = 4) -> DataFrame:
    """(model, fold, score, train_score, seconds) of every model on every fold; fits run side by side."""
    def one(name: str, i: int) -> tuple:
        model = models[name].copy()  # a fit sets parameters of the object it is called on
        train, test = frame.vectors.where(F.col("fold") != i), frame.vectors.where(F.col("fold") == i)
        if model.hasParam("weightCol") and model.isDefined(model.getParam("weightCol")) and model.getOrDefault("weightCol") == "weight":
            train = class_weights(train)
        t0 = time.time()
        fitted = model.fit(train)
        took = time.time() - t0
        return name, i, float(frame.score(fitted.transform(test))), float(frame.score(fitted.transform(train))), took

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(lambda job: one(*job), [(name, i) for name in models for i in range(frame.k)]))
    return small_table(frame.data.sparkSession, rows, [("model", "string"), ("fold", "int"), ("score", "double"), ("train_score", "double"), ("seconds", "double")])


def train_compare(df, target: str, key: list[str], trees: int = 80, folds: int | None = None, detailed: bool = False) -> DataFrame:
    """Cross-validated comparison of the catalogue; best and most stable model are marked.
    ``detailed`` weights classes when the imbalance ratio exceeds 3 and adds the train gap band."""
    frame = Frame(df, target, key, folds=folds)
    weight = False
    if detailed and frame.is_clf:
        got = frame.data.groupBy("label").count().agg(F.max("count").alias("hi"), F.min("count").alias("lo")).first()
        weight = got["hi"] / got["lo"] > 3
    t = fold_scores(frame, catalogue(frame, trees, weight)).groupBy("model").agg(
        F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.avg("train_score").alias("t"), F.sum("seconds").alias("sec"))
    every = W.partitionBy(F.lit(0))  # one row per model
    rel = F.when(F.col("m") > 0, F.col("s") / F.col("m"))
    gap = F.col("t") - F.col("m")
    return t.select(
        "model", F.lit("f1_weighted" if frame.is_clf else "r2").alias("metric"), rounded(F.col("m")).alias("cv_mean"), rounded(F.col("s")).alias("cv_std"), rounded(F.col("t")).alias("train_score"),
        F.when(gap > 0.12, "HIGH").when(gap > 0.05, "MODERATE").otherwise("LOW").alias("overfitting"), (F.col("m") == F.max("m").over(every)).alias("is_best"),
        F.coalesce(rel == F.min(rel).over(every), F.lit(False)).alias("is_most_stable"), rounded(F.col("sec"), 2).alias("training_seconds"),
    )


def train_importances(df, target: str, key: list[str], trees: int = 80, folds: int | None = None, most: int = 15) -> DataFrame:
    """The ``most`` important features of the tree model with the best cross-validated score."""
    frame = Frame(df, target, key, folds=folds)
    models = {n: m for n, m in catalogue(frame, trees).items() if hasattr(m, "maxDepth")}
    means = {r["model"]: r["m"] for r in fold_scores(frame, models).groupBy("model").agg(F.avg("score").alias("m")).collect()}
    best = max(sorted(means), key=means.get)
    weight = models[best].fit(frame.vectors).featureImportances.toArray()
    rows = sorted(((n, float(w)) for n, w in zip(frame.features, weight)), key=lambda x: (-x[1], x[0]))[:most]
    t = small_table(frame.data.sparkSession, [(best, i + 1, n, w) for i, (n, w) in enumerate(rows)], [("model", "string"), ("position", "int"), ("feature", "string"), ("importance", "double")])
    return t.withColumn("importance", rounded(F.col("importance")))


def compare_models(a: DataFrame, b: DataFrame, target: str, key: list[str], trees: int = 50) -> DataFrame:
    """Mean 3-fold forest score of two tables with the same target, their difference and the winner (the
    first table in a tie)."""
    fa, fb = Facts(a), Facts(b)
    one, two = (quick_score(f, target, key, task_of(f, target), trees) for f in (fa, fb))
    t = small_table(fa.spark, [(float(one), float(two))], [("one", "double"), ("two", "double")])
    return t.select(
        rounded(F.col("one")).alias("table_1_score"), rounded(F.col("two")).alias("table_2_score"), rounded(F.col("two") - F.col("one")).alias("delta"),
        F.when(F.col("two") > F.col("one"), "table_2").otherwise("table_1").alias("winner"))


def learning_curve(df, target: str, key: list[str], shares: tuple = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0), trees: int = 50) -> DataFrame:
    """Train and test score of a forest on growing hash prefixes of the training part."""
    frame = Frame(df, target, key)
    data = frame.vectors.withColumn("__u", F.conv(F.substring(hash_key(frame.key, "curve"), 1, 8), 16, 10).cast("double") / float(16 ** 8))
    test, rows = data.where("fold = 0"), []
    model = catalogue(frame, trees)["Random Forest"]
    for s in shares:
        train = data.where((F.col("fold") != 0) & (F.col("__u") < s))
        if frame.is_clf and train.select("label").distinct().count() < 2:
            continue
        fitted = model.fit(train)
        rows.append((s, float(frame.score(fitted.transform(train))), float(frame.score(fitted.transform(test)))))
    t = small_table(data.sparkSession, rows, [("share", "double"), ("train", "double"), ("test", "double")])
    gap = F.abs(F.col("train") - F.col("test"))
    order = W.partitionBy(F.lit(0)).orderBy("share")
    return t.select("share", rounded(F.col("train")).alias("train_score"), rounded(F.col("test")).alias("test_score"), rounded(gap).alias("gap"), (gap < F.first(gap).over(order) * 0.7).alias("converging"))


def overfit(df, target: str, key: list[str], trees: int = 60) -> DataFrame:
    """Train against held-out score per model and the risk band."""
    frame = Frame(df, target, key, folds=4)
    train, test = frame.vectors.where("fold <> 0"), frame.vectors.where("fold = 0")
    rows = []
    for name, model in catalogue(frame, trees).items():
        if name == "Decision Tree":
            continue
        fitted = model.fit(train)
        rows.append((name, float(frame.score(fitted.transform(train))), float(frame.score(fitted.transform(test)))))
    return SC.overfit_bands(small_table(train.sparkSession, rows, [("model", "string"), ("train_score", "double"), ("test_score", "double")]))


def importance(df, target: str, key: list[str], repeats: int = 5, trees: int = 60, rules: str = "absolute") -> DataFrame:
    """Forest importance next to permutation importance on the held-out fold.

    Rows are dealt once into random blocks by the hash of their key; the forest scores all shuffled
    columns of a block inside one task, and only (feature, repeat) sums leave it."""
    frame = Frame(df, target, key, folds=5)
    model = catalogue(frame, trees)["Random Forest"].fit(frame.vectors.where("fold <> 0"))
    test = frame.data.where("fold = 0").withColumn("__order", hash_key(frame.key))
    seen = test.agg(F.count(F.lit(1)).alias("n"), F.var_pop("label").alias("var")).first()
    sums = permuted_scores(test, FlatForest.of(model, len(frame.cols)), frame.cols, "label", "__order", repeats, seen["n"])
    score = F.col("hit") / F.col("n") if frame.is_clf else 1 - F.col("sse") / F.col("n") / F.nullif(F.lit(seen["var"]).cast("double"), F.lit(0.0))
    per = sums.select("feature", score.alias("s")).groupBy("feature").agg(F.avg("s").alias("s"), F.stddev_pop("s").alias("sd"))
    got = {r["feature"]: (r["s"], r["sd"]) for r in per.collect()}
    base, impurity = got[-1][0], model.featureImportances.toArray()
    drop = lambda s: None if base is None or s is None else float(base - s)
    rows = [(name, float(impurity[i]), drop(got[i][0]), got[i][1]) for i, name in enumerate(frame.features)]
    table = small_table(frame.data.sparkSession, rows, [("feature", "string"), ("importance", "double"), ("permutation", "double"), ("sd", "double")])
    spread = table.select("feature", rounded(F.col("sd")).alias("permutation_std"))
    return SC.importance_tiers(table, rules).join(F.broadcast(spread), "feature")  # one row per feature


def consensus_select(df, target: str, key: list[str], trees: int = 50) -> DataFrame:
    """Votes against each numeric feature: low forest importance (< .02), low mutual information
    (< .01), F test p > .05, |r| > .85 with a more important feature, variance < .01. Two votes or
    low variance remove it."""
    from tablefit.operators.relate import f_test, mutual_info

    f = Facts((df if not isinstance(df, Facts) else df.df).dropna())
    cols = [n for n in f.numeric if n != target and n not in key]
    frame = Frame(f.df.select(*[c(n) for n in (*key, *cols, target)]), target, key)
    fitted = catalogue(frame, trees)["Random Forest"].fit(frame.vectors)
    weight = dict(zip(frame.features, (float(x) for x in fitted.featureImportances.toArray())))
    late = [((b if weight[b] <= weight[a] else a),) for (a, b), r in f.corr(cols).items() if r is not None and abs(r) > 0.85]
    spark = f.spark
    votes = small_table(spark, [(n, w, f.scan()[n]["var"] < 0.01) for n, w in weight.items()], [("feature", "string"), ("importance", "double"), ("low_variance", "boolean")])
    votes = votes.join(mutual_info(f, target, cols).withColumnRenamed("mutual_information", "mi"), "feature", "left")
    votes = votes.join(f_test(f, target, not frame.is_clf).select("feature", "p_value"), "feature", "left")
    tied = small_table(spark, late, [("feature", "string")]).groupBy("feature").agg(F.count(F.lit(1)).alias("tied"))
    votes = votes.join(tied, "feature", "left")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    total = flag(F.col("importance") < 0.02) + flag(F.col("mi") < 0.01) + flag(F.col("p_value") > 0.05) + F.coalesce("tied", F.lit(0)) + flag(F.col("low_variance"))
    return votes.select("feature", rounded(F.col("importance")).alias("importance"), "mi", "p_value", total.cast("bigint").alias("votes"), ((total >= 2) | F.col("low_variance")).alias("remove"))


def select_k_best(df, target: str, k: int | None = None) -> DataFrame:
    """The k = max(3, columns / 2) numeric features with the largest F (all when 5 or fewer)."""
    from tablefit.operators.relate import f_test

    f = Facts(df) if not isinstance(df, Facts) else df
    cols = [n for n in f.numeric if n != target]
    t = f_test(f, target, task_of(f, target) == "regression").select("feature", "f_statistic")
    if k is None:
        k = max(3, len(cols) // 2) if len(cols) > 5 else len(cols)
    return t.orderBy(F.col("f_statistic").desc(), "feature").limit(k)


def search_models(frame: Frame, boost: int = 20) -> dict:
    """Models of the search by task, and whether scaling can change them: trees split between ordered
    values, so a shift and a factor per column leave their predictions alone."""
    if frame.is_clf:
        gbt = MC.GBTClassifier(maxIter=boost, maxDepth=4, stepSize=0.1, seed=SEED)
        return {
            "LR": (MC.LogisticRegression(maxIter=500), True), "RF_shallow": (MC.RandomForestClassifier(numTrees=50, maxDepth=5, seed=SEED), False),
            "RF_deep": (MC.RandomForestClassifier(numTrees=80, maxDepth=10, seed=SEED), False), "GB": (gbt if frame.classes == 2 else MC.OneVsRest(classifier=gbt), False),
        }
    return {
        "Ridge_low": (MR.LinearRegression(regParam=0.1, elasticNetParam=0.0), True), "Ridge_high": (MR.LinearRegression(regParam=10.0, elasticNetParam=0.0), True),
        "RF_shallow": (MR.RandomForestRegressor(numTrees=50, maxDepth=5, seed=SEED), False), "RF_deep": (MR.RandomForestRegressor(numTrees=80, maxDepth=10, seed=SEED), False),
        "GB": (MR.GBTRegressor(maxIter=boost, maxDepth=4, stepSize=0.1, seed=SEED), False),
    }


def search(df, target: str, key: list[str], folds: int = 3, boost: int = 20, parallel: int = 4) -> DataFrame:
    """Fill (median, mean) x log1p x standardising x model, cross-validated on fixed folds, and soft voting of
    three models on the best fill: 33 rows for classes, 41 for numbers.

    Each fill, log and scale of a fold is fitted on its training rows once, stored with all rows
    prepared, and read by every model; trees are fitted once for both scalings, and choices that give the
    same table (fills without a gap, logs without a skewed column) share their fits. Fits run side by side."""
    f = df if isinstance(df, Facts) else Facts(df)
    frame = Frame(f, target, key, folds=folds)
    logged = set(C.skewed_columns(Facts(frame.data.select(*frame.cols)), None, 1.5))
    models = search_models(frame, boost)

    def prepare(strategy: str, use_log: bool, i: int) -> DataFrame:
        filled = [f"{x}_i" for x in frame.cols]
        data = frame.data.select("label", "fold", *[(F.log1p(x) if use_log and x in logged else F.col(x)).alias(x) for x in frame.cols])
        stages = [
            Imputer(strategy=strategy, inputCols=frame.cols, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        ]
        return settle(Pipeline(stages=stages).fit(data.where(F.col("fold") != i)).transform(data).select("label", "fold", "features", "scaled"))

    def one(data: DataFrame, i: int, model, column: str) -> float:
        part = data.select("label", "fold", F.col(column).alias("features"))
        return float(frame.score(model.fit(part.where(F.col("fold") != i)).transform(part.where(F.col("fold") == i))))

    # fills of no gap and logs of no column give one table; a logarithm may leave gaps of its own
    gaps = lambda use_log: [F.count_if(x.isNull() | F.isnan(x)) > 0 for x in (F.log1p(n) if use_log and n in logged else F.col(n) for n in frame.cols)]
    found = frame.data.agg(*[F.array(F.lit(False), *gaps(use_log)).alias(str(use_log)) for use_log in (False, True)]).first()
    same_fill, same_log = {use_log: not any(found[str(use_log)]) for use_log in (False, True)}, not logged
    kept = lambda strategy, use_log: ("median" if same_fill[use_log] else strategy, use_log and not same_log)
    with ThreadPoolExecutor(parallel) as pool:
        made: dict[tuple, dict] = {}
        for use_log in (False, True):
            for strategy in ("median", "mean"):
                key = kept(strategy, use_log)
                if key in made:
                    continue
                made[key] = {}
                for i in range(frame.k):  # the next fold is prepared while models of the last are fitted
                    data = prepare(*key, i)
                    for name, (model, moves) in models.items():
                        for scaled in (False, True) if moves else (False,):
                            made[key].setdefault((name, scaled), []).append(pool.submit(one, data, i, model.copy(), "scaled" if scaled else "features"))
        scores: dict[tuple, list[float]] = {}
        for use_log in (False, True):
            for strategy in ("median", "mean"):
                jobs = made[kept(strategy, use_log)]
                for name, (_, moves) in models.items():
                    for scaled in (False, True):
                        scores[name, strategy, use_log, scaled] = [job.result() for job in jobs[name, scaled and moves]]
        rows = [(n, st, lg, sc, False, float(np.mean(v)), float(np.std(v))) for (n, st, lg, sc), v in scores.items()]
        fill = max(rows, key=lambda r: r[5])[1]
        votes = list(pool.map(lambda i: _soft_vote(frame, prepare(fill, False, i), i, boost), range(frame.k)))
    rows.append(("Voting Ensemble", fill, False, False, True, float(np.mean(votes)), float(np.std(votes))))
    t = small_table(f.spark, rows, [("model", "string"), ("impute", "string"), ("log_transform", "boolean"), ("standardise", "boolean"), ("is_ensemble", "boolean"), ("score", "double"), ("std", "double")])
    return t.select("model", rounded(F.col("score")).alias("score"), rounded(F.col("std")).alias("std"), "impute", "log_transform", F.when(F.col("standardise"), "StandardScaler").otherwise("None").alias("scaler"), "is_ensemble")


def _soft_vote(frame: Frame, data: DataFrame, i: int, boost: int) -> float:
    """Held-out score of the mean probability (or prediction) of a linear model, a forest and boosting."""
    train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i).select("label", "features")
    if frame.is_clf:
        gbt = MC.GBTClassifier(maxIter=boost, maxDepth=3, stepSize=0.1, seed=SEED)
        members = [MC.LogisticRegression(maxIter=500), MC.RandomForestClassifier(numTrees=60, maxDepth=10, seed=SEED), gbt if frame.classes == 2 else MC.OneVsRest(classifier=gbt, rawPredictionCol="raw")]
    else:
        members = [MR.LinearRegression(regParam=1.0, elasticNetParam=0.0), MR.RandomForestRegressor(numTrees=60, maxDepth=10, seed=SEED), MR.GBTRegressor(maxIter=boost, maxDepth=3, stepSize=0.1, seed=SEED)]
    for j, model in enumerate(members):
        out = model.fit(train).transform(test)
        if not frame.is_clf:
            said = F.col("prediction")
        elif "probability" in out.columns:
            said = vector_to_array("probability")
        else:  # one-vs-rest has no probabilities: its vote counts as certain
            said = F.transform(F.sequence(F.lit(0), F.lit(frame.classes - 1)), lambda x: (x == F.col("prediction").cast("int")).cast("double"))
        test = out.select("label", "features", *[f"q{k}" for k in range(j)], said.alias(f"q{j}"))
    if frame.is_clf:
        mean = F.array(*[F.col("q0")[k] + F.col("q1")[k] + F.col("q2")[k] for k in range(frame.classes)])
        said = (F.array_position(mean, F.array_max(mean)) - 1).cast("double")
    else:
        said = (F.col("q0") + F.col("q1") + F.col("q2")) / 3
    return float(frame.score(test.withColumn("prediction", said)))


def search_report(found: DataFrame, k: int = 10) -> DataFrame:
    """The k best configurations, best first (ties by name)."""
    order = [F.col("score").desc(), "model", "impute", "log_transform", "scaler"]
    return found.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("position") <= k).orderBy("position")


def ensembles(df, target: str, key: list[str], trees: int = 30) -> DataFrame:
    """Single models against soft and hard voting, bagging of depth-5 trees and stacking on
    out-of-fold predictions; held-out score on fold 0. Regression averages predictions."""
    frame = Frame(df, target, key, folds=4)
    train, test = frame.vectors.where("fold <> 0"), frame.vectors.where("fold = 0")
    models = {n: m for n, m in catalogue(frame, trees).items() if n != "Decision Tree"}
    names = list(models)

    def chained(fitted, data):
        """All models' predictions side by side (probabilities where they exist)."""
        for i, n in enumerate(names):
            out = fitted[n].transform(data)
            keep = [*data.columns, F.col("prediction").alias(f"p{i}")]
            if "probability" in out.columns:
                keep.append(vector_to_array("probability").alias(f"q{i}"))
            data = out.select(*keep)
        return data

    fitted = {n: m.fit(train) for n, m in models.items()}
    both = chained(fitted, test)
    rows = [(n, float(frame.score(both.withColumn("prediction", F.col(f"p{i}"))))) for i, n in enumerate(names)]
    if frame.is_clf:
        probs = [f"q{i}" for i in range(len(names)) if f"q{i}" in both.columns]
        mean = F.array(*[sum((F.col(q)[j] for q in probs), F.lit(0.0)) for j in range(frame.classes)])
        soft = F.array_position(mean, F.array_max(mean)) - 1
        count = lambda j: sum((F.when(F.col(f"p{i}") == float(j), 1).otherwise(0) for i in range(len(names))), F.lit(0))
        tally = F.array(*[count(j) for j in range(frame.classes)])
        hard = F.array_position(tally, F.array_max(tally)) - 1
        rows.append(("Voting (soft)", float(frame.score(both.withColumn("prediction", soft.cast("double"))))))
        rows.append(("Voting (hard)", float(frame.score(both.withColumn("prediction", hard.cast("double"))))))
        bag = MC.RandomForestClassifier(numTrees=trees, maxDepth=5, featureSubsetStrategy="all", seed=SEED)
        meta = MC.LogisticRegression(maxIter=200, featuresCol="meta")
    else:
        mean = sum((F.col(f"p{i}") for i in range(len(names))), F.lit(0.0)) / len(names)
        rows.append(("Voting", float(frame.score(both.withColumn("prediction", mean)))))
        bag = MR.RandomForestRegressor(numTrees=trees, maxDepth=5, featureSubsetStrategy="all", seed=SEED)
        meta = MR.LinearRegression(regParam=1.0, elasticNetParam=0.0, featuresCol="meta")
    rows.append(("Bagging", float(frame.score(bag.fit(train).transform(test)))))
    parts = []
    for i in (1, 2, 3):
        inner = {n: m.fit(train.where(F.col("fold") != i)) for n, m in models.items()}
        parts.append(chained(inner, train.where(F.col("fold") == i)).select("label", *[f"p{j}" for j in range(len(names))]))
    stacked = settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    gather = VectorAssembler(inputCols=[f"p{j}" for j in range(len(names))], outputCol="meta")
    rows.append(("Stacking", float(frame.score(meta.fit(gather.transform(stacked)).transform(gather.transform(both))))))
    t = small_table(train.sparkSession, rows, [("model", "string"), ("score", "double")])
    return t.withColumn("score", rounded(F.col("score")))


def quick_score(df, target: str, key: list[str], task: str, trees: int, prepared: bool = False, known: dict | None = None) -> float:
    """Mean 3-fold score of one forest. Folds are fitted side by side and scored on held-out rows only.
    ``known`` gathers scores by the content of the matrix: a matrix that is in it is not fitted again."""
    frame = Frame(df, target, key, task, prepared, folds=3)
    if not frame.features:
        return 0.0
    forest = catalogue(frame, trees)["Random Forest"]
    content = None if known is None else frame.content()
    if known and content in known:
        return known[content]

    def held_out(i: int) -> float:
        fitted = forest.fit(frame.vectors.where(F.col("fold") != i))
        return float(frame.score(fitted.transform(frame.vectors.where(F.col("fold") == i))))

    with ThreadPoolExecutor(frame.k) as pool:
        score = float(np.mean(list(pool.map(held_out, range(frame.k)))))
    if known is not None:
        known[content] = score
    return score


def fix_impact(df: DataFrame, target: str, key: list[str], trees: int = 40) -> DataFrame:
    """Score before any fix and after each one in turn: drop sparse columns, duplicates,
    near-unique columns; fill gaps; cap outliers; log1p; encode. Fixes with nothing to do are left out.

    Facts of a table serve its score and all fixes tried on it; fixes that leave the training matrix as
    one before share its score."""
    f = Facts(df)
    task = task_of(f, target)
    keep_key = lambda cols: [n for n in cols if n not in key]

    def drop_sparse(x, g):
        gone = [n for n in g.columns if g.scan()[n]["missing_share"] > 0.6 and n != target]
        return x.drop(*gone) if gone else None

    def drop_unique(x, g):
        gone = keep_key(r["column"] for r in drop_rules(g, "near_unique", target).collect())
        return x.drop(*gone) if gone else None

    def copies(x, g):
        return C.dedupe(x) if g.duplicates() else None

    def fill(x, g):
        how = C.auto_methods(g, target, "median")
        return C.impute(g, how) if how else None

    def cap(x, g):
        return C.winsorize(g, target=target, cols=keep_key(n for n in g.numeric if n != target))

    def log(x, g):
        return C.log_transform(g, target) if keep_key(C.skewed_columns(g, target)) else None

    def encode(x, g):
        names = [n for n in g.categorical if n != target]
        for n in names:
            x = encode_label(x, n)
        return x if names else None

    known: dict = {}
    rows = [(0, "baseline", quick_score(f, target, key, task, trees, known=known))]
    now, facts = f.df, f
    for name, fix in (("drop_sparse", drop_sparse), ("drop_duplicates", copies), ("drop_near_unique", drop_unique), ("impute", fill), ("winsorize", cap), ("log_transform", log), ("encode", encode)):
        got = fix(now, facts)
        if got is not None:
            now = settle(got)
            facts = Facts(now)
            rows.append((len(rows), name, quick_score(facts, target, key, task, trees, known=known)))
    return SC.step_deltas(small_table(f.spark, [(i, n, float(s)) for i, n, s in rows], [("step", "int"), ("fix", "string"), ("score", "double")]))


def fixed_table(f: Facts, target: str, key: list[str], outliers: bool = False, correlated: bool = False, balance: bool = False) -> DataFrame:
    """The table after the chosen fixes: rows beyond the fences out, the later of two correlated columns out,
    classes brought to the size of the largest. Keys are no features."""
    now = f.df
    if outliers:
        now = C.drop_iqr_outliers(f, target)
    if correlated:
        features = Facts(now.drop(*key))
        gone = set(features.columns) - set(C.drop_correlated(features, target=target).columns)
        now = now.drop(*gone)
    if balance and task_of(f, target) == "classification":
        now = C.oversample(now, target, key)
    return now


def fix_sizes(df: DataFrame, target: str, key: list[str], outliers: bool = False, correlated: bool = False, balance: bool = False) -> DataFrame:
    """Rows and columns before and after the chosen fixes; no model is fitted."""
    f = Facts(df)
    now = fixed_table(f, target, key, outliers, correlated, balance)
    row = (f.rows, now.count(), len(f.columns), len(now.columns))
    return small_table(f.spark, [row], [(n, "bigint") for n in ("rows_before", "rows_after", "columns_before", "columns_after")])


def apply_fixes(df: DataFrame, target: str, key: list[str], outliers: bool = False, correlated: bool = False, balance: bool = False, trees: int = 50) -> DataFrame:
    """Score before and after the chosen fixes, with row and column counts."""
    f = Facts(df)
    task = task_of(f, target)
    now = settle(fixed_table(f, target, key, outliers, correlated, balance))
    row = (quick_score(f.df, target, key, task, trees), quick_score(now, target, key, task, trees), f.rows, now.count(), len(f.columns), len(now.columns))
    t = small_table(f.spark, [row], [("before", "double"), ("after", "double"), ("rows_before", "bigint"), ("rows_after", "bigint"), ("columns_before", "bigint"), ("columns_after", "bigint")])
    return t.select(rounded(F.col("before")).alias("baseline_score"), rounded(F.col("after")).alias("final_score"), rounded(F.col("after") - F.col("before")).alias("improvement"), "rows_before", "rows_after", "columns_before", "columns_after")


def fold_stability(df, target: str, key: list[str], trees: int = 80, folds: int | None = None, rules: str = "simple") -> DataFrame:
    """Spread of the fold scores of every model of the catalogue, its band and the worst fold."""
    frame = Frame(df, target, key, folds=folds)
    return SC.cv_stability(fold_scores(frame, catalogue(frame, trees)).select("model", "fold", "score"), rules)


def clean_gain(df: DataFrame, target: str, key: list[str], trees: int = 40) -> DataFrame:
    """Forest score on the raw table and on its ``to_ml`` version."""
    f = Facts(df)
    task = task_of(f, target)
    ready = to_ml(f, target)
    ready = ready.withColumn("__row", F.md5(F.concat_ws("-", *[c(n).cast("string") for n in ready.columns])))
    before, after = quick_score(f.df, target, key, task, trees), quick_score(ready, target, ["__row"], task, trees, prepared=False)
    t = small_table(f.spark, [(before, after)], [("before", "double"), ("after", "double")])
    return t.select(rounded(F.col("before")).alias("score_before"), rounded(F.col("after")).alias("score_after"), rounded(F.col("after") - F.col("before")).alias("gain"))


def mlp(df, target: str, key: list[str], hidden: tuple = (128, 64, 32), iterations: int = 100, trees: int = 40) -> DataFrame:
    """Multilayer perceptron (classification) on standardised features against two baselines."""
    frame = Frame(df, target, key, folds=5)
    if not frame.is_clf:
        raise ValueError("the perceptron handles classification only")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    net = MC.MultilayerPerceptronClassifier(layers=[len(frame.cols), *hidden, frame.classes], maxIter=iterations, seed=SEED, featuresCol="scaled")
    base = catalogue(frame, trees)
    train, test = frame.vectors.where("fold <> 0"), frame.vectors.where("fold = 0")
    rows = []
    for name, model in {"MLP": Pipeline(stages=[scaler, net]), "Logistic Regression": base["Logistic Regression"], "Random Forest": base["Random Forest"]}.items():
        rows.append((name, float(frame.score(model.fit(train).transform(test)))))
    t = small_table(train.sparkSession, rows, [("model", "string"), ("f1_weighted", "double")])
    return t.withColumn("f1_weighted", rounded(F.col("f1_weighted")))


class Attribution:
    """Shapley values of a fitted forest: ``rows`` holds rid, output, base, values and inputs (arrays in
    the order of ``features``), one row per row of the table."""

    def __init__(self, rows: DataFrame, features: list[str]):
        self.rows, self.features = rows, features

    def summary(self) -> DataFrame:
        """Mean size and direction of the values per feature; one scan, one sum per feature."""
        v = lambda i: F.col("values")[i]
        entries = [F.struct(F.lit(n).alias("feature"), F.avg(F.abs(v(i))).alias("a"), F.avg(v(i)).alias("m")) for i, n in enumerate(self.features)]
        per = self.rows.agg(F.array(*entries).alias("e")).select(F.inline("e"))
        return per.select(
            "feature", rounded(F.col("a"), 6).alias("mean_abs"), rounded(F.col("m"), 6).alias("mean"), F.when(F.col("m") > 0, "POSITIVE").otherwise("NEGATIVE").alias("direction"))

    def top(self, k: int = 5) -> DataFrame:
        """The k features with the largest values of every row, largest first (ties: earlier column), with
        the row's number and whether it raises the prediction."""
        names = F.array(*[F.lit(n) for n in self.features])
        entry = lambda x, i: F.struct(
            (-F.abs(x)).alias("o"), i.alias("i"), names[i].alias("feature"), rounded(x, 4).alias("value"), rounded(F.col("inputs")[i], 4).alias("feature_value"), (x > 0).alias("increases"))
        best = F.slice(F.array_sort(F.transform("values", entry)), 1, k)
        shown = F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["feature_value"].alias("feature_value"), e["increases"].alias("increases")))
        return self.rows.select("rid", rounded(F.col("output"), 4).alias("output"), rounded(F.col("base"), 4).alias("base_value"), shown.alias("top_features"))

    def interactions(self, k: int = 5) -> DataFrame:
        """The k pairs of features whose values go together most: the size of their correlation, from sums
        of cross products that each task makes of its own rows."""
        wide = self.rows.select(*[F.col("values")[i].alias(f"v{i}") for i in range(len(self.features))])
        cols = wide.columns
        if len(cols) < 2:
            pairs = []
        else:
            means = wide.agg(*[F.avg(n).alias(n) for n in cols]).first()
            got = pair_correlations(wide, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]], {n: means[n] or 0.0 for n in cols})
            named = [(self.features[int(a[1:])], self.features[int(b[1:])], abs(r)) for (a, b), r in got.items() if r is not None]
            pairs = sorted(named, key=lambda p: (-p[2], p[0], p[1]))[:k]
        t = small_table(wide.sparkSession, pairs, [("feature_1", "string"), ("feature_2", "string"), ("r", "double")])
        return t.select("feature_1", "feature_2", rounded(F.col("r")).alias("interaction_strength"))


def attribution(df, target: str, key: list[str], trees: int = 40) -> Attribution:
    """Exact Shapley values of a forest for every row of the table.

    Features are replaced by what the trees' own training rows took of each branch. Rows are explained
    where they lie: a task evaluates the flat forest on its batches and writes one array per row."""
    frame = Frame(df, target, key, folds=5)
    model = catalogue(frame, trees)["Random Forest"].fit(frame.vectors)
    named = frame.data.select(F.concat_ws("-", *[F.col(k) for k in frame.key]).alias("rid"), *frame.cols)
    return Attribution(settle(explain_rows(named, FlatForest.of(model, len(frame.cols)), frame.cols, "rid")), frame.features)
