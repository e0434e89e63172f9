"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark column expressions. A forest of shallow trees is grown on a sample of labelled
rows; every path from a root to a node is a conjunctive rule. A lasso logistic regression keeps
few of the rules, and what is kept is compiled into one Spark column expression: scoring is a
projection.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import WORD, need, remainder, settle, text_of

FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 20, 3, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Name to column; all are finite numbers, also for an empty text."""
    n = F.length(text).cast("double")
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    tokens = F.split(text, r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        left = F.length(F.regexp_replace(text, pattern, "")).cast("double")
        return (n - left) / F.greatest(n, F.lit(1.0))

    return {
        "chars": F.log1p(n),
        "words": F.log1p(words),
        "word_length": n / F.greatest(words, F.lit(1.0)),
        "letters": share(r"\p{L}+"),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "stops": share(r"[.,;:?]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:?]+"),
        "spaces": share(r"\s+"),
        "short_words": F.regexp_count(text, F.lit(r"(?<![^\s])\p{L}{1,3}(?![^\s])")).cast("double") / F.greatest(words, F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct(tokens)).cast("double") / F.size(tokens),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)),
        "ends": F.when(text.rlike(r"[.!?]\s*\z"), 1.0).otherwise(0.0),
    }


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` but the text, and its statistics as ``s_<name>``."""
    stats = statistics(text_of(df, text))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != text], *[c.alias(f"s_{k}") for k, c in stats.items()])


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


def tree_rules(debug: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Every path of the trees printed by ``debug``, as a tuple of (column, '<=' or '>', threshold)."""
    rules, path = [], []
    for line in debug.splitlines():
        if line.strip().startswith("Tree"):
            path = []
            continue
        m = _LINE.match(line)
        if not m:
            continue
        level = len(m[1])
        path = [(k, c) for k, c in path if k < level]
        path.append((level, (names[int(m[3])], m[4], float(m[5]))))
        rules.append(_tight(tuple(c for _, c in path)))
    return sorted(set(rules))


def _tight(rule):
    """Only the narrowest bound for each column and side, in a fixed order."""
    bounds: dict[tuple[str, str], float] = {}
    for name, side, x in rule:
        old = bounds.get((name, side))
        bounds[name, side] = x if old is None else (min(old, x) if side == "<=" else max(old, x))
    return tuple(sorted((n, s, x) for (n, s), x in bounds.items()))


def rule_column(rule) -> Column:
    out = None
    for name, side, x in rule:
        c = F.col(name) <= x if side == "<=" else F.col(name) > x
        out = c if out is None else out & c
    return out


class RuleModel:
    """Bias and weighted rules; ``column()`` is the score as a Spark expression over ``s_`` columns."""

    def __init__(self, bias: float, rules: list[tuple[float, tuple]]):
        self.bias, self.rules = bias, rules

    def column(self) -> Column:
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            z = z + F.when(rule_column(rule), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def fit(labelled: DataFrame, label: str, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Fit on rows with ``s_`` columns and a 0/1 label. One class only (or no rows) gives a constant
    score: (positive rows + 1) / (rows + 2)."""
    names = sorted(c for c in labelled.columns if c.startswith("s_"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    n, p = seen["n"], seen["p"] or 0.0
    if p in (0.0, float(n)):
        import math

        return RuleModel(math.log((p + 1) / (n - p + 1)), [])
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(labelled.withColumn("label", F.col(label).cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(ready)
    rules = tree_rules(forest.toDebugString, names)
    flags = [F.when(rule_column(r), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
    table = labelled.select(F.col(label).cast("double").alias("label"), *flags)
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(table)
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=False).fit(table.select("label", "features"))
    kept = [(float(w), rules[i]) for i, w in enumerate(lasso_fit.coefficients) if w != 0.0]
    return RuleModel(float(lasso_fit.intercept), kept)


def train_sample(measured: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows, those with the smallest hash of their id: a fixed sample that
    the driver never sees. Labels other than 0 and 1, null ids and ids labelled both ways are left out."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    one = one.where("__lo = __hi").select("doc_id", F.col("__lo").alias("__label"))
    joined = measured.join(one, "doc_id").withColumn("__h", F.xxhash64("doc_id"))
    return joined.orderBy("__h", "doc_id", *[c for c in measured.columns if c.startswith("s_")]).limit(rows).drop("__h")


def scored_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The contract of op2: doc_id, held_out, score, predicted.

    Statistics are measured once and stored; the model is fitted on at most ``fit_rows`` labelled
    rows outside the hold-out. A null text is scored as the empty one. Every row gets a score.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    held = remainder(F.col("doc_id"), 4) == 2
    measured = settle(measure(docs.select("doc_id", "text")))
    sample = settle(train_sample(measured.where(~held), labels, "quality", fit_rows))
    score = fit(sample, "__label").column()
    out = measured.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
