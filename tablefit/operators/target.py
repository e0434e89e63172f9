"""Which column is the target, and is the task classification or regression?"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import rounded
from tablefit.functions.names import ID_WORDS_ENTROPY, TARGET_ID, TARGET_WORDS, TARGET_WORDS_ENTROPY
from tablefit.functions.ranks import count_values
from tablefit.operators.facts import Facts, as_facts, small_table


def _name_points(name: str) -> float:
    """0.6 per word equal to the name, 0.3 per word inside it; the one-letter word y counts too,
    so any name with a y gains 0.3 (kept because visible scores depend on it)."""
    low = name.lower().strip()
    points = sum(0.6 if low == w else 0.3 if w in low else 0.0 for w in TARGET_WORDS)
    return points - (0.4 if re.search(TARGET_ID, low) else 0.0)


def target_scores(df) -> DataFrame:
    """Score of every column as a target candidate (rule set ``simple``)."""
    f = as_facts(df)
    t = f.table("distinct")
    names = small_table(f.spark, [(i, _name_points(n)) for i, n in enumerate(f.columns)], [("ordinal", "bigint"), ("points", "double")])
    k = F.col("distinct")
    numeric = F.col("type").isin("double", "bigint", "int", "float")
    score = (
        F.col("points") + F.when(F.col("ordinal") == len(f.columns) - 1, 0.2).otherwise(0.0) + F.when(k == 2, 0.25).otherwise(0.0)
        + F.when(k.between(2, 20), 0.15).otherwise(0.0) + F.when(numeric & (k > 20), 0.05).otherwise(0.0)
        - F.when(k == F.col("rows"), 0.5).otherwise(0.0)
    )
    return t.join(F.broadcast(names), "ordinal").select("ordinal", "column", rounded(score, 3).alias("score"), "distinct", "kind")


def detect_target(df, rules: str = "simple") -> DataFrame:
    """Best target column with its score and task type, one row."""
    if rules == "entropy":
        return detect_target_entropy(df)
    f = as_facts(df)
    scored = target_scores(f)
    best = scored.orderBy(F.col("score").desc(), "ordinal").limit(1)
    last = scored.where(F.col("ordinal") == len(f.columns) - 1).withColumn("score", F.lit(0.3))
    pick = best.where("score > 0").unionByName(last.withColumn("score", F.lit(0.3))).withColumn("is_last", F.monotonically_increasing_id())
    pick = pick.orderBy("is_last").limit(1)
    return pick.select(
        F.col("column").alias("target"), "score", task_column().alias("task_type"), (F.col("score") < 0.4).alias("low_confidence"),
    )


def choose_target(f: Facts) -> str:
    rows = target_scores(f).collect()
    best = min(rows, key=lambda r: (-r["score"], r["ordinal"]))
    return best["column"] if best["score"] > 0 else f.columns[-1]


def target_confidence(f: Facts) -> tuple[str, float]:
    rows = target_scores(f).collect()
    best = min(rows, key=lambda r: (-r["score"], r["ordinal"]))
    return (best["column"], best["score"]) if best["score"] > 0 else (f.columns[-1], 0.3)


def task_column(rules: str = "simple"):
    """binary / multiclass / regression (``simple``; text with more than 20 values counts as
    regression there) or classification / regression at 15 values (``strict``)."""
    k, text = F.col("distinct"), F.col("kind").isin("string", "boolean")
    if rules == "strict":
        return F.when(text | (k <= 15), "classification").otherwise("regression")
    return F.when(k == 2, "classification_binary").when(k <= 20, "classification_multiclass").otherwise("regression")


def task_types(df) -> DataFrame:
    """Task type every column would have as a target, by both rule sets."""
    return as_facts(df).table("distinct").select("column", task_column().alias("simple_task"), task_column("strict").alias("strict_task"))


def task_of(f: Facts, target: str, rules: str = "strict") -> str:
    k = f.distinct([target])[target]
    if rules == "strict":
        return "classification" if f.kinds[target] in ("string", "boolean") or k <= 15 else "regression"
    return "classification_binary" if k == 2 else "classification_multiclass" if k <= 20 else "regression"


def detect_target_entropy(df) -> DataFrame:
    """Candidates scored by name, type, normalised entropy and missing share, with softmax
    confidence. Entropy comes from counted values, one shuffle for all columns."""
    f = as_facts(df)
    low = [n.lower() for n in f.columns]
    hit = [
        (i, any(w in n for w in ID_WORDS_ENTROPY), 5.0 if n in TARGET_WORDS_ENTROPY else 3.0 if any(w in n for w in TARGET_WORDS_ENTROPY) else 0.0)
        for i, n in enumerate(low)
    ]
    names = small_table(f.spark, hit, [("ordinal", "bigint"), ("id_name", "boolean"), ("name_points", "double")])
    live = [n for n, h in zip(f.columns, hit) if not h[1]]
    t = f.table().join(F.broadcast(names), "ordinal")
    if live:
        present = F.create_map(*[F.lit(v) for n in live for v in (n, float(f.scan()[n]["present"]))])
        p = F.col("cnt") / present[F.col("column")]
        h = count_values(f.df, live, 64).groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum(-p * F.log(p)).alias("h"))
        t = t.drop("distinct").join(h, "column", "left")
    else:
        t = t.drop("distinct").withColumn("k", F.lit(0)).withColumn("h", F.lit(0.0))
    k = F.coalesce("k", F.lit(0))
    entropy = F.when(k <= 1, 0.0).otherwise(F.col("h") / F.log(F.nullif(k, F.lit(0))))
    score = (
        F.when(F.col("id_name"), -10.0).when(k / F.col("rows") > 0.95, -8.0)
        .otherwise(
            F.col("name_points") + F.when((F.col("kind") == "string") | (k <= 10), 3.0).otherwise(2.0)
            + F.when((entropy > 0.2) & (entropy < 0.8), 1.5).otherwise(0.0) - F.when(entropy > 0.95, 1.0).otherwise(0.0)
            - F.col("missing") / F.col("rows") * 3
        )
    )
    whole = W.partitionBy(F.lit(0))  # one row per column of the table
    scored = t.withColumn("score", score).withColumn("e", F.exp(F.col("score") - F.max("score").over(whole)))
    return scored.withColumn("confidence", F.col("e") / F.sum("e").over(whole)).select(
        "column", rounded(F.col("score"), 2).alias("score"), rounded(F.col("confidence"), 3).alias("confidence"),
        F.row_number().over(whole.orderBy(F.col("score").desc(), "ordinal")).cast("bigint").alias("rank"),
    )


