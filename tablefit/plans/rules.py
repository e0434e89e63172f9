"""Column rules: which columns to drop, and why. Every rule is an expression over the facts table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions import names as N
from tablefit.operators.facts import as_facts


def _low():
    return F.lower("column")


def _miss():
    return F.col("missing") / F.col("rows")


def _share():
    return F.col("distinct") / F.greatest(F.col("rows"), F.lit(1))


def rule_id_name():
    return F.translate(_low(), " ", "").rlike(N.CLEAN_ID)


def rule_id_unique():
    return F.col("is_int") & (F.col("distinct") == F.col("rows")) & (F.col("rows") > 10)


def rule_meta_name():
    return _low().rlike(N.CLEAN_META)


def rule_missing(threshold: float):
    return _miss() > threshold


def rule_constant():
    return F.col("distinct") <= 1


def rule_free_text():
    return (F.col("kind") == "string") & (_share() > 0.4) & (F.coalesce(F.col("avg_length"), F.lit(0.0)) > 4)


def rule_near_unique():
    return _share() > 0.95


def first_reason(rules: list[tuple[str, object]]):
    """Name of the first rule that holds, null when none does."""
    out = None
    for label, cond in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def clean_reasons(threshold: float, text: bool):
    rules = [
        ("identifier", rule_id_name() | rule_id_unique()), ("metadata", rule_meta_name()),
        ("missing", rule_missing(threshold)), ("constant", rule_constant()),
    ]
    return first_reason(rules + [("free_text", rule_free_text())] if text else rules)


def simple_reasons():
    return first_reason([
        ("identifier", _low().rlike(N.SIMPLE_ID) & (_share() > 0.9)), ("metadata", _low().rlike(N.SIMPLE_META)),
        ("text", _low().rlike(N.SIMPLE_TEXT) & (F.col("kind") == "string") & (_share() > 0.5)), ("missing", rule_missing(0.6)),
        ("constant", rule_constant()), ("high_cardinality", (F.col("kind") == "string") & (F.col("distinct") > 50)),
    ])


def strict_reasons():
    text = F.col("kind") == "string"
    return first_reason([
        ("identifier", F.trim(_low()).rlike(N.STRICT_ID)), ("near_unique", text & (_share() > 0.95)), ("text", text & F.trim(_low()).rlike(N.STRICT_TEXT)),
        ("metadata", F.trim(_low()).rlike(N.STRICT_META)), ("missing", rule_missing(0.6)), ("constant", rule_constant()),
    ])


def drop_rules(df, rules: str = "clean", target: str | None = None) -> DataFrame:
    """(column, reason) for every column a rule set drops; the target never is.

    ``clean``: missing above 0.7, text kept. ``ml``: missing above 0.6, free text dropped.
    ``simple`` and ``strict``: the two plan builders. ``near_unique``: distinct share above 0.95."""
    reason = {
        "clean": lambda: clean_reasons(0.7, False), "ml": lambda: clean_reasons(0.6, True), "simple": simple_reasons, "strict": strict_reasons,
        "near_unique": lambda: first_reason([("near_unique", rule_near_unique())]),
    }[rules]()
    t = as_facts(df).table("distinct").withColumn("reason", reason).where("reason is not null")
    if target is not None:
        t = t.where(F.col("column") != target)
    return t.orderBy("ordinal").select("column", "reason")


def rule_flags(df) -> DataFrame:
    """All single rules side by side, one row per column."""
    return as_facts(df).table("distinct").select(
        "column", rule_id_name().alias("id_name"), rule_id_unique().alias("id_unique"), rule_meta_name().alias("meta_name"),
        rule_missing(0.7).alias("missing_over_70"), rule_missing(0.6).alias("missing_over_60"), rule_constant().alias("constant"),
        rule_free_text().alias("free_text"), rule_near_unique().alias("near_unique"),
    )


def column_types(df) -> DataFrame:
    """numeric / categorical selection by type."""
    return as_facts(df).table().select("column", (F.col("kind") == "numeric").alias("numeric"), F.col("kind").isin("string", "boolean").alias("categorical"))


def select_columns(df, target: str, order_by: str | None = None) -> DataFrame:
    """Keep, impute, encode or drop per column; strong signal rescues a column that would go, an
    identifier stays only with signal of 0.05 or more, high cardinality goes below 0.02."""
    from tablefit.operators.profile import semantic_types
    from tablefit.operators.relate import signal_strength

    f = as_facts(df)
    t = f.table("distinct").where(F.col("column") != target)
    t = t.join(F.broadcast(semantic_types(f, order_by).select("column", "semantic_type")), "column")
    t = t.join(F.broadcast(signal_strength(f, target).withColumnRenamed("feature", "column")), "column", "left")
    s, kind = F.coalesce("signal", F.lit(0.0)), F.col("semantic_type")
    rescue = F.when((s > 0.1) & (_miss() < 0.99), "keep").otherwise("drop")
    action = (
        F.when(F.col("distinct") <= 1, "drop").when(_miss() > 0.7, rescue).when(kind == "id", F.when(s < 0.05, "drop").otherwise("keep"))
        .when(kind == "text", rescue).when(kind == "categorical_high", F.when(s < 0.02, rescue).otherwise("encode"))
        .when(F.col("missing") > 0, "impute").otherwise("keep")
    )
    return t.select("column", "semantic_type", action.alias("action"))
