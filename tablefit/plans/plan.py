"""Plans: a table of steps per column, compiled into one projection (plus lookup joins)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.exprs import c
from tablefit.operators import profile as P
from tablefit.operators.clean import fill_column, fill_values, replace
from tablefit.operators.encode import apply_lookup, as_text, categories, counted, value_codes
from tablefit.operators.facts import Facts, as_facts, small_table
from tablefit.plans.rules import simple_reasons, strict_reasons

STEP_FIELDS = [("position", "bigint"), ("column", "string"), ("step", "string"), ("strategy", "string"), ("reason", "string"), ("params", "string")]
ORDER = ["drop", "impute", "transform", "encode", "scale", "target"]
FILLS = {"mean": "mean", "median": "median", "mode": "mode", "constant": "constant"}


@dataclass
class Plan:
    """Steps (column, step, strategy, reason) in the order they are applied."""

    target: str | None
    steps: list[tuple[str, str, str, str]] = field(default_factory=list)

    def of(self, step: str) -> dict[str, str]:
        return {col: strategy for col, s, strategy, _ in self.steps if s == step}

    def table(self, spark) -> DataFrame:
        rows = [(col, s, strategy, reason) for col, s, strategy, reason in self.steps]
        return small_table(spark, rows, [(n, t) for n, t in STEP_FIELDS if n in ("column", "step", "strategy", "reason")])


def build_plan(df, target: str | None = None, rules: str = "simple") -> Plan:
    """Decide drops, fills, encodings, scalings and transforms from the facts of the raw table."""
    f = as_facts(df)
    t = f.table("distinct", "outliers")
    simple = rules == "simple"
    text = F.col("kind") == "string" if simple else F.col("kind") != "numeric"
    numeric = (F.col("kind") == "numeric") & (F.col("present") > 0)
    transform = P.suggest_transform_column(rules)
    decided = t.select(
        "ordinal", "column", (simple_reasons() if simple else strict_reasons()).alias("drop"), P.suggest_impute_column(rules).alias("impute"),
        F.when(text, P.suggest_encoding_column("plan" if simple else "strict")).alias("encode"),
        F.when(numeric & (transform != "none"), transform).alias("transform"), F.when(numeric, P.suggest_scaling_column(rules)).alias("scale"),
    ).orderBy("ordinal").collect()
    plan = Plan(target)
    for step in ORDER[:-1]:
        for r in decided:
            if r["column"] == target or (step != "drop" and r["drop"]):
                continue
            if r[step] and r[step] != "none":
                plan.steps.append((r["column"], step, "drop" if step == "drop" else r[step], r["drop"] if step == "drop" else ""))
    return plan


def plan_table(df, target: str | None = None, rules: str = "simple") -> DataFrame:
    f = as_facts(df)
    return build_plan(f, target, rules).table(f.spark)


def plan_summary(df, target: str | None = None, rules: str = "simple") -> DataFrame:
    """Counts per step and of the two feature kinds."""
    f = as_facts(df)
    plan = build_plan(f, target, rules)
    n = lambda s: len(plan.of(s))
    numeric = sum(x != target for x in f.numeric)
    row = (len(f.columns) - (target is not None), n("drop"), numeric, len(f.columns) - (target is not None) - numeric, n("impute"), n("encode"), n("scale"), n("transform"))
    return small_table(f.spark, [row], [(k, "bigint") for k in (
        "total_features", "dropped", "numeric_features", "categorical_features", "needing_imputation", "needing_encoding", "needing_scaling", "needing_transform")])


class Fitted:
    """A plan with its constants: every step holds literal parameters, large value sets hold a
    lookup table. ``apply`` gives the same columns for any table with the fitted schema."""

    def __init__(self, spark, steps: list[tuple[str, str, str, dict]], lookups: dict[str, DataFrame] | None = None):
        self.spark, self.steps, self.lookups = spark, steps, lookups or {}

    def apply(self, df: DataFrame) -> DataFrame:
        for col, step, strategy, p in self.steps:
            if col not in df.columns:
                continue
            x = c(col)
            if step == "drop":
                df = df.drop(col)
            elif step == "impute":
                df = replace(df, {col: F.coalesce(x.cast("double"), F.lit(p["value"])) if p["number"] else F.coalesce(x, F.lit(p["value"]).cast(p["type"]))})
            elif step == "transform":
                v = x.cast("double")
                df = replace(df, {col: F.log1p(v) if strategy == "log1p" else F.sqrt(v) if strategy == "sqrt" else F.log1p(F.lit(p["max"]) - v)})
            elif step == "onehot":
                extra = [F.coalesce((as_text(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in p["values"][1:]]
                df = df.select(*[c(n) for n in df.columns if n != col], *extra)
            elif step == "lookup":
                df = apply_lookup(df, col, as_text(col, "nan"), self.lookups[col], None)
            elif step == "scale":
                df = replace(df, {col: (x.cast("double") - F.lit(p["shift"])) / F.lit(p["by"])})
        return df

    def log(self) -> DataFrame:
        """Step log: what was changed, how, with which constants."""
        rows = [(i, col, step, strategy, "", json.dumps(p, sort_keys=True)) for i, (col, step, strategy, p) in enumerate(self.steps)]
        return small_table(self.spark, rows, STEP_FIELDS)

    def save(self, path: str) -> None:
        self.log().write.mode("overwrite").parquet(f"{path}/steps")
        for i, (col, look) in enumerate(sorted(self.lookups.items())):
            look.select(F.lit(col).alias("column"), "value", "cnt", "code").write.mode("overwrite").parquet(f"{path}/lookup-{i}")
        small_table(self.spark, [(len(self.lookups),)], [("lookups", "bigint")]).write.mode("overwrite").parquet(f"{path}/info")

    @staticmethod
    def load(spark, path: str) -> Fitted:
        steps = spark.read.parquet(f"{path}/steps").orderBy("position").collect()
        count = spark.read.parquet(f"{path}/info").first()["lookups"]
        lookups = {}
        for i in range(count):
            t = spark.read.parquet(f"{path}/lookup-{i}")
            lookups[t.first()["column"]] = t.drop("column")
        return Fitted(spark, [(r["column"], r["step"], r["strategy"], json.loads(r["params"])) for r in steps], lookups)


def fit_plan(df, plan: Plan) -> Fitted:
    """Fit the constants of a plan: fills from the raw table, transforms and scalers from the
    table as it is after the earlier steps."""
    f = as_facts(df)
    drops = plan.of("drop")
    fills = {n: h for n, h in plan.of("impute").items() if h in FILLS and n not in drops}
    steps: list[tuple[str, str, str, dict]] = [(n, "drop", "drop", {}) for n in drops]
    values = fill_values(f, fills)
    new = {}
    for n, v in values.items():
        if v is None:
            continue
        number = f.kinds[n] == "numeric"
        steps.append((n, "impute", fills[n], {"value": float(v) if number else v, "number": number, "type": f.types[n], "cells": f.scan()[n]["missing"]}))
        new[n] = fill_column(f.types, f.kinds, n, v)
    filled = replace(f.df.select(*[c(n) for n in f.columns if n not in drops]), new)
    g = Facts(filled)
    changes = {n: h for n, h in plan.of("transform").items() if n in filled.columns}
    for n, h in changes.items():
        m = g.scan()[n]
        if h == "reflect_log1p" or (h in ("log1p", "sqrt") and m["min"] is not None and m["min"] >= 0):
            steps.append((n, "transform", h, {"max": m["max"]} if h == "reflect_log1p" else {}))
    lookups, hot = {}, []
    for n, h in plan.of("encode").items():
        if n not in filled.columns:
            continue
        values = categories(filled, n) if h == "OneHotEncoding" else None
        if values is not None:
            hot.append((n, "onehot", h, {"values": values}))
        elif h == "OneHotEncoding":  # more categories than columns may be made of
            shares = counted(filled, as_text(n, "nan"))
            total = shares.agg(F.sum("cnt")).first()[0] or 1
            lookups[n] = shares.withColumn("code", F.col("cnt") / F.lit(float(total)))
            steps.append((n, "lookup", "FrequencyEncoding", {"instead_of": h}))
        else:
            lookups[n] = value_codes(counted(filled, as_text(n, "nan")))
            steps.append((n, "lookup", h, {}))
    target = plan.target
    if target in f.columns and f.kinds[target] == "string":
        lookups[target] = value_codes(counted(filled, as_text(target, "nan")))
        steps.append((target, "lookup", "LabelEncoding", {}))
    scales = {n: h for n, h in plan.of("scale").items() if n in filled.columns and n != target}
    if scales:
        changed = Fitted(f.spark, [s for s in steps if s[1] == "transform"]).apply(filled)
        h_facts = Facts(changed.select(*[c(n) for n in scales]))
        robust = [n for n, h in scales.items() if "Robust" in h]
        q = h_facts.quantiles([0.25, 0.5, 0.75], robust) if robust else {}
        for n, h in scales.items():
            m = h_facts.scan()[n]
            if "Robust" in h:
                p = {"shift": q[n][0.5], "by": (q[n][0.75] - q[n][0.25]) or 1.0}
            elif "MinMax" in h:
                p = {"shift": m["min"], "by": (m["max"] - m["min"]) or 1.0}
            else:
                p = {"shift": m["mean"], "by": m["std_pop"] or 1.0}
            steps.append((n, "scale", h, p))
    return Fitted(f.spark, steps + hot, lookups)


def apply_plan(df, plan: Plan) -> DataFrame:
    """Drop, impute, transform, encode, scale, one-hot; remaining nulls get the median (numbers)
    or ``Unknown`` (text)."""
    f = as_facts(df)
    done = fit_plan(f, plan).apply(f.df)
    g = Facts(done)
    rest = {}
    for n in done.columns:
        m = g.scan()[n]
        if m["missing"] and n != plan.target:
            rest[n] = "median" if g.kinds[n] == "numeric" else "constant"
    values = fill_values(g, rest) if rest else {}
    return replace(done, {n: fill_column(g.types, g.kinds, n, v) for n, v in values.items() if g.kinds[n] in ("numeric", "string")})


def plan_stats(df, plan: Plan) -> DataFrame:
    """Before and after: columns and missing cells."""
    f = as_facts(df)
    g = Facts(apply_plan(f, plan))
    before, after = (sum(m["missing"] for m in x.scan().values()) for x in (f, g))
    row = (f.rows, len(f.columns), g.rows, len(g.columns), len(plan.of("drop")), before, after, all(k == "numeric" for k in g.kinds.values()))
    return small_table(f.spark, [row], [
        ("rows_before", "bigint"), ("columns_before", "bigint"), ("rows_after", "bigint"), ("columns_after", "bigint"), ("columns_dropped", "bigint"),
        ("missing_before", "bigint"), ("missing_after", "bigint"), ("all_numeric", "boolean"),
    ])
