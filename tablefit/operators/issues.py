"""Findings as issue rows, the readiness score they add up to, the gate and its confidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import band, c, dots_and_minus_number, hash_key, row_digest, rounded
from tablefit.functions.ranks import union_quantiles
from tablefit.operators.facts import Facts, as_facts, small_table
from tablefit.operators.quality import SIMPLE_DIMS, half_up, score_of
from tablefit.operators.relate import leakage_rows
from tablefit.operators.target import choose_target, target_confidence

ISSUE_FIELDS = [("severity", "string"), ("category", "string"), ("subject", "string"), ("source", "string")]
ORDER = {"CRITICAL": 0, "HIGH": 1, "MODERATE": 2, "LOW": 3}


def anomaly_facts(anomalies: DataFrame | None) -> tuple[float, str] | None:
    """Share in percent and severity from the one-row result of the anomaly operators."""
    row = anomalies.select("anomaly_percent", "severity").first() if anomalies is not None else None
    return (row[0] or 0.0, row[1]) if row is not None else None


def issue_rows(f: Facts, target: str, anomaly: tuple[float, str] | None = None) -> list[tuple]:
    """Issues of the ``simple`` rule set as (severity, category, subject, source)."""
    scan, distinct = f.scan(), f.distinct()
    n, k = f.rows, len(f.columns)
    missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100 if n else 0.0
    rows = []
    if missing > 10:
        rows.append(("CRITICAL" if missing > 30 else "HIGH", "Completeness", "table", "dataset_summary"))
    if f.duplicates():
        rows.append(("HIGH" if f.duplicates() / n * 100 > 5 else "MODERATE", "Uniqueness", "table", "dataset_summary"))
    rows += [("HIGH", "Missing Values", x, "feature_analysis") for x in f.columns if scan[x]["missing_share"] > 0.5]
    rows += [("MODERATE", "Feature Quality", x, "feature_analysis") for x in f.columns if distinct[x] <= 1 and x != target]
    rows += [("HIGH", "Multicollinearity", f"{a}|{b}", "correlation_analysis") for (a, b), r in f.corr().items() if r is not None and abs(r) > 0.9]
    rows += [("CRITICAL", "Data Leakage", name, "leakage_analysis") for name, _, _ in leakage_rows(f, target)]
    if anomaly and anomaly[1] == "HIGH":
        rows.append(("HIGH", "Anomalies", "table", "anomaly_detection"))
    dims, _ = score_of(f, target, "simple")
    if dims["class_balance"] < 60:
        rows.append(("MODERATE", "Class Balance", target, "quality_score"))
    if n / max(k, 1) < 10:
        rows.append(("MODERATE", "Data Adequacy", "table", "dataset_summary"))
    if sum(abs(scan[x]["skew"] or 0.0) > 3 for x in f.numeric) > 3:
        rows.append(("LOW", "Feature Distribution", "table", "feature_analysis"))
    return rows


def issues(df, target: str | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """All issues; ``anomalies`` is the one-row result of the anomaly operators, when they have been run."""
    f = as_facts(df)
    return small_table(f.spark, issue_rows(f, target or choose_target(f), anomaly_facts(anomalies)), ISSUE_FIELDS)


def positive_signals(df, target: str | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """What speaks for the table: (signal, value) of each that holds."""
    f = as_facts(df)
    target = target or choose_target(f)
    anomaly = anomaly_facts(anomalies)
    missing = sum(m["missing"] for m in f.scan().values()) / (f.rows * len(f.columns)) * 100 if f.rows else 0.0
    strong = sum(r is not None and abs(r) > 0.75 for r in f.corr().values())
    leaks = len(leakage_rows(f, target))
    score, _ = _readiness(f, target, anomaly)
    checks = [
        ("near_complete", missing < 2, missing), ("no_duplicates", f.duplicates() == 0, 0.0), ("no_multicollinearity", strong == 0, 0.0), ("no_leakage", leaks == 0, 0.0),
        ("few_anomalies", anomaly is not None and anomaly[0] < 2, anomaly[0] if anomaly else 0.0), ("ready", score >= 80, score),
    ]
    t = small_table(f.spark, [(name, float(v)) for name, ok, v in checks if ok], [("signal", "string"), ("value", "double")])
    return t.withColumn("value", rounded(F.col("value"), 2))


def _readiness(f: Facts, target: str, anomaly: tuple[float, str] | None = None) -> tuple[float, list[tuple]]:
    rows = issue_rows(f, target, anomaly)
    _, overall = score_of(f, target, "simple")
    critical, high = (sum(r[0] == s for r in rows) for s in ("CRITICAL", "HIGH"))
    return half_up(max(10.0, min(100.0, overall - critical * 12 - high * 5)), 1), rows


def readiness(df, target: str | None = None, rules: str = "simple", model_issues: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """Readiness score and grade. ``simple``: quality minus 12 per critical and 5 per high issue.
    ``penalty``: 100 minus weights 12/7/4/1 (at most 60), plus 5 without critical issues;
    ``model_issues`` may add issues found by model runs, ``anomalies`` the share of flagged rows."""
    f = as_facts(df)
    if rules == "simple":
        score, rows = _readiness(f, target or choose_target(f), anomaly_facts(anomalies))
        counts = [sum(r[0] == s for r in rows) for s in ORDER]
        t = small_table(f.spark, [(score, *counts)], [("readiness_score", "double"), ("critical", "bigint"), ("high", "bigint"), ("moderate", "bigint"), ("low", "bigint")])
        s = F.col("readiness_score")
        return t.withColumn("grade", band(s, [(90, "A"), (75, "B"), (60, "C"), (45, "D")], "F")).withColumn("ready", s >= 75)
    found = penalty_issues(f, target)
    if model_issues is not None:
        found = found.unionByName(model_issues.select(*found.columns))
    count = lambda s: F.count_if(F.col("severity") == s)
    t = found.agg(*[count(s).alias(s.lower()) for s in ORDER])
    penalty = F.least(F.col("critical") * 12 + F.col("high") * 7 + F.col("moderate") * 4 + F.col("low"), F.lit(60))
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty + F.when(F.col("critical") == 0, 5).otherwise(0))).cast("double")
    t = t.withColumn("readiness_score", s)
    return t.withColumn("grade", band(F.col("readiness_score"), [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F"))


def penalty_issues(df, target: str | None = None) -> DataFrame:
    """Data issues of the ``penalty`` rule set: missing columns, target leakage, near-duplicate
    features, identical columns and weak quality dimensions."""
    from tablefit.operators.relate import duplicate_columns, leakage_with_pairs

    f = as_facts(df)
    rows = []
    for x in f.columns:
        pct = half_up(f.scan()[x]["missing_share"] * 100, 2)
        if pct > 5:
            rows.append(("CRITICAL" if pct > 60 else "HIGH" if pct > 15 else "MODERATE", "Missing Data", x, "preprocessing_suggestions"))
    dims, _ = score_of(f, target, "weighted")
    for d in SIMPLE_DIMS:
        if dims[d] < 70:
            rows.append(("HIGH" if dims[d] < 50 else "MODERATE", "Dataset Quality", d, "data_quality_score"))
    out = small_table(f.spark, rows, ISSUE_FIELDS)
    leaks = leakage_with_pairs(f, target).where("severity in ('CRITICAL', 'HIGH')").select(
        "severity", F.lit("Data Leakage").alias("category"),
        F.when(F.col("kind") == "target", F.col("feature_1")).otherwise(F.concat_ws("|", "feature_1", "feature_2")).alias("subject"),
        F.lit("leakage_detection").alias("source"),
    )
    same = duplicate_columns(f).select(
        F.lit("HIGH").alias("severity"), F.lit("Data Leakage").alias("category"), F.concat_ws("|", "feature_1", "feature_2").alias("subject"),
        F.lit("leakage_detection").alias("source"),
    )
    return out.unionByName(leaks).unionByName(same)


def action_plan(found: DataFrame, k: int = 10) -> DataFrame:
    """The k most severe issues, numbered (a top-k report)."""
    order = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MODERATE", 2).otherwise(3)
    top = found.withColumn("o", order).orderBy("o", "category", "subject").limit(k)
    return top.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("o", "category", "subject")).cast("bigint").alias("step"), "severity", "category", "subject")


def module_health(df, target: str | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """Issues found per area and a clean flag; the anomaly area only where ``anomalies`` is given."""
    from tablefit.operators.quality import sensitive_columns

    f = as_facts(df)
    target = target or choose_target(f)
    scan, n, k = f.scan(), f.rows, len(f.columns)
    missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100
    dims, _ = score_of(f, target, "simple")
    strong = sum(r is not None and abs(r) > 0.75 for r in f.corr().values())
    leaks = len(leakage_rows(f, target))
    skewed = sum(abs(scan[x]["skew"] or 0.0) > 3 for x in f.numeric)
    rows = [
        ("completeness", int(missing >= 5), missing < 5), ("uniqueness", int(f.duplicates() > 0), f.duplicates() == 0),
        ("correlation", strong, strong == 0), ("leakage", leaks, leaks == 0), ("sensitive_names", len(sensitive_columns(f.df)), not sensitive_columns(f.df)),
        ("class_balance", int(dims["class_balance"] < 70), dims["class_balance"] >= 70), ("feature_quality", skewed, skewed <= 3),
    ]
    anomaly = anomaly_facts(anomalies)
    if anomaly:
        rows.append(("anomaly", int(anomaly[0] >= 5), anomaly[0] < 5))
    return small_table(f.spark, rows, [("module", "string"), ("issues_found", "bigint"), ("clean", "boolean")])


def validate(df, target: str | None = None, anomaly_percent: float = 0.0, anomalies: DataFrame | None = None) -> DataFrame:
    """Gate of 12 checks; passes when at least 75 % hold and the leakage and target checks both do.
    ``anomalies`` is the one-row result of the anomaly operators; without it the given share counts."""
    f = as_facts(df)
    anomaly = anomaly_facts(anomalies)
    anomaly_percent = anomaly[0] if anomaly else anomaly_percent
    if target is None:
        target, confidence = target_confidence(f)
    else:
        confidence = 1.0
    scan, n, k = f.scan(), f.rows, len(f.columns)
    missing = sum(m["missing"] for m in scan.values()) / (n * k) * 100
    leaks = len(leakage_rows(f, target))
    dims, _ = score_of(f, target, "simple")
    constant = sum(v <= 1 for v in f.distinct().values())
    sparse = sum(m["missing_share"] > 0.6 for m in scan.values())
    score, _ = _readiness(f, target, anomaly)
    checks = [
        ("row_count", n >= 100, n), ("rows_per_feature", n / k >= 10, n / k), ("missing_rate", missing < 20, missing),
        ("no_duplicates", f.duplicates() == 0, f.duplicates()), ("target_detected", confidence >= 0.4, confidence), ("no_leakage", leaks == 0, leaks),
        ("class_balance", dims["class_balance"] >= 60, dims["class_balance"]), ("anomaly_rate", anomaly_percent < 8, anomaly_percent),
        ("completeness", dims["completeness"] >= 70, dims["completeness"]), ("no_constant_columns", constant == 0, constant),
        ("no_sparse_columns", sparse == 0, sparse), ("readiness", score >= 70, score),
    ]
    passed = sum(ok for _, ok, _ in checks)
    must = all(ok for name, ok, _ in checks if name in ("no_leakage", "target_detected"))
    overall = "PASS" if passed / len(checks) >= 0.75 and must else "FAIL"
    t = small_table(f.spark, [(name, "PASS" if ok else "FAIL", float(v), overall) for name, ok, v in checks], [
        ("check", "string"), ("status", "string"), ("value", "double"), ("overall", "string"),
    ])
    return t.withColumn("value", rounded(F.col("value"), 2))


# ---- confidence of the readiness score ---------------------------------------------------------

BLOCKS = 64       # rows are hashed into this many blocks, one bit each
KEPT_BLOCKS = 51  # 80 % of the blocks make one subsample


def subsample_masks(n: int) -> list[int]:
    """Block sets of the subsamples: the 51 blocks with the smallest md5 of 'iteration-block'."""
    import hashlib

    masks = []
    for i in range(n):
        order = sorted(range(BLOCKS), key=lambda b: hashlib.md5(f"{i}-{b}".encode()).hexdigest())
        masks.append(sum(1 << b for b in order[:KEPT_BLOCKS]))
    return masks


def block_of(key: list[str]):
    """Block number 0..63 of a row from the md5 of its key."""
    return F.conv(F.substring(hash_key(key), 1, 2), 16, 10).cast("int") % BLOCKS


def in_each(masks: list[int], seen: str = "seen", cnt: str = "cnt") -> list:
    """For every union of blocks the sum of ``cnt`` over rows whose block set ``seen`` meets it."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return [F.sum(F.when(F.col(seen).bitwiseAND(F.lit(m).cast("long")) != 0, F.col(cnt))).alias(f"u{i}") for i, m in enumerate(signed)]


def outside_fences(placed: DataFrame, cols: list[str], masks: list[int]) -> dict[tuple[int, int], int]:
    """Values beyond the 1.5 IQR fences of each union, by (union, column). Only values beyond the innermost
    fences of a column are compared with the fences of all unions."""
    if not cols:
        return {}
    unions = np.array([[m >> b & 1 for b in range(BLOCKS)] for m in masks])
    pairs = [x for i, n in enumerate(cols) for x in (F.lit(i), c(n).cast("double"))]
    rows = placed.select(F.col("__b").alias("b"), F.stack(F.lit(len(cols)), *pairs).alias("i", "v")).where("v is not null")
    q = union_quantiles(rows, unions, [0.25, 0.75])
    table = []
    for i in range(len(cols)):
        ends = []
        for u in range(len(masks)):
            a, b = q.get((u, i, 0.25)), q.get((u, i, 0.75))
            ends.append((-math.inf, math.inf) if a is None else (a - 1.5 * (b - a), b + 1.5 * (b - a)))
        lows, highs = [e[0] for e in ends], [e[1] for e in ends]
        table.append((i, lows, highs, max(lows), min(highs)))
    fences = small_table(placed.sparkSession, table, [("ci", "int"), ("lows", "array<double>"), ("highs", "array<double>"), ("low", "double"), ("high", "double")])
    far = rows.join(F.broadcast(fences), (F.col("i") == F.col("ci")) & ((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))))  # one row per column
    beyond = lambda u: F.count_if((F.col("v") < F.col("lows")[u]) | (F.col("v") > F.col("highs")[u])).alias(f"u{u}")
    out: dict[tuple[int, int], int] = {}
    for r in far.groupBy("i", "b").agg(*[beyond(u) for u in range(len(masks))]).collect():
        for u in range(len(masks)):
            if unions[u, r["b"]]:
                out[u, r["i"]] = out.get((u, r["i"]), 0) + r[f"u{u}"]
    return out


def mapped_in_each(f: Facts, placed: DataFrame, target: str, masks: list[int]) -> list[int]:
    """Per union of blocks: columns with as many values as the target whose every value meets one target value.

    Values are counted by the set of blocks they occur in. Only columns that reach the target's number in
    some union are looked at closer; for them the smallest and largest target of each value and block
    decide, at most one entry a block."""
    ys = F.bit_or(F.expr("shiftleft(1L, __b)"))
    value = lambda x: (c(x) + F.lit(0.0) if f.types[x] in ("double", "float") else c(x)).cast("string")
    entries = [F.when(c(x).isNotNull(), F.struct(F.lit(i).alias("i"), value(x).alias("v"))) for i, x in enumerate(f.columns)]
    long = placed.select("__b", value(target).alias("y"), F.explode(F.array(*entries)).alias("e")).where("e is not null").select("__b", "y", "e.i", "e.v")
    seen = long.groupBy("i", F.md5("v").alias("h")).agg(ys.alias("seen")).groupBy("i", "seen").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r["i"]: [r[f"u{u}"] or 0 for u in range(len(masks))] for r in seen.groupBy("i").agg(*in_each(masks)).collect()}
    at = f.columns.index(target)
    same = {i: {u for u in range(len(masks)) if n[u] == got[at][u] > 0} for i, n in got.items() if i != at} if at in got else {}
    same = {i: us for i, us in same.items() if us}
    out = [0] * len(masks)
    if not same:
        return out
    cells = long.where(F.col("i").isin(list(same)) & F.col("y").isNotNull()).groupBy("i", "v", "__b").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    values = cells.groupBy("i", "v").agg(F.collect_list(F.struct(F.col("__b").alias("b"), "lo", "hi")).alias("by"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    def split(u):
        """Whether a value meets two targets in union u."""
        own = F.filter("by", lambda e: F.lit(_bits(masks[u]))[e["b"]] == 1)
        return F.coalesce(F.array_min(F.transform(own, lambda e: e["lo"])) != F.array_max(F.transform(own, lambda e: e["hi"])), F.lit(False))

    # a value with one target in the whole table has one in every union
    doubtful = values.where("lo <> hi").groupBy("i").agg(*[F.bool_or(split(u)).alias(f"u{u}") for u in range(len(masks))]).collect()
    bad = {(r["i"], u) for r in doubtful for u in range(len(masks)) if r[f"u{u}"]}
    for i, us in same.items():
        for u in us:
            out[u] += (i, u) not in bad
    return out


def _bits(mask: int) -> list[int]:
    return [mask >> b & 1 for b in range(BLOCKS)]


def readiness_samples(df, key: list[str], target: str, n: int = 50) -> DataFrame:
    """Readiness of n subsamples of 80 % without replacement, one row each.

    Rows never multiply: one scan reduces the table to 64 blocks of sufficient statistics
    (counts, nulls, ranges, cross products, class counts), and a subsample is a union of 51 of
    them. Distinct rows and values carry the set of blocks they occur in as a 64-bit mask. Outlier
    fences, mixed columns and one-to-one columns are those of the subsample itself.
    """
    f = as_facts(df)
    scan, k = f.scan(), len(f.columns)
    masks = subsample_masks(n)
    # (subsample, block) pairs: n * 51 rows, so every union below is an equi-join on the block
    members = small_table(f.spark, [(i, b) for i, m in enumerate(masks) for b in range(BLOCKS) if m >> b & 1], [("i", "int"), ("b", "int")])
    members = F.broadcast(members)
    placed = f.df.withColumn("__b", block_of(key))
    numbers, y = f.numeric, c(target).cast("string")
    fenced = [x for x in numbers if x != target]

    # block statistics: one row per block
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(c(x)).alias(f"p{i}") for i, x in enumerate(f.columns)]
    aggs += [F.min(c(x)).cast("string").alias(f"lo{i}") for i, x in enumerate(f.columns)]
    aggs += [F.max(c(x)).cast("string").alias(f"hi{i}") for i, x in enumerate(f.columns)]
    aggs += [F.count_if(dots_and_minus_number(c(x), True)).alias(f"d{j}") for j, x in enumerate(f.strings)]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1:]]
    for j, (a, b) in enumerate(pairs):
        dx, dy = c(a).cast("double") - (scan[a]["mean"] or 0.0), c(b).cast("double") - (scan[b]["mean"] or 0.0)
        dx, dy = F.when(dy.isNotNull(), dx), F.when(dx.isNotNull(), dy)
        aggs += [F.count(dx).alias(f"cn{j}"), F.sum(dx).alias(f"cx{j}"), F.sum(dy).alias(f"cy{j}"), F.sum(dx * dx).alias(f"cxx{j}"), F.sum(dy * dy).alias(f"cyy{j}"), F.sum(dx * dy).alias(f"cxy{j}")]
    blocks = placed.groupBy(F.col("__b").alias("b")).agg(*aggs)
    merged = blocks.join(members, "b").groupBy("i").agg(
        F.sum("n").alias("n"),
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)],
        *[(F.coalesce(F.min(f"lo{i}") == F.max(f"hi{i}"), F.lit(True))).alias(f"const{i}") for i in range(k)],
        *[F.sum(f"d{j}").alias(f"d{j}") for j in range(len(f.strings))],
        *[F.sum(f"{m}{j}").alias(f"{m}{j}") for j in range(len(pairs)) for m in ("cn", "cx", "cy", "cxx", "cyy", "cxy")],
    )
    # distinct rows per union, from fingerprints grouped by the blocks they occur in
    bit = F.expr("shiftleft(1L, __b)")
    prints = placed.select(*row_digest(f.df), bit.alias("bit")).groupBy("d1", "d2").agg(F.bit_or("bit").alias("seen"))
    seen = prints.groupBy("seen").agg(F.count(F.lit(1)).alias("cnt"))
    row = seen.agg(*in_each(masks)).first()
    outside = outside_fences(placed, fenced, masks)
    mapped = mapped_in_each(f, placed, target, masks)
    own = [(i, row[f"u{i}"] or 0, mapped[i], *[outside.get((i, j), 0) for j in range(len(fenced))]) for i in range(n)]
    own = small_table(f.spark, own, [("i", "int"), ("distinct_rows", "bigint"), ("mapped", "int"), *[(f"o{j}", "bigint") for j in range(len(fenced))]])
    classes = placed.where(y.isNotNull()).groupBy(y.alias("y"), F.col("__b").alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    per_class = classes.join(members, "b").groupBy("i", "y").agg(F.sum("cnt").alias("cnt"))
    balance = per_class.groupBy("i").agg(F.count(F.lit(1)).alias("k_y"), F.max("cnt").alias("y_hi"), F.min("cnt").alias("y_lo"))

    t = merged.join(F.broadcast(own), "i").join(balance, "i", "left")  # one row per subsample
    n_ = F.col("n")
    missing = (n_ * k - sum((F.col(f"p{i}") for i in range(k)), F.lit(0))) / (n_ * k) * 100
    repeats = (n_ - F.col("distinct_rows")) / n_ * 100
    col_of = {x: i for i, x in enumerate(f.columns)}
    digits = [F.col(f"d{j}") / F.nullif(F.col(f"p{col_of[x]}"), F.lit(0)) for j, x in enumerate(f.strings)]
    mixed = sum((F.when((s > 0.3) & (s < 0.8), 1).otherwise(0) for s in digits), F.lit(0))
    rates = [F.when(F.col(f"p{col_of[x]}") > 3, F.col(f"o{j}") / F.nullif(F.col(f"p{col_of[x]}"), F.lit(0)) * 100) for j, x in enumerate(fenced)]
    count_rates = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in rates), F.lit(0))
    rate = sum((F.coalesce(r, F.lit(0.0)) for r in rates), F.lit(0.0)) / F.greatest(count_rates, F.lit(1))
    balance_score = F.when(F.col("k_y") >= 2, F.greatest(F.lit(0.0), 100 - F.log10(F.col("y_hi") / F.col("y_lo")) * 30)).otherwise(100.0)
    dims = [
        F.greatest(F.lit(0.0), 100 - missing * 2.5), F.greatest(F.lit(0.0), 100 - repeats * 2), F.greatest(F.lit(0.0), 100.0 - mixed * 10),
        balance_score, F.greatest(F.lit(0.0), 100 - rate * 3), F.least(F.lit(100.0), n_ / k * 5),
    ]
    dims = [rounded(d, 1) for d in dims]
    overall = rounded(sum(dims[1:], dims[0]) / 6, 1)

    def r_of(j):
        m = {x: F.col(f"{x}{j}") for x in ("cn", "cx", "cy", "cxx", "cyy", "cxy")}
        inv = F.nullif(m["cn"], F.lit(0))
        vx, vy = m["cxx"] - m["cx"] * m["cx"] / inv, m["cyy"] - m["cy"] * m["cy"] / inv
        scale = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
        return F.abs((m["cxy"] - m["cx"] * m["cy"] / inv) / F.nullif(scale, F.lit(0.0)))

    flag = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)
    rs = {p: r_of(j) for j, p in enumerate(pairs)}
    critical = flag(missing > 30) + sum((flag(r > 0.95) for p, r in rs.items() if target in p), F.lit(0)) + F.col("mapped")
    high = flag((missing > 10) & (missing <= 30)) + flag(repeats > 5)
    high = high + sum((flag(F.col(f"p{i}") < n_ * 0.5) for i in range(k)), F.lit(0)) + sum((flag(r > 0.9) for r in rs.values()), F.lit(0))
    score = F.greatest(F.lit(10.0), F.least(F.lit(100.0), overall - critical * 12 - high * 5))
    return t.select("i", n_.alias("rows"), rounded(score, 1).alias("readiness_score"))


def readiness_ci(df, key: list[str], target: str, n: int = 50) -> DataFrame:
    """Mean, population deviation, 95 % interval and stability band of the subsample scores."""
    s = F.col("readiness_score")
    t = readiness_samples(df, key, target, n).agg(
        F.count(F.lit(1)).alias("iterations"), rounded(F.avg(s)).alias("mean_readiness_score"), rounded(F.stddev_pop(s)).alias("std_dev"),
        rounded(F.percentile(s, F.lit(0.025))).alias("ci_95_lower"), rounded(F.percentile(s, F.lit(0.975))).alias("ci_95_upper"),
    )
    sd = F.col("std_dev")
    return t.withColumn("stability", F.when(sd < 3, "HIGH").when(sd < 7, "MODERATE").otherwise("LOW"))
