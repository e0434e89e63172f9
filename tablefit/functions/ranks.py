"""Exact order statistics, running totals and row numbers that never sort a whole group in one task.

* ``exact_quantiles``: a bounded sketch brackets every wanted rank, one scan counts what lies
  below the bracket, and only the few values inside it are shuffled. Brackets that are still
  large are narrowed by another sketch, so the shuffled volume does not grow with the table.
* ``running_total``: values are first cut into range buckets by sketch edges; sorting happens
  inside a bucket and bucket offsets come from a small table of bucket sums.
* ``hash_row_number``: the same two levels over md5 prefixes, for splits, folds and sampling.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.exprs import c, hash_key, long_numbers

SKETCH_ACCURACY = 5000   # rank error of the bracket sketch is n / accuracy
BRACKET_LIMIT = 100_000  # values of one bracket that one task may sort
COLUMNS_PER_SCAN = 25    # keeps the wide aggregates within what code generation can take
RANGE_BUCKETS, MOST_BUCKETS = 32, 1024  # value ranges of a running total
NARROW_STEPS = 100      # parts a bracket is cut into when it holds too many values
TOGETHER = 500_000      # distinct values that columns counted in one pass may have between them
GROUP_ROWS, HOT_PARTS = 500_000, 32  # groups that one task of an aggregation holds; parts of a frequent one
BUCKET_ROWS = 1_000_000  # counted values that one task sorts, as long as MOST_BUCKETS ranges are enough


def _chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    accuracy: int = SKETCH_ACCURACY,
    limit: int = BRACKET_LIMIT,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation between order statistics, for every column."""
    out: dict[str, dict[float, float | None]] = {}
    for part in _chunks(cols, COLUMNS_PER_SCAN):
        out.update(_quantiles_of(df, part, probs, accuracy, limit))
    return out


def _quantiles_of(df, cols, probs, accuracy, limit):
    if not cols:
        return {}
    rows = long_numbers(df, cols)
    points = sorted({min(1.0, max(0.0, p + s / accuracy)) for p in probs for s in (-2, 2)})
    seen = {
        r["i"]: r
        for r in rows.groupBy("i").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.percentile_approx("v", points, accuracy).alias("s"),
        ).collect()
    }
    picks: dict[str, dict[float, float | None]] = {n: {p: None for p in probs} for n in cols}
    brackets: dict[tuple[int, float], list[float]] = {}
    ranks: dict[tuple[int, float], tuple[int, int, float]] = {}
    for i, got in seen.items():
        sketch, n = dict(zip(points, got["s"])), got["n"]
        for p in probs:
            at = p * (n - 1)
            lo = math.floor(at)
            ranks[i, p] = (lo, min(n - 1, lo + 1), at - lo)
            low, high = max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)
            brackets[i, p] = [got["lo"] if low == 0.0 else sketch[low], got["hi"] if high == 1.0 else sketch[high]]

    pending = list(brackets)
    while pending:
        small, retry = [], []
        counts = _bracket_counts(rows, pending, brackets)
        for key in pending:
            i, p = key
            below, upto = counts[key]
            lo, hi, w = ranks[key]
            a, b = brackets[key]
            if below > lo:
                brackets[key] = [seen[i]["lo"], b]
                retry.append(key)
            elif upto <= hi:
                brackets[key] = [a, seen[i]["hi"]]
                retry.append(key)
            elif a == b:
                picks[cols[i]][p] = a
            else:
                small.append(key)
        large = [k for k in small if counts[k][1] - counts[k][0] > limit]
        if large:
            small, narrowed = _narrow(df, cols, small, large, brackets, ranks, counts, accuracy, limit)
            retry += narrowed
        for (i, p), (x_lo, x_hi) in _bracket_values(df, cols, small, brackets, ranks, counts).items():
            picks[cols[i]][p] = x_lo + (x_hi - x_lo) * ranks[i, p][2]
        pending = retry
    return picks


def _bracket_counts(rows, keys, brackets):
    """How many values lie below each bracket and up to its end, for all columns in one scan."""
    slots: dict[int, list] = {}
    for key in keys:
        slots.setdefault(key[0], []).append(key)
    width = max(len(v) for v in slots.values())
    def bounds(side: int) -> Column:
        """Per column the bracket ends as one array, padded to equal length."""
        entries = []
        for i, v in slots.items():
            ends = [brackets[k][side] for k in v] + [0.0] * (width - len(v))
            entries += [F.lit(i), F.array(*[F.lit(float(e)) for e in ends])]
        return F.create_map(*entries)[F.col("i")]

    known = rows.where(F.col("i").isin(list(slots))).select("i", "v", bounds(0).alias("lo"), bounds(1).alias("hi"))
    aggs = []
    for s in range(width):
        aggs += [F.count_if(F.col("v") < F.col("lo")[s]).alias(f"a{s}"), F.count_if(F.col("v") <= F.col("hi")[s]).alias(f"b{s}")]
    got = known.groupBy("i").agg(*aggs).collect()
    return {key: (r[f"a{s}"], r[f"b{s}"]) for r in got for s, key in enumerate(slots[r["i"]])}


def _inside(df, cols, keys, brackets) -> DataFrame:
    """(j, v): the values inside the bracket of keys[j]; one row per bracket is broadcast, so the generated
    code does not grow with their number."""
    from tablefit.operators.facts import small_table

    ends = [(j, i, float(brackets[i, p][0]), float(brackets[i, p][1])) for j, (i, p) in enumerate(keys)]
    table = small_table(df.sparkSession, ends, [("j", "int"), ("ci", "int"), ("a", "double"), ("b", "double")])
    used = sorted({i for i, _ in keys})
    place = F.array(*[F.lit(i) for i in used])
    rows = long_numbers(df, [cols[i] for i in used]).select(place[F.col("i")].alias("i"), "v")
    hit = (F.col("i") == F.col("ci")) & (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))
    return rows.join(F.broadcast(table), hit).select("j", "v")


def _narrow(df, cols, small, large, brackets, ranks, counts, accuracy, limit):
    """Tighten brackets that hold too many values; few distinct values need no tightening."""
    steps = [k / NARROW_STEPS for k in range(NARROW_STEPS + 1)]
    got = {
        r["j"]: r
        for r in _inside(df, cols, large, brackets).groupBy("j").agg(
            F.approx_count_distinct("v", 0.02).alias("d"), F.percentile_approx("v", steps, accuracy).alias("s"),
        ).collect()
    }
    keep, again = [k for k in small if k not in large], []
    for j, key in enumerate(large):
        below, upto = counts[key]
        lo, hi, _ = ranks[key]
        n, s = upto - below, got[j]["s"]
        first = math.floor(((lo - below) / n - 2 / accuracy) * NARROW_STEPS)
        last = math.ceil(((hi + 1 - below) / n + 2 / accuracy) * NARROW_STEPS)
        tight = [s[first] if first > 0 else brackets[key][0], s[last] if last < NARROW_STEPS else brackets[key][1]]
        if got[j]["d"] <= limit or tight == brackets[key]:
            keep.append(key)
        else:
            brackets[key] = tight
            again.append(key)
    return keep, again


def _bracket_values(df, cols, keys, brackets, ranks, counts):
    """The two order statistics of every bracket, from the counted values inside it."""
    if not keys:
        return {}
    values = _inside(df, cols, keys, brackets).groupBy("j", "v").agg(F.count(F.lit(1)).alias("cnt"))
    start = F.create_map(*[F.lit(v) for j, k in enumerate(keys) for v in (j, counts[k][0])])
    want_lo = F.create_map(*[F.lit(v) for j, k in enumerate(keys) for v in (j, ranks[k][0])])
    want_hi = F.create_map(*[F.lit(v) for j, k in enumerate(keys) for v in (j, ranks[k][1])])
    upto = F.sum("cnt").over(W.partitionBy("j").orderBy("v")) + start[F.col("j")]
    rows = (
        values.withColumn("upto", upto)
        .groupBy("j")
        .agg(
            F.min(F.when(F.col("upto") > want_lo[F.col("j")], F.col("v"))).alias("x_lo"),
            F.min(F.when(F.col("upto") > want_hi[F.col("j")], F.col("v"))).alias("x_hi"),
        )
        .collect()
    )
    return {keys[r["j"]]: (r["x_lo"], r["x_hi"]) for r in rows}


def union_quantiles(rows: DataFrame, unions: np.ndarray, probs: list[float], cuts: int = 63, accuracy: int = SKETCH_ACCURACY) -> dict[tuple[int, int, float], float]:
    """Exact quantiles (linear interpolation) of many unions of blocks at once, by (union, column, prob).

    ``rows`` holds b (block), i (column) and v (number, not null); ``unions`` is a 0/1 matrix of unions and
    blocks. A grid of counts by (column, value range, block) says in which range each wanted rank of each
    union lies; only ranges that hold a rank are cut again, until they hold one value. Cuts come from
    sketches and only steer the work: a value that is a cut has a range of its own, so hot values end the
    search at once. What reaches the driver is (ranges x blocks) counts, never rows.
    """
    from tablefit.operators.facts import small_table

    spark, blocks = rows.sparkSession, unions.shape[1]
    near = sorted({min(1.0, max(0.0, p + d / 2000)) for p in probs for d in (-200, -40, -20, -10, -4, -2, -1, 0, 1, 2, 4, 10, 20, 40, 200)})
    even = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found: dict[tuple, float] = {}
    # wanted ranks by interval: (column, lo, hi) -> [(union, rank, rows of the union below the interval)]
    first = rows.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", near, accuracy).alias("cuts")).collect()
    pending = {(r["i"], r["lo"], r["hi"]): None for r in first}
    at_cuts = {(r["i"], r["lo"], r["hi"]): sorted(set(r["cuts"])) for r in first}
    ranks: dict[tuple[int, int], dict[float, tuple[int, int, float]]] = {}
    while pending:
        keys = sorted(pending)
        table = small_table(spark, [(k, *key, at_cuts[key]) for k, key in enumerate(keys)], [("k", "int"), ("ci", "int"), ("lo", "double"), ("hi", "double"), ("cuts", "array<double>")])
        # one row per interval that still holds a wanted rank
        held = rows.join(F.broadcast(table), (F.col("i") == F.col("ci")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        spot = F.size(F.filter("cuts", lambda e: e < F.col("v"))) + F.size(F.filter("cuts", lambda e: e <= F.col("v")))
        grid = held.groupBy("k", spot.alias("s"), "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas()
        again: dict[tuple, list] = {}
        for k, part in grid.groupby("k"):
            key = keys[k]
            spots, at = np.unique(part["s"].to_numpy(), return_inverse=True)
            counts = np.zeros((len(spots), blocks), np.int64)
            np.add.at(counts, (at, part["b"].to_numpy()), part["n"].to_numpy())
            lo = part.groupby("s")["lo"].min().to_numpy()
            hi = part.groupby("s")["hi"].max().to_numpy()
            upto = np.cumsum(counts @ unions.T.astype(np.int64), axis=0)  # (ranges, unions)
            wanted = pending[key]
            if wanted is None:
                wanted = []
                for u in range(len(unions)):
                    n = int(upto[-1, u])
                    if n:
                        for p in probs:
                            place = p * (n - 1)
                            low = math.floor(place)
                            ranks.setdefault((u, key[0]), {})[p] = (low, min(n - 1, low + 1), place - low)
                            wanted += [(u, low, 0), (u, min(n - 1, low + 1), 0)]
            for u, rank, below in sorted(set(wanted)):
                s = int(np.searchsorted(upto[:, u], rank - below, side="right"))
                if lo[s] == hi[s]:
                    found[u, key[0], rank] = float(lo[s])
                else:
                    again.setdefault((key[0], float(lo[s]), float(hi[s])), []).append((u, rank, below + (int(upto[s - 1, u]) if s else 0)))
        pending = again
        if pending:
            keys = sorted(pending)
            table = small_table(spark, [(k, *key) for k, key in enumerate(keys)], [("k", "int"), ("ci", "int"), ("lo", "double"), ("hi", "double")])
            held = rows.join(F.broadcast(table), (F.col("i") == F.col("ci")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
            got = held.groupBy("k").agg(F.percentile_approx("v", even, 10 * (cuts + 1)).alias("cuts")).collect()
            at_cuts = {keys[r["k"]]: sorted(set(r["cuts"])) for r in got}
    out = {}
    for (u, i), by in ranks.items():
        for p, (low, high, w) in by.items():
            a, b = found[u, i, low], found[u, i, high]
            out[u, i, p] = a + (b - a) * w
    return out


def running_total(
    counted: DataFrame,
    group: list[str],
    order: str,
    values: list[str],
    edge_group: list[str] | None = None,
    buckets: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``<value>_upto`` columns: totals of all rows of the group whose ``order`` is not larger.

    ``counted`` should hold each (group, order) once, so that a hot value is a single row.
    ``edge_group`` are the columns bucket edges are taken for (few distinct keys: the edge table
    is broadcast and holds at most that number times MOST_BUCKETS numbers); the default is ``group``.
    The number of buckets, if not given, follows the rows counted with the edges: about ``bucket_rows``
    in each, at least RANGE_BUCKETS.
    """
    edge_group = group if edge_group is None else edge_group
    every = F.percentile_approx(F.col(order).cast("double"), [(k + 1) / MOST_BUCKETS for k in range(MOST_BUCKETS - 1)], 10 * MOST_BUCKETS)
    wanted = F.lit(buckets) if buckets else F.least(F.greatest(F.ceil(F.count(F.lit(1)) / bucket_rows), F.lit(RANGE_BUCKETS)), F.lit(MOST_BUCKETS))
    step = F.floor(F.lit(MOST_BUCKETS) / wanted).cast("int")
    cut = F.filter(every, lambda _, k: (k + 1) % step == 0).alias("__edges")
    if edge_group:
        edges = counted.groupBy(*edge_group).agg(cut)
        placed = counted.join(F.broadcast(edges), edge_group)
    else:
        placed = counted.crossJoin(F.broadcast(counted.agg(cut)))  # one row of edges
    spot = F.size(F.filter(F.array_distinct("__edges"), lambda e: e < F.col(order).cast("double")))
    placed = placed.withColumn("__b", spot).drop("__edges")
    keys = [*group, "__b"]
    sums = placed.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = W.partitionBy(*keys).orderBy(order)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"__l_{v}") for v in values])
    joined = local.join(F.broadcast(offsets) if edge_group == group and edge_group else offsets, keys)
    return joined.select(
        *[F.col(n) for n in counted.columns],
        *[(F.col(f"__l_{v}") + F.col(f"__o_{v}")).alias(f"{v}_upto") for v in values],
    )


def hash_row_number(
    df: DataFrame, group: list[str], key: list[str], name: str = "rn", salt: str = "", digits: int = 3
) -> DataFrame:
    """row_number() over (partition by group order by md5(key)), and the group size as ``<name>_of``.

    The window is partitioned by group *and* md5 prefix; prefixes of a group add up to at most
    16**digits offset rows, so a group with a third of the table is still spread out.
    """
    hashed = df.withColumn("__h", hash_key(key, salt)).withColumn("__p", F.substring("__h", 1, digits))
    sums = hashed.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy(*group).orderBy("__p") if group else W.partitionBy(F.lit(0)).orderBy("__p")
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    offsets = sums.select(
        *group, "__p",
        F.coalesce(F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
        F.sum("__n").over(whole).alias(f"{name}_of"),
    )
    same = F.lit(True)
    left, right = hashed.alias("l"), offsets.alias("r")
    for k in [*group, "__p"]:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    placed = left.join(right, same).select("l.*", "r.__o", f"r.{name}_of")
    inside = W.partitionBy(*group, "__p").orderBy("__h")
    return placed.withColumn(name, F.row_number().over(inside) + F.col("__o")).drop("__h", "__p", "__o")


def average_rank(counted: DataFrame, group: list[str], order: str, count: str) -> DataFrame:
    """Average rank (ties share) of every counted value, in column ``rank``."""
    done = running_total(counted, group, order, [count])
    return done.withColumn("rank", F.col(f"{count}_upto") - (F.col(count) - 1) / F.lit(2.0)).drop(f"{count}_upto")


def attach_values(df: DataFrame, lookup: DataFrame, key: str, count: str, rows: int, small: int = 100_000) -> DataFrame:
    """Left join of rows with a per-value lookup table that is safe for hot values.

    ``lookup`` holds each value once with its row count. A small lookup is broadcast. For a large
    one, values that carry more than 1/1000 of the rows (so fewer than 1000 of them) are broadcast
    and the evenly spread rest is joined by a shuffle.
    """
    size = lookup.limit(small + 1).count()
    if size <= small:
        return df.join(F.broadcast(lookup.drop(count)), key, "left")
    hot_at = max(1, rows // 1000)
    hot = lookup.where(F.col(count) >= hot_at).drop(count)
    cold = lookup.where(F.col(count) < hot_at).drop(count)
    is_hot = hot.select(key).withColumn("__hot", F.lit(True))
    marked = df.join(F.broadcast(is_hot), key, "left")
    first = marked.where(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(hot), key, "left")
    second = marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(cold, key, "left")
    # nulls meet nothing and are not shuffled
    empty = df.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in cold.schema if f.name != key])
    return first.unionByName(second).unionByName(empty)


def count_values(df: DataFrame, cols: list[str], text_limit: int | None = None) -> DataFrame:
    """Value counts of several columns in one shuffle: (column, num, txt, cnt), nulls left out.

    Numbers stay numbers (``num`` bigint-exact through ``big``); everything else is text.
    """
    entries = []
    for name, fields in _typed_values(df, cols, text_limit).items():
        entries.append(
            F.when(c(name).isNotNull(), F.struct(F.lit(name).alias("column"), *[x.alias(n) for n, x in fields.items()]))
        )
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
    return rows.groupBy("column", "big", "num", "txt").agg(F.count(F.lit(1)).alias("cnt"))


def _typed_values(df: DataFrame, cols: list[str], text_limit: int | None) -> dict[str, dict[str, Column]]:
    """Per column its value as big, num and txt; two of the three are null."""
    from tablefit.sources.tables import column_kinds, integral_cols

    kinds, whole = column_kinds(df), integral_cols(df)
    out = {}
    for name in cols:
        x = c(name)
        big = x.cast("bigint") if name in whole else F.lit(None).cast("bigint")
        num = F.lit(None).cast("double") if name in whole or kinds[name] != "numeric" else x.cast("double") + F.lit(0.0)
        txt = x.cast("string") if kinds[name] != "numeric" else F.lit(None).cast("string")
        if text_limit is not None and kinds[name] == "string":
            txt = F.when(F.length(x) > text_limit, F.md5(x)).otherwise(x)
        out[name] = {"big": big, "num": num, "txt": txt}
    return out


def group_many(df: DataFrame, keys: list[str], aggs: dict[str, tuple[Column, Column]], groups: int) -> DataFrame:
    """Group by ``keys``, of which there are about ``groups``: per result its aggregate and how parts of it merge.

    Few groups are combined in the map tasks. More than GROUP_ROWS a core are dealt out first, by key and
    one of HOT_PARTS parts, then by key, so that no task holds many more than GROUP_ROWS groups, however
    many rows it scans, and no task takes all rows of a frequent one."""
    spark, parts = df.sparkSession, math.ceil(groups / GROUP_ROWS)
    once, merged = ([a[k].alias(n) for n, a in aggs.items()] for k in (0, 1))
    if parts <= spark.sparkContext.defaultParallelism:
        return df.groupBy(*keys).agg(*once)
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)))
    some = dealt.repartition(parts, *keys, "__part").groupBy(*keys, "__part").agg(*once)
    return some.repartition(parts, *keys).groupBy(*keys).agg(*merged)


def distinct_counts(df: DataFrame, cols: list[str], text_limit: int | None = None, together: int = TOGETHER) -> dict[str, int]:
    """Exact number of distinct non-null values per column.

    A task holds the values it has seen of all columns of one pass. Estimates (one scan) say how many
    those are: columns share a pass as long as they have ``together`` values, and a column with more has
    one to itself, in which only its own value is the key; very many values are dealt out before they are
    counted, so that what a task holds does not follow the rows it scans."""
    from tablefit.sources.tables import column_kinds, integral_cols

    kinds, whole = column_kinds(df), integral_cols(df)
    sizes: dict[str, int] = {}
    for part in _chunks(cols, COLUMNS_PER_SCAN):
        row = df.agg(*[F.approx_count_distinct(c(n)).alias(f"k{i}") for i, n in enumerate(part)]).first()
        sizes |= {n: row[f"k{i}"] for i, n in enumerate(part)}
    passes, room = [[]], together
    for name in sorted(cols, key=lambda n: sizes[n]):
        if sizes[name] > room and passes[-1]:
            passes.append([])
            room = together
        passes[-1].append(name)
        room -= sizes[name]
    out = dict.fromkeys(cols, 0)
    for part in passes:
        if len(part) == 1:
            name = part[0]
            field = "big" if name in whole else "num" if kinds[name] == "numeric" else "txt"
            values = df.where(c(name).isNotNull()).select(_typed_values(df, part, text_limit)[name][field].alias("v"))
            out[name] = group_many(values, ["v"], {"cnt": (F.count(F.lit(1)), F.sum("cnt"))}, sizes[name]).count()
        elif part:
            counted = count_values(df, part, text_limit).groupBy("column").agg(F.count(F.lit(1)).alias("k"))
            out |= {r["column"]: r["k"] for r in counted.collect()}
    return out


def when_map(key: Column, table: dict, otherwise=None) -> Column:
    """Small literal lookup as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(otherwise)
    return out.otherwise(F.lit(otherwise))
