"""Filter interaction audit: what every filter removes at every place of every order, and its Shapley value.

All that the orders can show is in one small table: how many documents each coalition of filters
removes. A document is reduced to the set of filters it fails; counts by set give the removals of all
coalitions, and a step of an order is the difference of two of them. Shapley values are the solution
of the kernel-weighted least-squares problem whose values must add up to what all filters remove. Its
normal equations are solved once, in rationals, for a general game; the solution is linear in the
coalition removals, so Spark only multiplies by whole numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.ranks import attach_values
from tablefit.llm.common import WORD, need, settle, text_of

LETTERS = "ABCDE"


def shapley_weights(players: int) -> list[list[int]]:
    """Whole numbers c[i][S] with players! * Shapley value of i = sum over coalitions S of c[i][S] * v(S).

    S is a bit mask. Least squares over the proper coalitions with the Shapley kernel as weights, under
    the constraint that the values add up to v(all) (v of the empty coalition is 0). One multiplier row
    holds the constraint; right-hand sides are linear forms in v, one column per coalition.
    """
    n, full = players, (1 << players) - 1
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for s in range(1, full):
        size = s.bit_count()
        kernel = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            right[i][s] += kernel
            for j in inside:
                left[i][j] += kernel
    for i in range(n):
        left[i][n] = left[n][i] = Fraction(1)
    right[n][full] = Fraction(1)
    for i in range(n + 1):
        at = next(r for r in range(i, n + 1) if left[r][i])
        left[i], left[at], right[i], right[at] = left[at], left[i], right[at], right[i]
        scale = left[i][i]
        left[i], right[i] = [x / scale for x in left[i]], [x / scale for x in right[i]]
        for r in range(n + 1):
            factor = left[r][i]
            if r != i and factor:
                left[r] = [x - factor * y for x, y in zip(left[r], left[i])]
                right[r] = [x - factor * y for x, y in zip(right[r], right[i])]
    scaled = [[x * factorial(n) for x in row] for row in right[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the weights times players! are whole numbers")
    return [[int(x) for x in row] for row in scaled]


def coalition_removals(masks: DataFrame, players: int, counts: list[str]) -> DataFrame:
    """One row per part: its total of each count, and in ``<count>_by`` what each of the coalitions removes.

    ``masks`` holds part, mask (bits of the filters failed) and the counts; a coalition removes the rows
    that fail any of its filters. Entry S of an array belongs to the coalition with bit mask S.
    """
    hit = [F.col("mask").bitwiseAND(F.lit(s)) != 0 for s in range(1 << players)]
    return masks.groupBy("part").agg(
        *[F.sum(n).alias(n) for n in counts],
        *[F.array(*[F.coalesce(F.sum(F.when(h, F.col(n))), F.lit(0)) for h in hit]).alias(f"{n}_by") for n in counts],
    )


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (the filter's removals summed over all orders).

    ``masks``: part, mask, n, good, toxic, any number of rows for the same part and mask; bit i of the
    mask is filter ``letters[i]``. A step's filter is that letter of the order. Parts are one small row
    each before their steps are written out; an empty table has no parts and gives no rows.
    """
    k, full = len(letters), (1 << len(letters)) - 1
    steps = [("".join(o), i) for o in permutations(letters) for i in range(k)]
    bit = {x: 1 << i for i, x in enumerate(letters)}
    before = [sum(bit[x] for x in o[:i]) for o, i in steps]
    own = [letters.index(o[i]) for o, i in steps]
    table = coalition_removals(masks, k, ["n", "good", "toxic"])
    totals = F.array(*[sum((F.lit(w) * F.col("n_by")[s] for s, w in enumerate(row) if w), F.lit(0)) for row in shapley_weights(k)])
    per = table.withColumn("shapley_by", totals).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    pick = lambda values: F.array(*[F.lit(v) for v in values])[F.col("i")]
    per = per.select("*", pick([o for o, _ in steps]).alias("filter_order"), pick([i + 1 for _, i in steps]).alias("step"), pick(before).alias("b"), pick(own).alias("f"))
    per = per.withColumn("single", F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("f") + 1))
    after = F.col("b") + F.col("single")
    change = lambda name: F.col(name)[after] - F.col(name)[F.col("b")]
    removed = change("n_by")
    return per.select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("n_by")[after]).alias("kept"),
        removed.alias("removed"),
        (F.col("n_by")[F.col("single")] - removed).alias("redundant"),
        (F.col("n_by")[F.lit(full)] - F.col("n_by")[F.lit(full) - F.col("single")]).alias("unique_fails"),
        change("good_by").alias("good_lost"),
        change("toxic_by").alias("toxic_lost"),
        F.col("shapley_by")[F.col("f")].alias("shapley"),
    )


def text_failures(text: Column) -> Column:
    """Bits A to D of a text: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of documents: the filters failed and the labelled rows among them.

    Texts are read once and leave as a digest. Copies are found without gathering them: the smallest id
    of each digest comes from a partial aggregation, and the one row that holds it is met by an equi-join
    on digest and id. Rows that agree in all columns are counted before any shuffle. Null texts count as
    empty, null sources as ''. A null id is smaller than none and has no smaller one, so it never fails
    E. Labels with repeated ids count once, as good or toxic if any of them is; null labels are neither.
    """
    need(docs, "doc_id", "text", "source")
    need(labels, "doc_id", "quality", "toxic")
    text = text_of(docs)
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    cells = settle(slim.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = cells.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    named, unnamed = cells.where("doc_id is not null"), cells.where("doc_id is null")
    named = named.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    named = named.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda x: F.coalesce(F.max((F.col(x) == 1).cast("int")), F.lit(0))
    flags = labels.groupBy("doc_id").agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic")).where("is_good + is_toxic > 0")
    sizes = cells.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n").alias("rows"))
    rows = cells.agg(F.sum("n")).first()[0] or 0
    marked = attach_values(named, settle(flags.join(sizes, "doc_id")), "doc_id", "rows", rows, small=10_000)
    both = marked.select("part", "mask", "n", "is_good", "is_toxic").unionByName(unnamed.select("part", "mask", "n", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic")))
    share = lambda x: F.coalesce(F.sum(F.col("n") * F.col(x)), F.lit(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("is_good").alias("good"), share("is_toxic").alias("toxic"))


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op13."""
    return audit(document_masks(docs, labels))


#: DuckDB SQL for ``audited_documents``; Shapley values are summed over the 120 orders there
AUDIT_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders_of AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
  FROM letter p JOIN letter q ON q.b <> p.b JOIN letter r ON r.b NOT IN (p.b, q.b) JOIN letter s ON s.b NOT IN (p.b, q.b, r.b) JOIN letter u ON u.b NOT IN (p.b, q.b, r.b, s.b)),
steps AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS earlier FROM orders_of, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & (earlier | own) = 0) AS kept, sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0) AS toxic_lost
  FROM masks, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted"""
