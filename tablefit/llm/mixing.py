"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / size of the source.
The prefix sum of these along the source plus one random offset crosses integers; a document is
taken once per integer crossed while its own share is added. Documents are ordered by size, so
each size class is taken in proportion and the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablefit.llm.common import WORD, need, settle, text_of

CELL_ROWS = 200_000
SEED = "mix"


def md5_unit(text: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of an md5; any engine gives the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: size, weight and target.

    Sources in code-point order, null last, take the weights in turn and share the total size.
    A target stops at ``most`` times its size, and what is over goes to the others by weight until
    none is above. In order of most * size / weight the stopped sources come first, so one running
    total decides which they are. One row per source is sorted, not one per document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    per = per.select("source", "source_size", F.array(*[F.lit(w) for w in weights])[turn % len(weights)].cast("long").alias("weight"))
    cap = F.lit(most).cast("long") * F.col("source_size")
    everyone = W.partitionBy(F.lit(0))
    line = everyone.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    ranked = per.withColumns({
        "cap": cap,
        "total": F.sum("source_size").over(everyone),
        "cap_before": F.coalesce(F.sum(cap).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(line.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("cap_before")).cast("double") / F.col("weight_left")
    stopped = F.col("cap").cast("double") < level * F.col("weight")
    # the level of the first source that is not stopped holds for all after it
    ranked = ranked.withColumn("level", F.when(~stopped, level))
    ranked = ranked.withColumn("level", F.min(F.struct(F.col("level").isNull().alias("no"), F.col("cap_before").alias("at"), F.col("level").alias("x"))).over(everyone)["x"])
    target = F.when(stopped, F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_copies(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Add source_size, target and ``copies`` to rows with doc_id, source, size.

    Any source may hold most rows: it is numbered in cells (size class, hash of the id), and only
    cell totals of a source are ever sorted together. Repeated rows count as rows of their own.
    """
    cells = max(1, sized.count() // CELL_ROWS)
    id_hash = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    work = sized.withColumns({
        "__class": F.length(F.bin("size")),
        "__hash": id_hash,
        "__no_source": F.col("source").isNull(),
        "__source": F.coalesce("source", F.lit("")),
    })
    work = work.withColumn("__cell", (F.conv(F.substring("__hash", 1, 7), 16, 10).cast("long") % cells).cast("int"))
    keys = ["__no_source", "__source", "__class", "__cell"]
    sums = settle(work.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    before = W.partitionBy("__no_source", "__source").orderBy("__class", "__cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    goals = targets.select(
        F.col("source").isNull().alias("__no_source"),
        F.coalesce("source", F.lit("")).alias("__source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
        md5_unit(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("\x00")))).alias("__offset"),
    )
    starts = starts.join(goals, ["__no_source", "__source"])
    inside = W.partitionBy(*keys).orderBy("size", "__hash")
    local = work.withColumn("__i", F.row_number().over(inside))
    at = (F.col("__start") + F.col("__i")).cast("double")
    copies = F.floor(F.col("__rate") * at + F.col("__offset")) - F.floor(F.col("__rate") * (at - 1.0) + F.col("__offset"))
    out = local.join(starts, keys).withColumn("copies", copies.cast("long"))
    return out.drop("__class", "__hash", "__i", "__start", "__rate", "__offset", *keys)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    A null text has no words; a null source is a source of its own, the last. A source without
    words has target 0 and nothing is taken from it. An empty table gives no rows.
    """
    need(docs, "doc_id", "text", "source")
    # the words are counted once; later passes read three short columns
    sized = settle(docs.select("doc_id", "source", word_count(text_of(docs)).alias("size")))
    done = mix_copies(sized, settle(source_targets(sized, weights, most)))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it is taken.

    Copies are found on slim rows and joined back by id and text, so repeated ids are safe: equal
    rows are taken as a group whose copies are dealt to its rows in turn.
    """
    need(docs, "doc_id", "text", "source")
    from tablefit.llm.common import text_key

    a, b = text_key(text_of(docs))
    keyed = docs.withColumns({"__a": a, "__b": b, "__s": F.coalesce("source", F.lit("\x00"))})
    sized = settle(keyed.select("doc_id", "source", word_count(text_of(docs)).alias("size"), "__a", "__b", "__s"))
    taken = mix_copies(sized, settle(source_targets(sized, weights, most)))
    same = taken.groupBy("doc_id", "__a", "__b", "__s").agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    same = same.withColumnsRenamed({"doc_id": "__id", "__a": "__a2", "__b": "__b2", "__s": "__s2"})
    on = keyed["doc_id"].eqNullSafe(same["__id"]) & (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2")) & (F.col("__s") == F.col("__s2"))
    joined = keyed.join(same.where("__sum > 0"), on)
    # a group of equal rows (nearly always one row) is emitted by its rows together
    once = joined.where("__rows = 1").withColumn("__times", F.col("__sum").cast("int"))
    many = joined.where("__rows > 1").dropDuplicates(["__id", "__a", "__b", "__s"]).withColumn("__times", F.col("__sum").cast("int"))
    out = once.unionByName(many).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for ``mixed_documents`` over a relation of documents (default weights)
def mixed_sql(documents: str = "documents", seed: str = SEED) -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {documents}),
cells AS (SELECT CAST(greatest(1, count(*) // {CELL_ROWS}) AS BIGINT) AS cells FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turned AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM per),
ranked AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    sum(weight) OVER (line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left
  FROM turned WINDOW line AS (ORDER BY 3 * source_size / weight, source IS NULL, source)),
levels AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) / weight_left AS own,
    cap::DOUBLE < CAST(total - cap_before AS DOUBLE) / weight_left * weight AS stopped FROM ranked),
goals AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE
      least(cap::DOUBLE, (SELECT arg_min(own, cap_before) FROM levels WHERE NOT stopped) * weight) END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('{seed}:' || coalesce(s.source, chr(0))), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 AS u,
    row_number() OVER (PARTITION BY s.source ORDER BY length(bin(s.size)),
      CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) % (SELECT cells FROM cells),
      s.size, md5('{seed}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')))::DOUBLE AS i
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * i + u) - floor(rate * (i - 1.0) + u) AS BIGINT) * size AS taken
FROM placed"""
