"""Source divergence audit: how far the word use of each source is from the other sources of its language.

A translate-table tokenizer reads texts as bytes: one ``bytes.translate`` lowers A-Z and turns every
other ASCII character into a space, ``bytes.split`` cuts the terms, a Counter per document gives their
frequencies. Counters are merged by (lang, source) inside a task and leave it as sparse rows (lang,
source, term, occurrences, documents), which Spark adds up. Terms in too few documents of a language go;
what is left is smoothed to whole numbers per thousand million and compared exactly.

Two sources differ by the sum over all kept terms. Most counts are 0, so only the difference from what
two absent terms would give is summed, in blocks of terms and tiles of sources: one task holds at most
2 * TILE sources times about BLOCK terms, whatever the number of sources.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.llm.common import need, settle, text_of

ROOM = 200_000  # (source, term) entries that a task merges before it hands them on
TILE = 128      # sources
BLOCK = 2048    # terms
SCALE = 1_000_000_000

_OTHERS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters)
TABLE = bytes.maketrans(string.ascii_uppercase.encode() + _OTHERS, string.ascii_lowercase.encode() + b" " * len(_OTHERS))


def terms_of(text: bytes) -> Counter:
    """Frequencies of the terms of one document: runs of letters and non-ASCII characters, A-Z lowered."""
    return Counter(text.translate(TABLE).split())


def _sparse_counts(batches, room: int):
    """Rows (lang, source, term, n, docs) of the documents of a task, merged up to ``room`` entries."""
    found, entries = {}, 0

    def rows():
        keys, terms, n, docs = [], [], [], []
        for key, (total, seen) in found.items():
            keys += [key] * len(total)
            terms += total.keys()
            n += total.values()
            docs += [seen[t] for t in total]
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            terms = terms_of(text.as_py())
            total, seen = found.setdefault((lang, source), (Counter(), Counter()))
            size = len(total)
            total.update(terms)
            seen.update(terms.keys())
            entries += len(total) - size
            if entries > room:
                yield rows()
                entries = 0
    if found:
        yield rows()


def term_counts(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    slim = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_of(docs).cast("binary").alias("text"))
    parts = slim.mapInArrow(lambda batches: _sparse_counts(batches, room), "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact for any 64-bit counts."""
    big = lambda x: x.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * big(count + 5)
    return F.call_function("div", top, big(total + 5 * terms)) + 1


def _tile_differences(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Of one pair of tiles and one block of terms: for every two sources, the sum over the terms met of
    |p - q| less what two absent terms would give. Rows without a term only bring a source along."""
    ta, tb = int(pdf["ta"].iat[0]), int(pdf["tb"].iat[0])
    ids, at = np.unique(pdf["sid"].to_numpy(), return_inverse=True)
    base = np.zeros(len(ids), np.int64)
    base[at] = pdf["p0"].to_numpy()
    with_term = pdf["term"].notna().to_numpy()
    codes, terms = pd.factorize(pdf["term"][with_term])
    p = np.repeat(base[:, None], len(terms), axis=1)
    p[at[with_term], codes] = pdf["p"].to_numpy()[with_term]
    tile = ids // size
    columns = np.flatnonzero(tile == tb)
    a, b, value = [], [], []
    for i in np.flatnonzero(tile == ta):
        others = columns[columns > i] if ta == tb else columns
        a.append(np.full(len(others), ids[i]))
        b.append(ids[others])
        value.append(np.abs(p[i] - p[others]).sum(axis=1) - len(terms) * np.abs(base[i] - base[others]))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    out = pd.DataFrame({"a": flat(a), "b": flat(b), "value": flat(value)}, dtype="int64")
    out.insert(0, "lang", pdf["lang"].iat[0])
    return out


def pair_differences(groups: DataFrame, shares: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language, by number.

    ``groups``: lang, source, sid (from 0 in each language), p0 (share of an absent term), terms. ``shares``:
    lang, sid, term, p. A source meets every other source of its language once in the result, so rows
    are sent once to each tile of sources, never once to each source.
    """
    tiles = groups.groupBy("lang").agg((F.max("sid") / F.lit(tile)).cast("int").alias("last"))
    sized = groups.join(tiles, "lang").withColumn("blocks", (1 + F.floor(F.col("terms") / block)).cast("int"))
    own = sized.select("lang", "sid", "p0", "last", "blocks")
    bring = own.select("lang", "sid", "p0", "last", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("p"))
    spot = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = shares.join(own, ["lang", "sid"]).select("lang", "sid", "p0", "last", spot.alias("block"), "term", "p")
    rows = bring.unionByName(placed).withColumn("tile", (F.col("sid") / F.lit(tile)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    parts = rows.select("lang", "ta", "tb", "block", "sid", "p0", "term", "p").groupBy("lang", "ta", "tb", "block").applyInPandas(lambda pdf: _tile_differences(pdf, tile), "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, room: int = ROOM, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (text, lang, source).

    Part ``pair``: the other sources of the language by the summed difference of all kept terms' shares
    (0 without kept terms), all of them. Part ``term``: the ``top`` terms that the source uses more than
    its language. Ranks start at 1, ties go to the smaller UTF-8 item. Null text, lang and source count
    as ''. A language with one source has no pairs; repeated rows count as documents of their own; an
    empty table gives no rows. Other columns are not read. ``room``, ``tile`` and ``block`` bound the
    memory of a task and change no result.
    """
    need(docs, "text", "lang", "source")
    counts = settle(term_counts(docs, room))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = settle(kept.select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    own = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    groups = groups.withColumns({
        "sid": F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1,  # one row per source
        "p0": F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0).cast("long")),
    })
    groups = settle(groups)
    shares = settle(own.join(groups, ["lang", "source"]).select(
        "lang", "source", "sid", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")))
    half = settle(pair_differences(groups, shares, tile, block))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = groups.select("lang", F.col("sid").alias("a"), "source", F.col("p0").alias("pa"), "terms")
    two = groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb"))
    pairs = both.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("terms") * F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def audited_sources(docs: DataFrame) -> DataFrame:
    """The contract of op11."""
    return audit(docs)


#: DuckDB SQL for ``audited_sources``: dense shares of every group and kept term
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v.v)::HUGEINT)::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (kept.lang_n + 5) // (v.lang_total + 5 * v.v)::HUGEINT)::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
listed AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
