"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word five-grams. Rows of equal MinHash bands are candidates, gathered into
groups (components). Inside a group MinHash values are compared a few at a time; a pair is dropped
as soon as the posterior probability that its similarity reaches the threshold is below the
tolerance, and what is left is verified exactly on the sets. No list of pairs is ever written: a
group is cut into blocks, each pair of blocks is one unit of work, and only link counts and a
spanning forest of the links leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import need, settle, spread, text_key, text_of
from tablefit.llm.components import components
from tablefit.llm.flat import RangeHash, mix, parts, segment_ids, shingles, word_ranges

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 meets in no band with probability 3e-6
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-7
BLOCK_DOCS, BLOCK_BYTES = 256, 8 << 20
BIN_BYTES = 16 << 20
HAS_WORD = r"[^\x20\x09-\x0D]"  # a byte that word_ranges takes for a part of a word


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted inside the row, and the number before each row."""
    lo, hi, counts = word_ranges(data, offsets)
    grams, before = shingles(RangeHash(data)(lo, hi), counts, width)
    row = segment_ids(before)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[keep], row[keep]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


def _set_names(grams: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums of mixed members, mixed with the size."""
    sums = []
    for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams + salt))))
        sums.append(mix((upto[before[1:]] - upto[before[:-1]]) + np.diff(before).astype(np.uint64) * salt).view(np.int64))
    return sums[0], sums[1]


def minhashes(grams: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of each non-empty set; rows of empty sets hold zeros."""
    out = np.zeros((len(before) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(before))
    if len(full):
        starts = before[:-1][full]
        for j, a in enumerate(_seeds(n)):
            out[full, j] = np.minimum.reduceat((grams * a) >> np.uint64(32), starts).astype(np.uint32)
    return out


def _sketch(width: int, bands: int, rows: int):
    """(…, __text) to (…, k1, k2, size, bands): the set's name, its size and its band hashes."""

    def run(batches):
        seeds = _seeds(bands * rows)
        for batch in batches:
            for rest, data, offsets in parts(batch):
                grams, before = _sets(data, offsets, width)
                sig = minhashes(grams, before, bands * rows).astype(np.uint64)
                folded = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    folded = mix(folded + sig[:, r::rows] * seeds[r])
                folded = mix(folded + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * bands, pa.int32()), pa.array(folded.view(np.int64).ravel()))
                cols = [pa.array(c) for c in (*_set_names(grams, before), np.diff(before))]
                yield pa.RecordBatch.from_arrays([*rest.columns, *cols, lists], names=[*rest.schema.names, "k1", "k2", "size", "bands"])

    return run


def _signed_sets(width: int, n: int):
    """(…, __text) to (…, sig, grams): MinHash values and the whole set, as bytes."""

    def run(batches):
        for batch in batches:
            for rest, data, offsets in parts(batch):
                grams, before = _sets(data, offsets, width)
                sigs = [s.tobytes() for s in minhashes(grams, before, n)]
                sets = [grams[a:b].tobytes() for a, b in zip(before[:-1], before[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=[*rest.schema.names, "sig", "grams"]
                )

    return run


def keep_from(threshold: float, n: int, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, fewest matches to stay) after each step.

    With a uniform prior, the similarity given m matches of n has the density of Beta(m + 1,
    n - m + 1); its tail above the threshold equals a binomial sum, so the bound is exact.
    """
    out = []
    for at in range(step, n + 1, step):
        # P(Beta(m+1, at-m+1) > t) = P(Binomial(at+1, t) <= m)
        mass = [math.comb(at + 1, i) * threshold**i * (1 - threshold) ** (at + 1 - i) for i in range(at + 2)]
        total, m = 0.0, 0
        for m in range(at + 1):
            total += mass[m]
            if total >= tolerance:
                break
        out.append((at, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks that no step drops; within one block, i < j only."""
    if same:
        i, j = np.triu_indices(len(a), 1)
    else:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    hits = np.zeros(len(i), np.int32)
    since = 0
    for at, least in bounds:
        hits += (a[i, since:at] == b[j, since:at]).sum(axis=1, dtype=np.int32)
        on = hits >= least
        i, j, hits, since = i[on], j[on], hits[on], at
        if len(i) == 0:
            break
    return i, j


def verified(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have an exact Jaccard similarity of at least ``threshold``."""
    if len(i) == 0:
        return np.zeros(0, bool)
    part_a, part_b = np.unique(i), np.unique(j)
    everything, back = np.unique(np.concatenate([sets_a[x] for x in part_a] + [sets_b[x] for x in part_b]), return_inverse=True)
    na, nb = [len(sets_a[x]) for x in part_a], [len(sets_b[x]) for x in part_b]
    cuts = np.concatenate(([0], np.cumsum(na + nb)))
    local_b = {x: back[cuts[len(na) + y] : cuts[len(na) + y + 1]] for y, x in enumerate(part_b)}
    hit = np.zeros(len(everything), bool)
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    bounds = np.searchsorted(i[order], part_a)
    ends = np.append(bounds[1:], len(i))
    for y, (lo, hi) in enumerate(zip(bounds, ends)):
        own = back[cuts[y] : cuts[y + 1]]
        hit[own] = True
        rows = order[lo:hi]
        lists = [local_b[x] for x in j[rows]]
        sizes = np.array([len(x) for x in lists])
        both = np.add.reduceat(hit[np.concatenate(lists)], np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
        hit[own] = False
        # both / union >= threshold, in a form that whole ratios meet exactly
        out[rows] = both >= threshold * (len(own) + sizes - both) - 1e-9
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    kept = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


_LINKS = "kind int, u long, v long"


def _compare(n: int, threshold: float, tolerance: float):
    """Sorted rows (bin, root, bi, bj, side, node, copies, sig, grams) to links: kind 0 are edges of a
    spanning forest, kind 1 are (node, copies of its partners)."""
    bounds = keep_from(threshold, n, tolerance)

    def unit(rows, same):
        edges, counts = [], {}
        sides = [{r[0]: r for r in rows if r[4] == 0}, {r[0]: r for r in rows if r[4] == (0 if same else 1)}]
        nodes = [np.array(list(s), np.int64) for s in sides]
        sigs = [np.stack([np.frombuffer(r[2], np.uint32) for r in s.values()]) if s else np.zeros((0, n), np.uint32) for s in sides]
        sets = [[np.frombuffer(r[3], np.uint64) for r in s.values()] for s in sides]
        copies = [np.array([r[1] for r in s.values()], np.int64) for s in sides]
        i, j = surviving(sigs[0], sigs[1], bounds, same)
        on = verified(sets[0], sets[1], i, j, threshold)
        i, j = i[on], j[on]
        edges = _forest(nodes[0][i], nodes[1][j])
        for mine, other, at, to in ((0, 1, i, j), (1, 0, j, i)):
            total = np.bincount(at, weights=copies[other][to], minlength=len(nodes[mine])).astype(np.int64)
            for x, t in zip(nodes[mine].tolist(), total.tolist()):
                if t:
                    counts[x] = counts.get(x, 0) + t
        return edges, counts

    def flush(key, rows):
        edges, counts = unit(rows, key[1] == key[2])
        return (
            [0] * len(edges) + [1] * len(counts),
            [e[0] for e in edges] + list(counts),
            [e[1] for e in edges] + list(counts.values()),
        )

    def run(batches):
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c) for c in range(batch.num_columns)]
            roots, bis, bjs, sides, nodes, copies = (c.to_numpy(zero_copy_only=False).tolist() for c in cols[:6])
            out = ([], [], [])
            for x in range(batch.num_rows):
                now = (roots[x], bis[x], bjs[x])
                if now != key and rows:
                    for o, p in zip(out, flush(key, rows)):
                        o.extend(p)
                    rows = []
                key = now
                rows.append((nodes[x], copies[x], cols[6][x].as_py(), cols[7][x].as_py(), sides[x]))
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["kind", "u", "v"])
        if rows:
            out = flush(key, rows)
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["kind", "u", "v"])

    return run


def similarity_classes(
    docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE
) -> DataFrame:
    """doc_id, __a, __b (the text's name), class_id, n_links and __root for every row of ``docs`` (doc_id, text).

    A link joins two rows whose shingle sets have a Jaccard similarity of at least ``threshold``;
    classes are the connected components, named by their smallest doc_id (null ids only: null). Classes
    that share their smallest doc_id share that name; __root tells them apart (null: no words).
    n_links counts the other rows a row links to, copies included. A text of one to ``width`` - 1 words has
    one shingle of all its words. Null texts and texts without words have no shingles: they
    link to nothing and are classes of their own. Repeated rows are copies of each other.
    """
    need(docs, "doc_id", "text")
    text = text_of(docs)
    a, b = text_key(text)
    slim = docs.select("doc_id", a.alias("__a"), b.alias("__b"), text.alias("__text"))
    place = F.struct(F.coalesce("doc_id", F.lit(0)).alias("__i"), "__a", "__b")
    kept = "doc_id long, __a long, __b long, "
    sketched = settle(slim.mapInArrow(_sketch(width, bands, rows), kept + "k1 long, k2 long, size long, bands array<long>"))
    some = sketched.where("size > 0")
    # one node for each distinct set, with the place of one text that has it
    nodes = some.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min(place).alias("at"), F.max("size").alias("size"),
        F.first("bands").alias("bands"),
    )
    nodes = settle(nodes.withColumn("node", F.xxhash64("k1", "k2")))
    # members of a band bucket are tied to its smallest node; one partial sum per bucket, no bucket is gathered
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "v")
    ties = keyed.join(heads, "band").where("node <> v").select(F.col("node").alias("u"), "v")
    groups = settle(components(ties))
    members = groups.join(nodes.select("node", "copies", "size", "at"), "node")
    weight = F.col("size") * 8 + bands * rows * 4
    totals = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")
    ).withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    totals = settle(totals)
    whole = totals.agg(F.sum("bytes")).first()[0] or 0
    bins = max(spread(docs), int(whole // BIN_BYTES))
    placed = settle(members.join(totals, "root").select("root", "node", "copies", "blocks", "at.__i", "at.__a", "at.__b"))
    # the sets of grouped texts only, from one row for each set
    texts = slim.withColumn("__i", F.coalesce("doc_id", F.lit(0))).join(placed.hint("merge"), ["__i", "__a", "__b"]).select("root", "node", "copies", "blocks", "__text")
    full = texts.mapInArrow(_signed_sets(width, bands * rows), "root long, node long, copies long, blocks int, sig binary, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, own).alias("bi"), F.greatest(o, own).alias("bj"), F.when(own <= o, 0).otherwise(1).alias("side")),
    )
    units = full.withColumn("c", F.explode(cells)).select("root", "c.bi", "c.bj", "c.side", "node", "copies", "sig", "grams", "blocks")
    # small groups share bins, the block pairs of a large one are dealt out
    bin_ = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.pmod(F.xxhash64("root", "bi", "bj"), F.lit(bins)))
    dealt = units.withColumn("bin", bin_).repartition(bins, "bin").sortWithinPartitions("root", "bi", "bj", "side", "node").drop("bin", "blocks")
    links = settle(dealt.mapInArrow(_compare(bands * rows, threshold, tolerance), _LINKS))
    classes = components(links.where("kind = 0").select("u", "v"))
    counts = links.where("kind = 1").groupBy("u").agg(F.sum("v").alias("links")).withColumnRenamed("u", "node")
    named = nodes.select("node", "k1", "k2", "copies", "low").join(classes, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("class_id"))
    known = named.join(lows, "root").select("k1", "k2", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketched.drop("bands").join(known, ["k1", "k2"], "left")
    empty = F.col("size") == 0
    return out.select(
        "doc_id", "__a", "__b",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(~empty, F.col("root")).alias("__root"),
    )


def joined_documents(docs: DataFrame) -> DataFrame:
    """The contract of op10: doc_id, class_id and n_links for every document."""
    return similarity_classes(docs).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each class the row with the smallest id (ties: by
    text, then one of equal rows) stays. All columns are kept; every row without words stays."""
    found = similarity_classes(docs)
    # the smallest id of a class is its name; the root keeps classes of one name apart
    best = found.where(F.col("__root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    best = best.groupBy("__root", "doc_id").agg(F.min(F.struct("__a", "__b")).alias("at"))
    best = best.select(F.col("doc_id").alias("__id"), F.col("at.__a").alias("__a2"), F.col("at.__b").alias("__b2"))
    text = text_of(docs)
    a, b = text_key(text)
    words = text.rlike(HAS_WORD)
    marked = docs.where(words).withColumns({"__a": a, "__b": b})
    kept = marked.join(best, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2")), "left_semi")
    return _first_of_equal(kept, docs.columns).unionByName(docs.where(~words))


def _first_of_equal(df: DataFrame, columns: list[str]) -> DataFrame:
    """One of the rows with equal id and text: the first by a hash of the other columns."""
    rest = [c for c in columns if c not in ("doc_id", "text")]
    if not rest:
        return df.dropDuplicates(["doc_id", "__a", "__b"]).select(*[F.col(f"`{c}`") for c in columns])
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    # by the row's JSON, because maps and the like have no order of their own
    low = df.groupBy("doc_id", "__a", "__b").agg(F.first("text").alias("text"), F.min_by(row, F.md5(F.to_json(row))).alias("r"))
    return low.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"r.`{c}`").alias(c) for c in columns])
