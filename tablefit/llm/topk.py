"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Vectors are packed into blocks, each of which goes once to a lane of every group of queries (one
group as long as the queries fill QUERY_BYTES). A task holds its queries and what they found so
far, and takes one block after another. Inside a block every dimension has its list of components,
sorted. What a query can still find below a depth of its lists (from the good end: downwards where
its component is positive, upwards where it is negative) is at most the sum of its components times
the values there. A query whose kth score so far is above that at the top leaves the block at once,
one that it stops at a small depth walks its lists; the others would meet most of the block, so
their scores are one matrix product. Results of the lanes are merged by a ranked window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablefit.llm.common import need, settle, spread

BLOCK, QUERY_BLOCK, STEP = 8192, 512, 4
NUMBERS = 1 << 20  # of a block
SCORES = 1 << 20  # that are held at once
QUERY_BYTES = 8 << 20  # of packed queries that a task holds
LANE_BYTES = 64 << 20  # of packed vectors that go to a task
LOW = np.iinfo(np.int64).min
_PACKED = "dim int, ids binary, vecs binary"


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, vec array<long>): floor(scale * component). Left out: null ids, null or empty vectors,
    and vectors with a null or non-finite component. Equal rows count once."""
    need(df, key, vector)
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(F.size(x) > 0).where(~bad)
    return good.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("vec")).distinct()


def _pack(size: int):
    """Arrow batches of (vec_id, vec) to blocks of at most ``size`` vectors of one dimension and at most
    NUMBERS components (or one vector), in the narrowest whole numbers that hold them."""

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            dims = np.diff(np.asarray(lists.offsets))
            flat = lists.values.slice(lists.offsets[0].as_py()).to_numpy(zero_copy_only=False)
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            rows = []
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                most = max(1, min(size, NUMBERS // int(dim)))
                for part in np.array_split(mine, -(-len(mine) // most)):
                    vecs = flat[starts[part][:, None] + np.arange(dim)]
                    kind = next(t for t in (np.int16, np.int32, np.int64) if vecs.min() >= np.iinfo(t).min and vecs.max() <= np.iinfo(t).max)
                    rows.append((int(dim), ids[part].tobytes(), np.ascontiguousarray(vecs, kind).tobytes()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["dim", "ids", "vecs"])

    return pack


def _unpack(dim: int, ids: pa.Buffer, vecs: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vecs, f"i{vecs.size // (len(ids) * dim)}").reshape(-1, dim)


def threshold_search(ids: np.ndarray, vecs: np.ndarray, query: np.ndarray, own: int, k: int, order: np.ndarray | None = None, bar: int = LOW):
    """Top k (ids, scores) of one block for one query, by the threshold algorithm; exact, ties to smaller ids.

    ``order[:, d]`` sorts the block by component d. Depth grows in steps of STEP rows per list, then
    doubles, so a search that cannot stop early costs no more than a few scans. Scores below ``bar``
    are not looked for, though some may be returned.
    """
    n = len(ids)
    order = np.argsort(vecs, axis=0, kind="stable") if order is None else order
    dims = np.flatnonzero(query)
    q = query[dims]
    up = q < 0
    seen = np.zeros(n, bool)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, STEP
    if len(dims) == 0:  # every score is 0
        keep = np.sort(ids[ids != own])[:k]
        return keep, np.zeros(len(keep), np.int64)
    while at < n:
        to = min(n, at + step)
        down = order[n - to : n - at, dims[~up]]
        rise = order[at:to, dims[up]]
        met = np.unique(np.concatenate((down.ravel(), rise.ravel())))
        new = met[~seen[met]]
        seen[new] = True
        new = new[ids[new] != own]
        if len(new):
            all_ids = np.concatenate((best_ids, ids[new]))
            scores = np.concatenate((best, vecs[new] @ query))
            first = np.lexsort((all_ids, -scores))[:k]
            best_ids, best = all_ids[first], scores[first]
        last = np.where(up, order[to - 1, dims], order[n - to, dims])
        bound = int(vecs[last, dims] @ q)
        # an unseen vector with the kth score could still win by its id
        if bound < bar or len(best) == k and bound < best[-1]:
            break
        at, step = to, step * 2
    return best_ids, best


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > kth)
    return np.concatenate((above, np.flatnonzero(scores == kth)[: k - len(above)]))


class _Asked:
    """Queries of one dimension and the k best vectors that each has met."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
        self.own, self.q = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.queries = np.concatenate([p[2] for p in parts]).astype(np.int64)
        self.peak = int(max(abs(int(self.queries.min())), int(self.queries.max())))
        self.k, self.ids, self.scores = k, np.zeros((len(self.q), k), np.int64), np.full((len(self.q), k), LOW)

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Take a block into account."""
        by_id = np.argsort(ids, kind="stable")  # of equal scores the smaller ids come first
        ids, vecs = ids[by_id], vecs[by_id]
        n, dim = vecs.shape
        order = np.argsort(vecs.T, axis=1, kind="stable").T
        lists = np.take_along_axis(vecs, order, axis=0)
        peak = int(max(abs(int(vecs.min())), int(vecs.max())))
        # doubles add whole numbers exactly, and by far faster, up to 53 bits
        number = np.float64 if peak * self.peak * dim < 1 << 53 else np.int64
        vecs = vecs.astype(np.int64)
        depths, at, step = [], 0, STEP
        while at < n:
            at, step = min(n, at + step), step * 2
            depths.append(at)
        depths = np.array(depths)
        block = _Block(ids, vecs, order, vecs.T.astype(number), depths, lists[n - np.r_[1, depths]].T.astype(number), lists[np.r_[1, depths] - 1].T.astype(number))
        for at in range(0, len(self.q), max(1, SCORES // n)):
            self._meet(slice(at, at + max(1, SCORES // n)), block, number)

    def _meet(self, part: slice, block: _Block, number: type) -> None:
        queries, own, bar = self.queries[part].astype(number), self.own[part], self.scores[part, -1].copy()
        n = len(block.ids)
        at_most = np.maximum(queries, 0) @ block.high + np.minimum(queries, 0) @ block.low
        new = np.flatnonzero(bar == LOW)
        if len(new):  # the first rounds of queries that have not met k vectors, all together, give them a bar
            heads = np.unique(np.concatenate((block.order[:STEP], block.order[-STEP:])))
            scores = queries[new] @ block.columns[:, heads]
            scores[block.ids[heads] == own[new][:, None]] = LOW
            if len(heads) >= self.k:
                bar[new] = np.partition(scores, len(heads) - self.k, axis=1)[:, len(heads) - self.k].astype(np.int64)
        stops = at_most < bar[:, None]
        depth = np.where(stops[:, 1:].any(axis=1), block.depths[stops[:, 1:].argmax(axis=1)], n)
        # a walk looks at up to depth vectors of each list, one by one; a product looks at all, far faster
        walks = ~stops[:, 0] & (depth * len(block.columns) * 4 <= n)
        found = []
        for i in np.flatnonzero(walks):
            got, scores = threshold_search(block.ids, block.vecs, self.queries[part][i], int(own[i]), self.k, block.order, int(bar[i]))
            found.append((np.full(len(got), i), got, scores))
        rest = np.flatnonzero(~stops[:, 0] & ~walks)
        if len(rest):
            scores = queries[rest] @ block.columns
            hits = scores >= bar[rest][:, None]
            left, right = (np.searchsorted(block.ids, own[rest], side) for side in ("left", "right"))
            for i in np.flatnonzero(left < right):
                hits[i, left[i] : right[i]] = False
            many = hits.sum(axis=1) > 4 * self.k
            for i in np.flatnonzero(many):
                spots = np.flatnonzero(hits[i])
                spots = spots[_first(scores[i, spots], self.k)]
                found.append((np.full(len(spots), rest[i]), block.ids[spots], scores[i, spots].astype(np.int64)))
            hits[many] = False
            i, spots = np.nonzero(hits)
            found.append((rest[i], block.ids[spots], scores[i, spots].astype(np.int64)))
        if found:
            self._merge(part.start, *(np.concatenate(c) for c in zip(*found)))

    def _merge(self, start: int, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(i + start)
        i = np.concatenate((np.repeat(some, self.k), i + start))
        ids = np.concatenate((self.ids[some].ravel(), ids))
        scores = np.concatenate((self.scores[some].ravel(), scores))
        order = np.lexsort((ids, ~scores, i))
        i, ids, scores = i[order], ids[order], scores[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        kept = rank < self.k
        self.ids[i[kept], rank[kept]], self.scores[i[kept], rank[kept]] = ids[kept], scores[kept]

    def result(self) -> pa.RecordBatch:
        i, rank = np.nonzero(self.scores > LOW)
        cols = (self.own[i], self.q[i], self.ids[i, rank], self.scores[i, rank])
        return pa.record_batch([pa.array(x) for x in cols], ["query_id", "q", "vec_id", "score"])


class _Block(NamedTuple):
    ids: np.ndarray
    vecs: np.ndarray
    order: np.ndarray
    columns: np.ndarray
    depths: np.ndarray
    high: np.ndarray
    low: np.ndarray


def _search(k: int):
    """Rows of a partition, sorted by cell and, inside, with the queries (``qb`` not null) first."""

    def run(batches):
        cell, parts, asked = None, {}, {}
        for batch in batches:
            cells, dims, qbs, ids, vecs = batch.columns
            for j in range(batch.num_rows):
                if cells[j].as_py() != cell:
                    for x in asked.values():
                        yield x.result()
                    cell, parts, asked = cells[j].as_py(), {}, {}
                dim, qb = dims[j].as_py(), qbs[j].as_py()
                names, numbers = _unpack(dim, ids[j].as_buffer(), vecs[j].as_buffer())
                if qb is not None:  # copied, so that the batch can go
                    parts.setdefault(dim, []).append((names.copy(), qb * QUERY_BLOCK + np.arange(len(names)), numbers.copy()))
                    continue
                if dim in parts:
                    asked[dim] = _Asked(parts.pop(dim), k)
                if dim in asked:
                    asked[dim].meet(names, numbers)
        for x in asked.values():
            yield x.result()

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best vectors of ``df`` for each row of ``queries`` (both as ``scaled`` gives them).

    Returns query_id, rank (from 1), vec_id, score. A query never finds vectors of its own id, nor
    vectors of another length. If an id stands for several different query vectors, each is
    answered. No queries or no vectors give no rows. Components times components, summed over
    the dimensions, must fit 63 bits.
    """
    spark = df.sparkSession
    # stored, because a block must be the same whenever it is dealt out again
    blocks = settle(df.mapInArrow(_pack(BLOCK), _PACKED))
    asked = settle(queries.mapInArrow(_pack(QUERY_BLOCK), _PACKED).withColumn("qb", F.monotonically_increasing_id()))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("vecs")).alias("bytes")).first()
    held = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("vecs")).alias("bytes")).first()
    if size["n"] == 0 or held["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups, lanes = -(-size["bytes"] // QUERY_BYTES), max(min(spread(df), held["n"]), -(-held["bytes"] // LANE_BYTES))
    # row after row of each file goes to the next lane
    number = F.monotonically_increasing_id()
    lane = F.pmod(F.shiftright(number, 33) + number.bitwiseAND((1 << 33) - 1), F.lit(lanes))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumns({"lane": lane, "qg": every(groups), "qb": F.lit(None).cast("long")})
    right = asked.withColumn("qg", F.pmod(F.xxhash64("qb"), F.lit(groups))).withColumn("lane", every(lanes))
    rows = [t.select((F.col("qg") * lanes + F.col("lane")).cast("int").alias("cell"), "dim", "qb", "ids", "vecs") for t in (left, right)]
    dealt = rows[0].unionByName(rows[1]).repartitionById(groups * lanes, "cell").sortWithinPartitions("cell", F.col("qb").isNull())
    found = dealt.mapInArrow(_search(k), "query_id long, q long, vec_id long, score long")
    w = W.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embeddings_top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The contract of op1: rows whose vec_id is divisible by ``every`` against all other rows."""
    vectors = scaled(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * e::DOUBLE) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(q.vec)), lambda i: q.vec[i] * v.vec[i])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.vec) = len(q.vec) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
