"""Removal of byte strings that repeat across or inside documents, by distributed prefix doubling.

A position of the suffix array is ranked by a prefix of growing length; positions whose rank is
unique drop out of each round, the rest is ranked again by the pair (rank, rank of what follows),
until the prefix has the threshold's length. Ranks are 64-bit names of the prefix, so equal
prefixes get equal ranks without a global sort.

Ranking every position would shuffle the corpus many times over, so positions are winnowed first,
without loss: of the prefixes of half the threshold that start in a window, only the one with the least rank
stands for it. Two equal strings of the threshold's length have the same standing prefix
at the same place, so a string repeats only if its standing position does. Then

1. standing positions are ranked by half the threshold, and those with a unique rank drop out;
2. the rest is ranked by the pair (rank, name of the whole context); positions of equal pairs are
   one class, and a class of two or more repeats over its whole context;
3. where one rank covers several classes, the strings of one member of each are ranked at every
   offset by the pair of names of their halves, and those that are unique drop out.

Step 3 is done for a rank inside one task when it covers at most LOCAL classes, and by a further
shuffle of (offset, rank) pairs when it covers more; both give the same spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.llm.common import fields, need, settle, text_key, text_of
from tablefit.llm.flat import RangeHash, mix, pair, parts

LENGTH = 400
HOT, SALTS = 1000, 64
LOCAL = 10_000  # at 201 strings a class and 24 bytes a string at most, about 50 MB in a task


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def standing(ranks: np.ndarray, w: int) -> np.ndarray:
    """Positions that stand for at least one window of w ranks: the first of its least ones."""
    low = _sliding_min(ranks, w)
    at = np.flatnonzero(ranks == _held(low, len(ranks), w))
    nxt = np.searchsorted(at, np.arange(len(low)))
    # the first position not before the window's start that has the window's least rank
    first = at[np.minimum(nxt, len(at) - 1)]
    wrong = ranks[first] != low
    while wrong.any():
        bad = np.flatnonzero(wrong)
        nxt[bad] += 1
        first[bad] = at[nxt[bad]]
        wrong[bad] = ranks[first[bad]] != low[bad]
    return np.unique(first)


def _held(low: np.ndarray, n: int, w: int) -> np.ndarray:
    """For each position the largest window minimum among the windows that hold it."""
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    span = 1
    while span * 2 <= w:
        padded = np.maximum(padded[:-span], padded[span:])
        span *= 2
    rest = w - span
    out = np.maximum(padded[: len(padded) - rest], padded[rest:]) if rest else padded
    return out[:n]


def _positions(length: int):
    """(…, __text) to one row per standing position: rank k, class c, position and context sizes."""
    half = length // 2
    w = length - half + 1

    def run(batches):
        for batch in batches:
            for rest, data, offsets in parts(batch):
                rows, ks, cs, at, before, after = [], [], [], [], [], []
                if not len(data):
                    continue
                named = RangeHash(data)
                ranks = named.fixed(half)
                for i in np.flatnonzero(np.diff(offsets) >= length):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    pos = standing(ranks[lo : hi - half + 1], w) + lo
                    left = np.minimum(pos - lo, w - 1)
                    right = np.minimum(hi - pos, length)
                    rows.append(np.full(len(pos), i))
                    ks.append(ranks[pos])
                    sizes = (left * (length + 1) + right).astype(np.uint64)
                    cs.append(pair(pair(ranks[pos], named(pos - left, pos + right)), sizes))
                    at.append(pos - lo)
                    before.append(left)
                    after.append(right)
                if not rows:
                    continue
                take = pa.array(np.concatenate(rows))
                out = [rest.column(rest.schema.get_field_index(c)).take(take) for c in ("__i", "__a", "__b")]
                out += [pa.array(np.concatenate(x).view(np.int64)) for x in (ks, cs)]
                out += [pa.array(np.concatenate(x).astype(np.int64)) for x in (at, before, after)]
                yield pa.RecordBatch.from_arrays(out, names=["__i", "__a", "__b", "k", "c", "at", "before", "after"])

    return run


def _window_names(context: bytes, before: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets d and ranks of the strings that start d bytes before the standing position, ranked by
    the pair of the ranks of their halves."""
    half = (length + 1) // 2  # the halves of an odd length overlap
    halves = RangeHash(np.frombuffer(context, np.uint8)).fixed(half)
    n = len(context) - length + 1
    ranks = pair(halves[:n], halves[length - half : length - half + n])
    return before - np.arange(n), ranks


def _runs(offsets: np.ndarray, length: int) -> list[dict]:
    """Offsets d of repeated strings to covered byte ranges relative to the standing position."""
    d = np.unique(offsets)
    if not len(d):
        return []
    new = np.flatnonzero(np.diff(d) > 1) + 1
    return [{"lo": int(-part[-1]), "hi": int(length - part[0])} for part in np.split(d, new)]


_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _refine(length: int):
    """Rows (k, c, n, before, context), sorted by (k, c), to (k, c, spans) of what repeats."""

    def finish(k, rows, out):
        # one number for each string; a class has each offset once, so equal numbers come from different classes
        sizes = [len(context) - length + 1 for _, _, _, context in rows]
        ends = np.cumsum([0, *sizes])
        keys = np.empty(ends[-1], np.uint64)
        for x, (c, n, before, context) in enumerate(rows):
            d, r = _window_names(context, before, length)
            keys[ends[x] : ends[x + 1]] = mix(r + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = [keys[ends[x] : ends[x + 1]] for x, row in enumerate(rows) if row[1] > 1]
        order = np.sort(keys)
        twice = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], *whole]))
        del order, whole
        for x, (c, n, before, context) in enumerate(rows):
            own = keys[ends[x] : ends[x + 1]]
            at = np.searchsorted(twice, own)
            on = at < len(twice)
            on[on] = twice[at[on]] == own[on]
            out[0].append(k)
            out[1].append(c)
            out[2].append(_runs(before - np.flatnonzero(on), length))

    def emit(out):
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _ARROW_SPANS)], ["k", "c", "spans"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = ([], [], [])
            ks, cs, ns, befores = (batch.column(i).to_pylist() for i in range(4))
            contexts = batch.column(4)
            for x in range(batch.num_rows):
                if ks[x] != key and rows:
                    finish(key, rows, out)
                    rows = []
                key = ks[x]
                if not rows or rows[-1][0] != cs[x]:  # a class once, if equal rows brought it twice
                    rows.append((cs[x], ns[x], befores[x], contexts[x].as_py()))
            yield emit(out)
        if rows:
            out = ([], [], [])
            finish(key, rows, out)
            yield emit(out)

    return run


def _explode(length: int):
    """Rows (k, c, n, before, context) to (k, c, n, d, r): one row per string."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                k, c, n, before, context = (batch.column(j)[i].as_py() for j in range(5))
                d, r = _window_names(context, before, length)
                m = len(d)
                yield pa.record_batch(
                    [pa.array(np.full(m, k)), pa.array(np.full(m, c)), pa.array(np.full(m, n)), pa.array(d.astype(np.int64)), pa.array(r.view(np.int64))],
                    ["k", "c", "n", "d", "r"],
                )

    return run


def _collapse(length: int):
    def run(batches):
        for batch in batches:
            spans = [_runs(np.array(d, np.int64), length) for d in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, _ARROW_SPANS)], ["k", "c", "spans"])

    return run


def _even_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with a settled ``table`` of one row per key and the key's number of rows.

    Keys with more than 1/HOT of all these rows (so fewer than HOT of them, which are broadcast) are dealt
    over SALTS partitions by the columns ``by``; the rows are read once."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > total // HOT).select(*on).withColumn("__hot", F.lit(True))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    salts = F.when(F.col(count) > total // HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(table.withColumn("__salt", F.explode(salts)), [*on, "__salt"]).drop("__salt")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, local: int = LOCAL) -> DataFrame:
    """(__a, __b, spans): for every text, named by ``text_key``, the unmerged byte ranges that are covered by a repeated
    string of ``length`` bytes. Texts without one have no row."""
    if length < 2:
        raise ValueError("length must be at least 2")
    whole = text_of(docs, text)
    a, b = text_key(whole)
    ids = F.xxhash64("doc_id") if "doc_id" in docs.columns else F.lit(0)
    slim = docs.select(ids.cast("long").alias("__i"), a.alias("__a"), b.alias("__b"), whole.alias("__text")).where(F.octet_length("__text") >= length)
    cols = "__i long, __a long, __b long, k long, c long, at long, before long, after long"
    positions = slim.mapInArrow(_positions(length), cols)
    # round 1: unique ranks drop out; counts are summed before the shuffle, no rank is gathered
    often = settle(positions.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = settle(_even_join(positions, often, ["k"], "n", ["__i", "__a", "at"]).drop("n"))
    # round 2: pairs (rank, context) are the classes
    classes = kept.groupBy("k", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("__i", "__a", "__b", "at")).alias("m"), F.first("before").alias("before"), F.first("after").alias("after")
    )
    classes = settle(classes)
    classes = settle(classes.join(classes.groupBy("k").agg(F.count(F.lit(1)).alias("width")), "k"))
    full = F.array(F.struct((-F.col("before")).alias("lo"), F.col("after").alias("hi")))
    done = classes.where("n > 1").select("k", "c", full.alias("spans"))
    # round 3: ranks with several classes, one member of each; its context is cut out of the text
    open_ = classes.where("width > 1").select("k", "c", "n", "before", "after", "width", "m.*")
    context = F.substring(F.col("__text").cast("binary"), (F.col("at") - F.col("before") + 1).cast("int"), (F.col("before") + F.col("after")).cast("int"))
    cut = slim.join(open_, ["__i", "__a", "__b"]).select("k", "c", "n", "before", context.alias("context"), "width")
    cut = settle(cut)
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("c", T.LongType()), T.StructField("spans", _SPANS)])
    small = cut.where(F.col("width") <= local).drop("width")
    near = small.repartition("k").sortWithinPartitions("k", "c").mapInArrow(_refine(length), kind)
    large = cut.where(F.col("width") > local).drop("width").dropDuplicates(["k", "c"])
    strings = large.mapInArrow(_explode(length), "k long, c long, n long, d long, r long")
    twice = strings.groupBy("d", "r").agg(F.sum("n").alias("m")).where("m > 1").select("d", "r")
    offsets = strings.join(twice, ["d", "r"]).groupBy("k", "c").agg(F.collect_list("d").alias("ds"))  # at most length offsets
    far = offsets.mapInArrow(_collapse(length), kind)
    # a class with two members repeats over its whole context already
    rest = near.unionByName(far).join(done.select("k", "c"), ["k", "c"], "left_anti")
    spans = done.unionByName(rest.where(F.size("spans") > 0))
    sized = settle(spans.join(classes.select("k", "c", "n"), ["k", "c"]))
    placed = _even_join(kept.select("__a", "__b", "at", "k", "c").distinct(), sized, ["k", "c"], "n", ["__a", "at"])
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("at")).alias("lo"), (s["hi"] + F.col("at")).alias("hi")))
    return placed.select("__a", "__b", moved.alias("s")).groupBy("__a", "__b").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept)


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs narrowed to the characters that they cover whole."""
    out = []
    for lo, hi in runs:
        while lo < hi and (text[lo] & 0xC0) == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and (text[hi] & 0xC0) == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _finish(digest: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["__kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.string()]

    def run(batches):
        for batch in batches:
            for part, data, offsets in parts(batch):
                rows = []
                for a, b, s in zip(offsets[:-1], offsets[1:], part.column(part.schema.get_field_index("__spans"))):
                    raw = data[a:b].tobytes()
                    runs = _merged(s.as_py())
                    if digest:
                        rows.append((len(raw), sum(hi - lo for lo, hi in runs), len(runs), hashlib.sha256(cut_out(raw, runs)).hexdigest()))
                    else:
                        rows.append((cut_out(raw, whole_characters(raw, runs)).decode("utf-8", "replace"),))
                rest = part.drop_columns(["__spans"])
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*rest.columns, *cols], names=[*rest.schema.names, *names])

    return run


def _joined(docs: DataFrame, keep: list[str], length: int, local: int) -> DataFrame:
    a, b = text_key(text_of(docs))
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(docs).alias("__text"), a.alias("__a"), b.alias("__b"))
    spans = settle(repeated_spans(docs, "text", length, local)).withColumnRenamed("spans", "__spans")
    return slim.join(spans, ["__a", "__b"], "left").drop("__a", "__b")


def deduplicated_documents(docs: DataFrame, length: int = LENGTH, local: int = LOCAL) -> DataFrame:
    """The contract of op5: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A null text counts as empty. Texts shorter than ``length`` bytes lose nothing. Repeated rows and equal
    texts are repeats like any other: each loses all it shares.
    """
    need(docs, "doc_id", "text")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _joined(docs, ["doc_id"], length, local).mapInArrow(_finish(True), out)


def without_repeats(docs: DataFrame, length: int = LENGTH, local: int = LOCAL) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (and ``n_chars`` brought up to date, if there).

    Only whole characters are cut: a run that starts or ends inside one is narrowed. A null text stays null.
    """
    need(docs, "doc_id", "text")
    keep = [c for c in docs.columns if c != "text"]
    # other columns travel as one struct, whatever their names
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), "text", F.col("text").isNull().alias("__null"))
    wide = _joined(slim, ["__row", "__null"], length, local)
    out = wide.mapInArrow(_finish(False), fields([f for f in wide.schema if f.name not in ("__text", "__spans")], "__kept string"))
    text = F.when(~F.col("__null"), F.col("__kept"))
    cols = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
