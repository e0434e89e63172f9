"""Merkle fingerprints of documents.

The leaves of the tree are pieces of a paragraph, cut after words that their own hash selects, so
an edit changes the leaves it touches and no others. Leaves hash to paragraphs (lines), paragraphs
to sections (runs of paragraphs, closed by a paragraph whose hash selects it), sections to the root.
Equal texts have equal roots; where two roots differ, only differing branches need a closer look.

As text: ``root;section:paragraph=leaf.words,leaf.words/paragraph=...|section:...``
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablefit.llm.common import fields, need, range_buckets, text_of
from tablefit.llm.flat import RangeHash, slices, word_ranges

CUT = 6  # one word in CUT closes a leaf
LEAST, MOST = 2, 24  # words of a leaf
SECTION = 4  # one paragraph in SECTION closes a section
BUCKET_BYTES, MOST_RANGES = 4 << 20, 2000
ROWS = 500
NAME = 5  # bytes of a printed name; parents are hashed from whole digests


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaf_ends(data: np.ndarray, offsets: np.ndarray):
    """For each row: byte ends and word counts of its leaves, and which leaves end a paragraph."""
    lo, hi, counts = word_ranges(data, offsets)
    picked = RangeHash(data)(lo, hi) % np.uint64(CUT) == 0 if len(lo) else np.zeros(0, bool)
    lines = np.flatnonzero(data == 10) + 1
    for i in range(len(offsets) - 1):
        a, b, start, stop = counts[i], counts[i + 1], offsets[i], offsets[i + 1]
        if start == stop:
            yield [], [], []
            continue
        own = lines[np.searchsorted(lines, start, "right") : np.searchsorted(lines, stop, "right")]
        ends, words, closes = [], [], []
        row_lo, row_picked = lo[a:b], picked[a:b]
        at = 0
        for line_end in [*own.tolist(), None]:
            if line_end is None:
                if len(own) and own[-1] == stop:
                    break
                line_end = stop
            upto = int(np.searchsorted(row_lo, line_end)) if at < len(row_lo) else at
            # a leaf may end where a selected word ends: that is, before the next word begins
            since = at
            for j in (np.flatnonzero(row_picked[at:upto]) + at).tolist():
                while j + 1 - since > MOST:
                    since += MOST
                    ends.append(int(row_lo[since]))
                    words.append(MOST)
                    closes.append(False)
                if j + 1 - since >= LEAST and j + 1 < upto:
                    ends.append(int(row_lo[j + 1]))
                    words.append(j + 1 - since)
                    closes.append(False)
                    since = j + 1
            while upto - since > MOST:
                since += MOST
                ends.append(int(row_lo[since]))
                words.append(MOST)
                closes.append(False)
            ends.append(int(line_end))
            words.append(upto - since)
            closes.append(True)
            at = upto
        yield ends, words, closes


def trees(data: np.ndarray, offsets: np.ndarray):
    """Fingerprint and leaf weights (words, at least 1) of each row."""
    raw = data.tobytes()
    for i, (ends, words, closes) in enumerate(_leaf_ends(data, offsets)):
        at, leaves, weights = int(offsets[i]), [], Counter()
        sections, paragraphs, line = [], [], []
        for end, n, close in zip(ends, words, closes):
            whole = _digest(raw[at:end])
            name = whole[:NAME].hex()
            weights[name] += max(1, n)
            leaves.append(f"{name}.{n}")
            line.append(whole)
            at = end
            if close:
                own = _digest(b"".join(line))
                paragraphs.append((own, ",".join(leaves)))
                leaves, line = [], []
                if own[0] % SECTION == 0:
                    sections.append(paragraphs)
                    paragraphs = []
        if paragraphs:
            sections.append(paragraphs)
        out, heads = [], []
        for section in sections:
            head = _digest(b"".join(p for p, _ in section))
            heads.append(head)
            out.append(head[:NAME].hex() + ":" + "/".join(f"{p[:NAME].hex()}={ls}" for p, ls in section))
        yield _digest(b"".join(heads)).hex() + ";" + "|".join(out), weights


def likeness(a: Counter, b: Counter) -> float:
    """Share of words in leaves that both trees have; 1 for two empty trees."""
    whole = sum(a.values()) + sum(b.values())
    if whole == 0:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 2.0 * sum(min(n, large[k]) for k, n in small.items() if k in large) / whole


def leaf_weights(fingerprint: str) -> Counter:
    """Leaf weights read back from a fingerprint."""
    weights: Counter = Counter()
    for _, paragraphs in parse(fingerprint)[1]:
        for _, leaves in paragraphs:
            for name, n in leaves:
                weights[name] += max(1, n)
    return weights


def parse(fingerprint: str):
    """(root, [(section, [(paragraph, [(leaf, words)])])])"""
    root, _, rest = fingerprint.partition(";")
    sections = []
    for part in rest.split("|") if rest else []:
        head, _, body = part.partition(":")
        paragraphs = []
        for p in body.split("/"):
            own, _, ls = p.partition("=")
            paragraphs.append((own, [(x.partition(".")[0], int(x.partition(".")[2])) for x in ls.split(",")]))
        sections.append((head, paragraphs))
    return root, sections


def locate_edits(old: str, new: str) -> list[tuple[int, int]]:
    """Word ranges of ``new`` whose leaves are not in ``old``; equal branches are passed over whole."""
    (root_a, a), (root_b, b) = parse(old), parse(new)
    if root_a == root_b:
        return []
    sections, paragraphs = Counter(s for s, _ in a), Counter(p for _, ps in a for p, _ in ps)
    left = Counter(n for _, ps in a for _, ls in ps for n, _ in ls)
    out: list[tuple[int, int]] = []
    at = 0
    for head, ps in b:
        same_section = sections[head] > 0
        sections[head] -= same_section
        for own, leaves in ps:
            same = same_section or paragraphs[own] > 0
            paragraphs[own] -= paragraphs[own] > 0
            for name, n in leaves:
                if same or left[name] > 0:
                    left[name] -= left[name] > 0
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + n)
                else:
                    out.append((at, at + n))
                at += n
    return out


def _fingerprints(columns: list[str]):
    """Fingerprints of several text columns of a batch, which are dropped, as <column>_fp, and the
    likeness of the first to each other one."""

    def run(batches):
        # few rows at a time: the weights of all their leaves are held
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            done, near = {}, {c: [] for c in columns[1:]}
            first: list[Counter] = []
            for c in columns:
                done[c], i = [], 0
                for _, data, offsets in slices(batch.column(batch.schema.get_field_index(c))):
                    for fp, weights in trees(data, offsets):
                        done[c].append(fp)
                        if c == columns[0]:
                            first.append(weights)
                        else:
                            near[c].append(likeness(first[i], weights))
                        i += 1
            rest = batch.drop_columns(columns)
            cols = [pa.array(done[c], pa.string()) for c in columns] + [pa.array(near[c], pa.float64()) for c in columns[1:]]
            names = [f"{c}_fp" for c in columns] + [f"{c}_near" for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([*rest.columns, *cols], names=[*rest.schema.names, *names])

    return run


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column; a null text counts as empty, which has a root of its own."""
    slim = df.select(*[F.col(f"`{c}`") for c in df.columns], text_of(df, text).alias("__text"))
    return slim.mapInArrow(_fingerprints(["__text"]), fields(slim.schema.fields[:-1], "__text_fp string")).withColumnRenamed("__text_fp", name)


def with_next(df: DataFrame, order: list[str], text: str) -> DataFrame:
    """Add ``next_text``: the text of the following row in the order given; the first row follows the last.

    Rows are dealt to ranges of the order of about BUCKET_BYTES of text; the first row of each range
    is also put into the range before it, so that no window needs more than one range.
    """
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, int((sizes["bytes"] or 0) // BUCKET_BYTES) + 1)
    ranges = min(MOST_RANGES, wanted)  # their ends are held by every task; beyond, ranges grow
    key = F.struct(*[F.col(o) for o in order])
    placed = range_buckets(df.withColumn("__key0", key), F.col("__key0"), ranges, sizes["n"], "__bucket")
    # one row per range: its first key and text
    heads = placed.groupBy("__bucket").agg(F.min(F.struct("__key0", text)).alias("h"))
    heads = heads.withColumn("before", F.lag("__bucket").over(W.partitionBy(F.lit(0)).orderBy("__bucket")))
    heads = heads.withColumn("before", F.coalesce("before", F.max("__bucket").over(W.partitionBy(F.lit(0)))))
    guests = heads.select(
        *[(F.col("before") if c == "__bucket" else F.col("h.__key0") if c == "__key0" else F.col(f"h.{text}") if c == text else F.lit(None)).alias(c) for c in placed.columns],
        F.lit(1).alias("__guest"),
    )
    both = placed.withColumn("__guest", F.lit(0)).unionByName(guests)
    w = W.partitionBy("__bucket").orderBy("__guest", "__key0")
    return both.withColumn("next_text", F.lead(text).over(w)).where("__guest = 0").drop("__bucket", "__guest", "__key0")


def fingerprinted_documents(docs: DataFrame) -> DataFrame:
    """The contract of op4. Order: doc_id (null first), then a hash of the text, so repeated ids have a
    fixed order; equal rows are interchangeable. A single document follows itself."""
    need(docs, "doc_id", "text")
    text = text_of(docs)
    slim = docs.select("doc_id", text.alias("__text"), F.xxhash64(text).alias("__h"))
    pairs = with_next(slim, ["doc_id", "__h"], "__text")
    n = F.length("__text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    wide = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "__text",
        edited.alias("__edited"), F.col("next_text").alias("__next"),
    )
    out = wide.mapInArrow(
        _fingerprints(["__text", "__edited", "__next"]),
        "doc_id long, n_chars long, edited_sha256 string, __text_fp string, __edited_fp string, __next_fp string, __edited_near double, __next_near double",
    )
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("__text_fp").alias("fingerprint"), F.col("__edited_fp").alias("edited_fingerprint"),
        F.col("__edited_near").alias("near_edited"), F.col("__next_near").alias("near_next"),
    )
