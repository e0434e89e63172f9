"""Language identification by rank-order profiles.

Letters are lower-cased; every run of letters is a word between two marks. The n-grams (1 to 3
symbols) of a word may include a mark at either end. A profile lists the most frequent n-grams of
a language by rank. The distance of a document is the sum, over its own most frequent n-grams, of
how far each is out of place in the profile; an n-gram that the profile lacks counts as its length.
An n-gram is numbered by its code points, so every letter of every script counts as itself. Ties in a
rank, of a profile or of a document, go to the shorter n-gram, then to the smaller code points; ties in
the distance to the smaller name of the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablefit.llm.common import fields, need, remainder, text_of
from tablefit.llm.flat import PART, parts, slices

RANKS = 300
POINTS = 0x110000  # code points
HELD = 250_000  # different n-grams that a task merges before it hands them on
LOW, STEPS = 0.01, 1000  # the quantile of clean scores that a least score is set by, in steps of 1/STEPS
PREFIXES = [2**k for k in range(3, 12)]  # characters; their scores say what short texts reach
MARGIN = 2  # how many times the gap from the median to that quantile lies below it
ENOUGH = 100  # scores that a quantile needs
_IS_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a slice and the offsets of its rows among them. Lower-casing that
    changes a length ('İ') is rare, so rows are lower-cased apart only when it does."""
    text = data.tobytes().decode("utf-8", "replace")
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    rows = starts[offsets]
    low = text.lower()
    if len(low) != rows[-1]:
        parts = [text[a:b].lower() for a, b in zip(rows[:-1], rows[1:])]
        low, rows = "".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), rows.astype(np.int64)


def grams_of(points: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of one text of code points: letters as they are, 0 for the mark between words."""
    s = np.zeros(len(points) + 2, np.int64)
    s[1:-1] = np.where(_letter_table()[points], points, 0)
    keep = s > 0
    keep[1:] |= s[:-1] > 0  # one mark after each word
    keep[0] = True
    s = s[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    if s[1] == 0:
        s = s[1:]
    one = s[s > 0]
    two = POINTS + s[:-1] * POINTS + s[1:]
    three = POINTS + POINTS**2 + (s[:-2] * POINTS + s[1:-1]) * POINTS + s[2:]
    return np.concatenate((one, two, three[s[1:-1] > 0]))


def _rows(data: np.ndarray, offsets: np.ndarray):
    """The n-gram numbers of each row of a slice in turn."""
    points, at = _points(data, offsets)
    for a, b in zip(at[:-1], at[1:]):
        yield grams_of(points[a:b])


class _Tally:
    """Counts of n-grams of one language: numbers met since the last merge, and the merged counts."""

    def __init__(self):
        self.pending, self.waiting = [], 0
        self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting > HELD:
            self.merge()

    def merge(self) -> None:
        if self.pending:
            ids, n = np.unique(np.concatenate(self.pending), return_counts=True)
            self.grams, back = np.unique(np.concatenate((self.grams, ids)), return_inverse=True)
            self.n = np.bincount(back, np.concatenate((self.n, n)), len(self.grams)).astype(np.int64)
            self.pending, self.waiting = [], 0


def _gram_counts(batches):
    held: dict[str, _Tally] = {}

    def flush():
        for lang, tally in held.items():
            tally.merge()
            yield pa.record_batch([pa.array([lang] * len(tally.n), pa.string()), pa.array(tally.grams), pa.array(tally.n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, data, offsets in slices(batch.column(0), PART):
            for i, ids in enumerate(_rows(data, offsets)):
                held.setdefault(langs[first + i], _Tally()).add(ids)
            if sum(t.waiting + len(t.n) for t in held.values()) > 4 * HELD:
                yield from flush()
    yield from flush()


class Profiles:
    """For each language its n-grams in order of rank. Size: languages times ``ranks``."""

    def __init__(self, ranked: dict[str, list[int]], ranks: int):
        self.ranked, self.ranks = ranked, ranks


def train(df: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> Profiles:
    """Profiles from all rows with a language; counts are summed in Spark over every row.

    What reaches the driver is bounded: ``ranks`` n-grams a language.
    """
    rows = df.select(text_of(df, text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    counts = rows.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= ranks)
    ranked: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    for r in rows.select("lang").distinct().collect():  # a language whose texts have no letter
        ranked.setdefault(r["lang"], [])
    return Profiles(dict(sorted(ranked.items())), ranks)


def _top(ids: np.ndarray, ranks: int) -> tuple[np.ndarray, int]:
    """The most frequent n-grams of a document, by count, then by number, and how many different there are."""
    grams, n = np.unique(ids, return_counts=True)
    different = len(grams)
    if different > ranks:
        least = np.partition(n, different - ranks)[different - ranks]
        keep = n >= least
        grams, n = grams[keep], n[keep]
    return grams[np.argsort(-n, kind="stable")[:ranks]], different


def _predict(profiles: Profiles, sizes: bool = False):
    names, ranks = list(profiles.ranked), profiles.ranks

    def run(batches):
        # one row of places for each n-gram of any profile, and a last one for all others
        known = np.unique(np.array([g for grams in profiles.ranked.values() for g in grams], np.int64))
        padded = np.append(known, -1)
        place = np.full((len(known) + 1, max(1, len(names))), -1, np.int32)
        for j, name in enumerate(names):
            place[np.searchsorted(known, profiles.ranked[name]), j] = np.arange(len(profiles.ranked[name]))
        for batch in batches:
            for rest, data, offsets in parts(batch):
                out, scores, octaves = [], [], []
                for ids in _rows(data, offsets):
                    if len(ids) == 0 or not names:
                        out.append("und")
                        scores.append(0.0)
                        octaves.append(0)
                        continue
                    own, different = _top(ids, ranks)
                    if sizes:
                        octaves.append(different.bit_length() - 1)
                    at = np.searchsorted(known, own)
                    at[padded[at] != own] = len(known)
                    p = place[at]
                    far = np.abs(p - np.arange(len(own))[:, None])
                    far[p < 0] = ranks
                    d = far.sum(axis=0)
                    j = int(np.argmin(d))  # ties: the smaller name
                    out.append(names[j])
                    scores.append(1.0 - float(d[j]) / (ranks * len(own)))
                cols, names_ = [pa.array(out, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
                if sizes:
                    cols, names_ = [*cols, pa.array(octaves, pa.int32())], [*names_, "octave"]
                yield pa.RecordBatch.from_arrays([*rest.columns, *cols], names=[*rest.schema.names, *names_])

    return run


def predict(df: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None, sizes: bool = False) -> DataFrame:
    """Add lang_pred and score (1 minus the distance over the largest possible one) to the ``keep`` columns;
    with ``sizes`` also octave, the whole base-2 logarithm of the number of different n-grams.

    A null text or one without letters is 'und' with score 0; so is everything without profiles.
    Every row is predicted from its text alone; repeated rows get equal results.
    """
    keep = df.columns if keep is None else keep
    slim = df.select(*[F.col(f"`{c}`") for c in keep], text_of(df, text).alias("__text"))
    if "__text" in keep:
        raise ValueError("the column name __text is taken")
    made = "lang_pred string, score double" + (", octave int" if sizes else "")
    return slim.mapInArrow(_predict(profiles, sizes), fields(slim.schema.fields[:-1], made))


def least_scores(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang_pred, octave, least): the score below which a text of that language and octave is an outlier.

    All rows with a language are scored, whole and by their prefixes, so that every length below the
    longest is known. Of the scores of rows predicted as labelled, the least score lies MARGIN
    times as far below the LOW quantile as that lies below the median; a longer text need not score more than those an octave below.
    An octave with less than ENOUGH scores has no row; the nearest one below it holds. Counts are exact, so a run gives the same least scores each time.
    """
    whole = text_of(df, text)
    cuts = F.array(whole, *[F.when(F.length(whole) > n, F.substring(whole, 1, n)) for n in PREFIXES])
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.explode(cuts).alias("text")).where("text is not null")
    scored = predict(rows, profiles, keep=["lang"], sizes=True).where("lang = lang_pred")
    cells = scored.groupBy("lang_pred", "octave", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    each = W.partitionBy("lang_pred", "octave")  # at most STEPS + 1 rows
    upto = cells.withColumns({"upto": F.sum("n").over(each.orderBy("step")), "all": F.sum("n").over(each)}).where(F.col("all") >= ENOUGH)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step"))) / STEPS
    fences = upto.groupBy("lang_pred", "octave").agg((at(LOW) - MARGIN * (at(0.5) - at(LOW))).alias("least"))
    return fences.withColumn("least", F.min("least").over(W.partitionBy("lang_pred").orderBy("octave").rowsBetween(-1, 0)))


def identified_documents(docs: DataFrame) -> DataFrame:
    """The contract of op6: profiles from rows whose crc32 remainder is not 2, predictions for all."""
    need(docs, "doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    profiles = train(docs.where(~held))
    out = predict(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
