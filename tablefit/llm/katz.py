"""Katz backoff language model in partitioned tables.

Counts of every order are summed over all training rows. Counts up to K are discounted by
Good-Turing; the mass taken from a context goes to the words not seen after it, in proportion to
the next lower order, with a weight that makes the probabilities of each context sum to exactly 1
over the training vocabulary and one unknown word. Tokens are joined to the tables order by order:
what an order has seen is scored there, the rest carries the product of the backoff weights down.

Words and contexts are named by 64-bit hashes. Every text starts with a start mark as context and ends
with an end token that is scored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import need, remainder, settle, text_key, text_of
from tablefit.llm.flat import RangeHash, lower_ascii, pair, slices, word_ranges

ORDER, K = 2, 5
BLOCK = 1_000_000  # tokens whose pairs are put in blocks at once
ROWS, LEAST_BUCKETS = 2_000_000, 16  # training tokens a bucket
HOT = 1000
PASSES = 2
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _spots(column: pa.Array, order: int):
    """(row, contexts, w) of all scored tokens, slice by slice: the row of each, the names of the last 1..order-1
    words before it, its own."""
    for first, data, offsets in slices(column):
        data = lower_ascii(data)
        lo, hi, counts = word_ranges(data, offsets)
        rows = len(offsets) - 1
        words = RangeHash(data)(lo, hi)
        # order-1 start marks before each text, one end token after it
        sizes = np.diff(counts) + order
        at = np.concatenate(([0], np.cumsum(sizes)))
        seq = np.full(at[-1], START, np.uint64)
        row_of_word = np.repeat(np.arange(rows), np.diff(counts))
        seq[np.arange(len(words)) - counts[row_of_word] + at[row_of_word] + order - 1] = words
        seq[at[1:] - 1] = END
        row = np.repeat(np.arange(rows), sizes)
        spots = np.flatnonzero(np.arange(at[-1]) - at[row] >= order - 1)
        contexts, name = [], None
        for j in range(1, order):
            name = seq[spots - j] if name is None else pair(name, seq[spots - j])
            contexts.append(name)
        yield row[spots] + first, contexts, seq[spots]


def _gathered(column: pa.Array, order: int):
    """The same for about BLOCK tokens at once."""
    parts, n = [], 0
    for part in _spots(column, order):
        parts.append((part[0], *part[1], part[2]))
        n += len(part[0])
        if n >= BLOCK:
            yield [np.concatenate(x) for x in zip(*parts)]
            parts, n = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows start."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _grams(order: int):
    """(…, __text) to (…, g1..g{order-1}, w, n): distinct n-grams of each text and their counts. g_j
    names the last j words before w."""

    def run(batches):
        for batch in batches:
            keep = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
            for row, contexts, w in _spots(batch.column(batch.schema.get_field_index("__text")), order):
                whole = pair(contexts[-1], w) if contexts else w
                by = np.lexsort((whole, row))
                heads = _heads(whole[by], row[by])
                n = np.diff(np.append(heads, len(by)))
                pick = by[heads]
                take = pa.array(row[pick])
                cols = [batch.column(i).take(take) for i in keep]
                cols += [pa.array(c[pick].view(np.int64)) for c in (*contexts, w)] + [pa.array(n.astype(np.int64))]
                names = [*(batch.schema.names[i] for i in keep), *(f"g{j}" for j in range(1, order)), "w", "n"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def good_turing(of: dict[int, int], k: int = K) -> dict[int, float]:
    """Discount ratios of the counts 1..k from counts of counts (1..k+1).

    Where the estimate is not in (0, 1], the largest smaller k that works is taken; none: no discounts.
    """
    for top in range(k, 0, -1):
        if not all(of.get(r, 0) for r in range(1, top + 2)):
            continue
        cut = (top + 1) * of[top + 1] / of[1]
        if cut >= 1:
            continue
        ratios = {r: ((r + 1) * of[r + 1] / of[r] / r - cut) / (1 - cut) for r in range(1, top + 1)}
        if all(0 < d <= 1 for d in ratios.values()):
            return ratios
    return {}


def _discounted(c: Column, ratios: dict[int, float]) -> Column:
    out = c.cast("double")
    for r, d in ratios.items():
        out = F.when(c == r, F.lit(r * d)).otherwise(out)
    return out


def _ratios(counted: DataFrame, k: int) -> dict[int, float]:
    rows = counted.where(F.col("c") <= k + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()  # at most k + 1 rows
    return good_turing({r["c"]: r["n"] for r in rows}, k)


class KatzModel:
    """Tables of a fitted model.

    ``words``: w, c, p. ``seen[j]``: g, w, p of order j. ``contexts[j]``: g, back (backoff weight).
    ``tokens``, ``types``: training tokens and distinct ones. ``unknown``: probability of the unknown word.
    """

    def __init__(self, order: int, words: DataFrame, tokens: int, types: int, unknown: float):
        self.order, self.words, self.tokens, self.types, self.unknown = order, words, tokens, types, unknown
        self.seen: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}


def fit_words(grams: DataFrame, order: int, k: int = K) -> KatzModel:
    """The model of order 1 from rows (w, n), as the start of one of order ``order``."""
    counted = settle(grams.groupBy("w").agg(F.sum("n").alias("c")))
    size = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    tokens, types = size["n"] or 0, size["v"]
    ratios = _ratios(counted, k)
    mass = counted.agg(F.sum(_discounted(F.col("c"), ratios)).alias("d")).first()["d"] or 0.0
    whole = tokens if ratios else tokens + 1
    unknown = 1.0 - mass / whole if whole else 1.0
    p = _discounted(F.col("c"), ratios) / F.lit(float(whole))
    return KatzModel(order, counted.withColumn("p", p), tokens, types, unknown)


def fit(grams: DataFrame, order: int, k: int = K) -> KatzModel:
    """Fit on rows (g1.., w, n). Without rows the unknown word has probability 1."""
    model = fit_words(grams, order, k)
    below = model.words.select("w", "p")
    for j in range(2, order + 1):
        g, lower = f"g{j - 1}", [f"g{i}" for i in range(1, j - 1)]
        table = settle(grams.groupBy(g, "w").agg(F.sum("n").alias("c"), *[F.first(x).alias(x) for x in lower]))
        ratios = _ratios(table, k)
        keys = [*([f"g{j - 2}"] if j > 2 else []), "w"]
        joined = table.join(below.withColumnRenamed("p", "lower_p"), keys).withColumn("d", _discounted(F.col("c"), ratios))
        per = joined.groupBy(g).agg(F.sum("c").alias("all"), F.sum("d").alias("kept"), F.sum("lower_p").alias("covered"))
        # a context whose counts are all above K gives up one count's share, or nothing would be left below
        whole = F.when(F.col("kept") < F.col("all"), F.col("all")).otherwise(F.col("all") + 1).cast("double")
        per = settle(per.select(g, whole.alias("whole"), ((1.0 - F.col("kept") / whole) / (1.0 - F.col("covered"))).alias("back")))
        model.contexts[j] = per.select(g, "back")
        below = table.join(per.select(g, "whole"), g).select(g, "w", (_discounted(F.col("c"), ratios) / F.col("whole")).alias("p"))
        model.seen[j] = settle(below)
        below = model.seen[j]
    return model


def score_grams(grams: DataFrame, model: KatzModel) -> DataFrame:
    """Add c (training count, null if unknown) and log10 probability ``lp`` to rows (g1.., w, n)."""
    out = grams.join(model.words.withColumnRenamed("p", "p1"), "w", "left")
    for j in range(2, model.order + 1):
        g = f"g{j - 1}"
        out = out.join(model.seen[j].withColumnRenamed("p", f"p{j}"), [g, "w"], "left")
        out = out.join(model.contexts[j].withColumnRenamed("back", f"back{j}"), g, "left")
    lp = F.log10(F.coalesce(F.col("p1"), F.lit(model.unknown)))
    for j in range(2, model.order + 1):
        # a context that training never had backs off for nothing
        lp = F.when(F.col(f"p{j}").isNotNull(), F.log10(f"p{j}")).otherwise(F.log10(F.coalesce(F.col(f"back{j}"), F.lit(1.0))) + lp)
    return out.withColumn("lp", lp)


def _words():
    """(__text) to (w, n): distinct words of each slice and their counts."""

    def run(batches):
        for batch in batches:
            for _, w in _gathered(batch.column(0), 1):
                w, n = np.unique(w, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    return run


def _buckets(key: np.ndarray, g: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair: that of its key, or, where the key is a hot one, of the pair."""
    name = np.where(np.isin(key, hot), pair(g, w), key) if len(hot) else key
    return name.view(np.int64) % buckets


def _by_bucket(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by (bucket, key)."""
    by = np.argsort(key)
    small = bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket  # sorted by digits
    return by[np.argsort(small[by], kind="stable")]


def _blocks(bucket: np.ndarray, key: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """One row per bucket from rows sorted by (bucket, key): the keys with their numbers of rows, and the values."""
    heads = _heads(bucket, key)
    ends = np.append(np.searchsorted(bucket, at := np.unique(bucket)), len(bucket)).astype(np.int32)
    runs = np.append(np.searchsorted(bucket[heads], at), len(heads)).astype(np.int32)
    cols = {"b": pa.array(at.astype(np.int32))}
    cols["key"] = pa.ListArray.from_arrays(runs, key[heads].view(np.int64))
    cols["m"] = pa.ListArray.from_arrays(runs, np.diff(np.append(heads, len(key))).astype(np.int32))
    for name, x in values.items():
        cols[name] = pa.ListArray.from_arrays(ends, x)
    return cols


def _pairs_by_word(hot: np.ndarray, buckets: int):
    """(__text) to blocks of distinct pairs of a slice, dealt by word."""

    def run(batches):
        for batch in batches:
            for _, g, w in _gathered(batch.column(0), 2):
                whole = pair(g, w)
                by = np.argsort(whole)
                heads = _heads(whole[by])
                n = np.diff(np.append(heads, len(by))).astype(np.int32)
                g, w = g[by[heads]], w[by[heads]]
                b = _buckets(w, g, w, hot, buckets)
                by = _by_bucket(b, w)
                cols = _blocks(b[by], w[by], {"g": g[by].view(np.int64), "n": n[by]})
                yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return run


def _pairs_by_context(hot: np.ndarray, buckets: int, passes: int, turn: int):
    """(d, held, __text) to blocks of all pairs, dealt by context; those of one pass."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_numpy()
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for row, g, w in _gathered(batch.column(2), 2):
                b = _buckets(g, g, w, hot, buckets)
                on = np.flatnonzero(b % passes == turn)
                if not len(on):
                    continue
                on = on[_by_bucket(b[on], g[on])]
                row, g, w, b = row[on], g[on], w[on], b[on]
                # the texts of each block, once
                texts, row = np.unique(b * batch.num_rows + row, return_inverse=True)
                of, texts = texts // batch.num_rows, texts % batch.num_rows
                starts = _heads(of)
                row -= np.repeat(starts, np.diff(np.append(_heads(b), len(b))))
                cols = _blocks(b, g, {"w": w.view(np.int64), "row": row.astype(np.int32)})
                ends = pa.array(np.append(starts, len(of)).astype(np.int32))
                cols |= {c: pa.ListArray.from_arrays(ends, pa.array(x[texts])) for c, x in (("d", names), ("held", held))}
                yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return run


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _contexts(k: int):
    """Blocks of one bucket and its words (w, p) to what each context has there: all, covered, n1..n{k+1}."""

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "covered" else pa.int64()) for c in ("g1", "all", "covered", *(f"n{r}" for r in range(1, k + 2)))})
        key, m = _flat(blocks, "key"), _flat(blocks, "m")
        known = words.column("w").to_numpy()
        order = np.argsort(known)
        p = np.repeat(words.column("p").to_numpy()[order[np.searchsorted(known, key, sorter=order)]], m)
        w, g, n = np.repeat(key, m), _flat(blocks, "g"), _flat(blocks, "n")
        whole = pair(g.view(np.uint64), w.view(np.uint64))
        by = np.argsort(whole)
        heads = _heads(whole[by])
        c = np.add.reduceat(n[by], heads, dtype=np.int64)
        by = by[heads]
        by, c = by[to := np.argsort(g[by])], c[to]
        g, p = g[by], p[by]
        heads = _heads(g)
        out = {"g1": g[heads], "all": np.add.reduceat(c, heads), "covered": np.add.reduceat(p, heads)}
        out |= {f"n{r}": np.add.reduceat((c == r).astype(np.int64), heads) for r in range(1, k + 2)}
        return pa.table(out)

    return run


def _scores(ratios: dict[int, float], zero: float):
    """Blocks of one bucket and its contexts (g1, all, whole, back) to sums of each text, without w, and the
    pairs that training never had, with w; their probability of order 1 is still missing.

    A text's tokens are its contexts, but for the end token, which occurs as often as the start mark."""

    def run(blocks: pa.Table, contexts: pa.Table) -> pa.Table:
        names = ("d", "w", "n", "known", "base", "score", "rows")
        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())))
        if not blocks.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        key, m = _flat(blocks, "key"), _flat(blocks, "m")
        docs = blocks.column("d").combine_chunks()
        sizes = blocks.column("w").combine_chunks().value_lengths().to_numpy()
        row = _flat(blocks, "row") + np.repeat(docs.offsets.to_numpy()[:-1] - docs.offsets[0].as_py(), sizes)
        trained = ~_flat(blocks, "held")[row]
        ids, doc_of = np.unique(_flat(blocks, "d"), return_inverse=True)
        row = doc_of[row]
        # training count of each pair
        w = _flat(blocks, "w")
        whole = pair(np.repeat(key, m).view(np.uint64), w.view(np.uint64))
        by = np.argsort(whole)
        heads = _heads(whole[by])
        del whole
        c = np.empty(len(by), np.int64)
        c[by] = np.repeat(np.add.reduceat(trained[by], heads, dtype=np.int64), np.diff(np.append(heads, len(by))))
        del by, heads
        # what is known of each context
        known = contexts.column("g1").to_numpy()
        order = np.argsort(known)
        at = np.searchsorted(known, key, sorter=order)
        got = np.zeros(len(key), bool)
        if len(known):
            at = order[np.minimum(at, len(known) - 1)]
            got = known[at] == key

        def of(name: str, default: float) -> np.ndarray:
            return np.where(got, contexts.column(name).to_numpy()[at], default) if len(known) else np.full(len(key), default)

        def total(x: np.ndarray, kind: type) -> np.ndarray:
            return np.bincount(row, weights=x, minlength=len(ids)).astype(kind)

        kept = np.log10(np.maximum(c, 1))
        for r, d in ratios.items():
            kept[c == r] = math.log10(r * d)
        seen = c > 0
        lp = np.where(seen, kept - np.repeat(np.log10(of("whole", 1.0)), m), np.repeat(np.log10(of("back", 1.0)), m))
        sums = {"n": np.bincount(row, minlength=len(ids)), "known": total(np.repeat(got, m), np.int64)}
        sums |= {"base": total(np.repeat(np.log10((of("all", 0.0) + 0.5) / zero), m), np.float64), "score": total(lp, np.float64)}
        sums |= {"rows": total(np.repeat(key == START.view(np.int64), m), np.int64)}
        first = {"d": ids} | sums
        new = np.flatnonzero(~seen)
        rest = {"d": ids[row[new]], "w": w[new]}
        column = lambda part, c: pa.array(part[c]) if c in part else pa.nulls(len(part["d"]), kinds[c])
        return pa.concat_tables([pa.table({c: column(part, c) for c in names}) for part in (first, rest)])

    return run


def _dealt(table: DataFrame, key: str, hot: list[int], buckets: int) -> DataFrame:
    """Add the bucket b of each row's key; rows of hot keys go to all."""
    one = F.array(F.pmod(F.col(key), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    return table.withColumn("b", F.explode(F.when(F.col(key).isin(hot), every).otherwise(one) if hot else one))


def _scored_pairs(slim: DataFrame, k: int, rows: int, passes: int) -> tuple[DataFrame, KatzModel]:
    """Order 2: sums of every text (d, n, known, base, score, rows) over rows (d, held, __text), and the model.

    Pairs travel in blocks to buckets of about ``rows`` tokens. Training pairs go by word, to get the word's
    probability into the sums of their context; then the pairs of all texts go by context, in ``passes``
    passes that read the texts again, so that only a part of them is on disk at a time. Keys with more
    than 1/HOT of the training tokens (so fewer than HOT of them) are spread over all buckets.
    """
    trained = slim.where(~F.col("held")).select("__text")
    model = fit_words(trained.mapInArrow(_words(), "w long, n long"), 2, k)
    buckets = max(LEAST_BUCKETS, -(-model.tokens // rows))
    hot = [r["w"] for r in model.words.where(F.col("c") > model.tokens // HOT).select("w").collect()]  # fewer than HOT
    hot += [int(START.view(np.int64))] if int(END.view(np.int64)) in hot else []
    names = np.array(hot, np.int64).view(np.uint64)
    by_word = trained.mapInArrow(_pairs_by_word(names, buckets), "b int, key array<long>, m array<int>, g array<long>, n array<int>")
    words = _dealt(model.words.select("w", "p"), "w", hot, buckets)
    of = [f"n{r}" for r in range(1, k + 2)]
    parts = by_word.groupBy("b").cogroup(words.groupBy("b")).applyInArrow(_contexts(k), "g1 long, all long, covered double, " + ", ".join(f"{c} long" for c in of))
    per = settle(parts.groupBy("g1").agg(*[F.sum(c).alias(c) for c in ("all", "covered", *of)]))
    sums = per.agg(*[F.sum(c).alias(c) for c in of]).first()
    ratios = good_turing({r: sums[c] or 0 for r, c in enumerate(of, 1)}, k)
    taken = sum((F.col(f"n{r}") * F.lit(r * (1.0 - d)) for r, d in ratios.items()), F.lit(0.0))
    # a context whose counts are all above K gives up one count's share, or nothing would be left below
    whole = F.when(taken > 0, F.col("all")).otherwise(F.col("all") + 1).cast("double")
    per = per.select("g1", "all", whole.alias("whole"), ((1.0 - (F.col("all") - taken) / whole) / (1.0 - F.col("covered"))).alias("back"))
    model.contexts[2] = per.select("g1", "back")
    contexts = _dealt(per, "g1", hot, buckets)
    found = []
    for turn in range(passes):
        pairs = slim.mapInArrow(
            _pairs_by_context(names, buckets, passes, turn),
            "b int, key array<long>, m array<int>, w array<long>, row array<int>, d array<long>, held array<boolean>",
        )
        here = contexts.where(F.col("b") % passes == turn)
        scores = _scores(ratios, model.tokens + 0.5 * (model.types + 1))
        found.append(settle(pairs.groupBy("b").cogroup(here.groupBy("b")).applyInArrow(scores, "d long, w long, n long, known long, base double, score double, rows long")))
    found = reduce(DataFrame.unionByName, found)
    lp = F.log10(F.coalesce(F.col("p"), F.lit(model.unknown)))
    new = found.where("w IS NOT NULL").drop("score").join(model.words.select("w", "p"), "w", "left").withColumn("score", lp).drop("w", "p")
    both = found.where("w IS NULL").drop("w").unionByName(new)
    return both.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "score", "rows")]), model


def _scored_grams(slim: DataFrame, order: int, k: int) -> tuple[DataFrame, KatzModel]:
    """The same for any order, by joins."""
    schema = "d long, held boolean, " + "".join(f"g{j} long, " for j in range(1, order)) + "w long, n long"
    grams = slim.mapInArrow(_grams(order), schema)
    model = fit(grams.where(~F.col("held")), order, k)
    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.5) / F.lit(model.tokens + 0.5 * (model.types + 1)))
    per = score_grams(grams, model).groupBy("d").agg(
        F.sum(n).alias("n"), F.sum(F.when(c > 0, n).otherwise(0)).alias("known"), F.sum(n * base).alias("base"),
        F.sum(n * F.col("lp")).alias("score"), F.sum(F.when(F.col("w") == int(END.view(np.int64)), n).otherwise(0)).alias("rows"),
    )
    return per, model


def scored_documents(docs: DataFrame, order: int = ORDER, k: int = K, rows: int = ROWS, passes: int = PASSES) -> DataFrame:
    """The contract of op7, for every row of ``docs`` (doc_id, text).

    A null or empty text is one end token. Repeated rows train as often as they occur and get equal
    scores. Texts are read whole; without training rows every token is unknown. ``rows`` and ``passes``
    bound memory and disk at order 2; the result does not depend on them.
    """
    need(docs, "doc_id", "text")
    text = text_of(docs)
    # 64 bits name a document by its id and text
    d = F.xxhash64(F.xxhash64("doc_id"), *text_key(text))
    held = remainder(F.col("doc_id"), 5) == 1
    slim = docs.select(d.alias("d"), held.alias("held"), text.alias("__text"))
    per, model = _scored_pairs(slim, k, rows, passes) if order == 2 else _scored_grams(slim, order, k)
    # rows with equal id and text were summed together; each has one end token
    whole = lambda x: F.expr(f"{x} div rows")
    return docs.select("doc_id", d.alias("d"), held.alias("held_out")).join(per, "d").select(
        "doc_id", "held_out", whole("n").alias("n_tokens"), whole("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )


def perplexity(scored: DataFrame) -> float:
    """Ten to minus the mean log10 probability of a token."""
    s = scored.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return math.inf if not s["n"] else 10 ** (-s["s"] / s["n"])
