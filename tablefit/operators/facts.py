"""One-row-per-column facts about a table, measured by a few bounded scans and kept for reuse.

Every rule of the library (drop, impute, encode, scale, quality, issues) reads these facts, so a
full readiness report costs a handful of passes however many rules it evaluates. What comes back
to the driver is one row per column (or per column pair), never rows of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.functions.exprs import c, dots_and_minus_number, long_numbers, row_digest
from tablefit.functions.ranks import count_values, distinct_counts, exact_quantiles, group_many, when_map
from tablefit.sources.tables import column_kinds, integral_cols, normalise, spread_small

PAIRS_IN_JVM = 12  # beyond that the generated aggregate code outgrows the JIT limit
CASTABLE_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
LONG_TEXT = 64  # longer strings are counted by their md5 digest


class Facts:
    """Lazy, memoised statistics of one table.

    ``approx=True`` replaces exact distinct counts by HyperLogLog++ ones (pre-screening only: the
    identifier rules compare distinct counts with the row count).
    """

    def __init__(self, df: DataFrame, approx: bool = False):
        self.df = spread_small(normalise(df))
        self.spark = df.sparkSession
        self.columns = list(df.columns)
        self.kinds = column_kinds(df)
        self.whole = integral_cols(df)
        self.types = dict(df.dtypes)
        self.approx = approx
        self._scan: dict[str, dict] | None = None
        self._distinct: dict[str, int] = {}
        self._quantiles: dict[tuple[str, float], float | None] = {}
        self._outliers: dict[str, tuple[int, int]] = {}
        self._corr: dict[tuple[str, str], float | None] = {}
        self._duplicates: int | None = None
        self._top: dict[str, list[tuple[str, int]]] = {}
        self._rows: int | None = None

    def release(self) -> None:
        """Drop the kept copy of a small table."""
        self.df.unpersist()

    # ---- plain facts -----------------------------------------------------------------------
    @property
    def numeric(self) -> list[str]:
        return [n for n in self.columns if self.kinds[n] == "numeric"]

    @property
    def strings(self) -> list[str]:
        return [n for n in self.columns if self.kinds[n] == "string"]

    @property
    def categorical(self) -> list[str]:
        return [n for n in self.columns if self.kinds[n] in ("string", "boolean")]

    @property
    def rows(self) -> int:
        self.scan()
        return self._rows

    def scan(self) -> dict[str, dict]:
        """Counts, moments, ranges and text shares of all columns. Numbers and texts are measured
        in long form by separate scans; each reads only its own columns."""
        if self._scan is not None:
            return self._scan
        out: dict[str, dict] = {n: {} for n in self.columns}
        rest = [n for n in self.columns if self.kinds[n] != "numeric"]
        counts = [F.count(c(n)).alias(f"n{i}") for i, n in enumerate(rest)]
        row = self.df.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
        self._rows = row["rows"]
        for i, name in enumerate(rest):
            out[name]["present"] = row[f"n{i}"]
        for r in self._number_scan():
            out[self.numeric[r["i"]]] = r.asDict()
        for r in self._text_scan():
            out[self.strings[r["i"]]] |= r.asDict()
        if self.approx:
            got = self.df.agg(*[F.approx_count_distinct(c(n), 0.01).alias(f"k{i}") for i, n in enumerate(self.columns)]).first()
            for i, name in enumerate(self.columns):
                out[name]["approx"] = got[f"k{i}"]
        for name, m in out.items():
            self._finish(name, m)
        self._scan = out
        return out

    def _number_scan(self):
        if not self.numeric:
            return []
        v = F.col("v")
        return long_numbers(self.df, self.numeric).groupBy("i").agg(
            F.count(v).alias("present"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.skewness(v).alias("g1"),
            F.kurtosis(v).alias("g2"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"),
            F.count_if(v < 0).alias("negatives"), F.count_if((v == 0) | (v == 1)).alias("unit"),
            F.count_if(v == F.floor(v)).alias("integers"),
        ).collect()

    def _text_scan(self):
        if not self.strings:
            return []
        pairs = [x for i, n in enumerate(self.strings) for x in (F.lit(i), c(n))]
        v = F.col("v")
        rows = self.df.select(F.stack(F.lit(len(self.strings)), *pairs).alias("i", "v")).where("v is not null")
        return rows.groupBy("i").agg(
            F.avg(F.length(v).cast("double")).alias("avg_length"), F.count_if(F.contains(v, F.lit(" "))).alias("spaced"),
            F.count_if(dots_and_minus_number(v, True)).alias("numberlike"),
            F.count_if(dots_and_minus_number(v, False)).alias("numberlike_any"),
            # a pattern, because a failed cast costs an exception per value
            F.count_if(v.rlike(CASTABLE_TEXT)).alias("castable"),
        ).collect()

    def _finish(self, name: str, m: dict) -> None:
        n = m.setdefault("present", 0)
        m["missing"] = self._rows - n
        m["missing_share"] = m["missing"] / self._rows if self._rows else 0.0
        if self.kinds[name] == "numeric":
            for empty in ("mean", "var", "g1", "g2", "min", "max"):
                m.setdefault(empty, None)
            for empty in ("zeros", "negatives", "unit", "integers"):
                m.setdefault(empty, 0)
            g1, g2, var = m.pop("g1"), m.pop("g2"), m["var"]
            m["std"] = math.sqrt(var) if var is not None else None
            m["std_pop"] = math.sqrt(var * (n - 1) / n) if var is not None else 0.0 if n else None
            m["skew"] = (g1 or 0.0) * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
            m["kurt"] = (
                (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 and g2 is not None else 0.0 if n > 3 else None
            )
            m["is_unit"] = m["unit"] == n
        if self.kinds[name] == "string":
            for empty in ("spaced", "numberlike", "numberlike_any", "castable"):
                m.setdefault(empty, 0)
            m.setdefault("avg_length", None)

    # ---- facts that need their own pass ----------------------------------------------------
    def distinct(self, cols: list[str] | None = None) -> dict[str, int]:
        """Distinct non-null values per column, exact: columns of few values share one shuffle."""
        cols = cols or self.columns
        todo = [n for n in cols if n not in self._distinct]
        if todo and self.approx:
            self._distinct |= {n: self.scan()[n]["approx"] for n in todo}
        elif todo:
            self._distinct |= distinct_counts(self.df, todo, LONG_TEXT)
        return {n: self._distinct[n] for n in cols}

    def quantiles(self, probs: list[float], cols: list[str] | None = None) -> dict[str, dict[float, float | None]]:
        cols = self.numeric if cols is None else cols
        missing_p = sorted({p for p in probs for n in cols if (n, p) not in self._quantiles})
        todo = [n for n in cols if any((n, p) not in self._quantiles for p in probs)]
        if todo:
            for name, got in exact_quantiles(self.df, todo, missing_p).items():
                for p, v in got.items():
                    self._quantiles[name, p] = v
        return {n: {p: self._quantiles[n, p] for p in probs} for n in cols}

    def fences(self, cols: list[str] | None = None) -> dict[str, tuple[float, float] | None]:
        """1.5 IQR fences; None for an empty column."""
        q = self.quantiles([0.25, 0.75], cols)
        out = {}
        for name, got in q.items():
            if got[0.25] is None:
                out[name] = None
                continue
            iqr = got[0.75] - got[0.25]
            out[name] = (got[0.25] - 1.5 * iqr, got[0.75] + 1.5 * iqr)
        return out

    def outliers(self, cols: list[str] | None = None) -> dict[str, tuple[int, int]]:
        """(|z| > 3 count, outside-fence count) per numeric column, one pass for all."""
        cols = self.numeric if cols is None else cols
        todo = [n for n in cols if n not in self._outliers]
        if todo:
            facts, fences = self.scan(), self.fences(todo)
            live = {i: n for i, n in enumerate(todo) if fences[n] is not None}
            lookup = lambda get: when_map(F.col("i"), {i: get(n) for i, n in live.items()})
            z = (F.col("v") - lookup(lambda n: facts[n]["mean"])) / lookup(lambda n: (facts[n]["std"] or 0.0) + 1e-9)
            beyond = (F.col("v") < lookup(lambda n: fences[n][0])) | (F.col("v") > lookup(lambda n: fences[n][1]))
            self._outliers |= {n: (0, 0) for n in todo}
            rows = long_numbers(self.df, todo).groupBy("i").agg(F.count_if(F.abs(z) > 3).alias("z"), F.count_if(beyond).alias("o"))
            self._outliers |= {todo[r["i"]]: (r["z"], r["o"]) for r in rows.collect()}
        return {n: self._outliers[n] for n in cols}

    def duplicates(self) -> int:
        """Rows minus distinct rows; only 16-byte fingerprints are shuffled."""
        if self._duplicates is None:
            rows = self.df.count() if self._rows is None else self._rows
            prints = group_many(self.df.select(*row_digest(self.df)), ["d1", "d2"], {"k": (F.count(F.lit(1)), F.sum("k"))}, rows)
            got = prints.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra")).first()
            self._duplicates = int(got["extra"])
        return self._duplicates

    def corr(self, cols: list[str] | None = None) -> dict[tuple[str, str], float | None]:
        """Pearson r of every numeric pair (a before b in schema order)."""
        cols = self.numeric if cols is None else cols
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        todo = [p for p in pairs if p not in self._corr]
        if todo:
            self._corr |= pair_correlations(self.df, todo, {n: self.scan()[n]["mean"] or 0.0 for n in cols})
        return {p: self._corr[p] for p in pairs}

    def corr_with(self, target: str, cols: list[str] | None = None) -> dict[str, float | None]:
        """Pearson r of numeric columns with a numeric target."""
        cols = [n for n in (cols or self.numeric) if n != target]
        place = {n: i for i, n in enumerate(self.numeric)}
        key = {n: (n, target) if place.get(n, -1) < place.get(target, 10**9) else (target, n) for n in cols}
        todo = [n for n in cols if key[n] not in self._corr]
        if todo:
            self._corr |= pair_correlations(self.df, [key[n] for n in todo], {n: self.scan()[n]["mean"] or 0.0 for n in (*todo, target)})
        return {n: self._corr[key[n]] for n in cols}

    def top(self, cols: list[str], k: int = 10) -> dict[str, list[tuple[str, int]]]:
        """The k most frequent values of each column (ties: smaller text first)."""
        todo = [n for n in cols if n not in self._top or len(self._top[n]) < k]
        if todo:
            rows = top_values(count_values(self.df, todo), k).collect()
            for n in todo:
                self._top[n] = [(r["value"], r["cnt"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["column"] == n]
        return {n: self._top[n][:k] for n in cols}

    # ---- as a table ------------------------------------------------------------------------
    FIELDS = [
        ("ordinal", "bigint"), ("column", "string"), ("kind", "string"), ("type", "string"), ("is_int", "boolean"),
        ("rows", "bigint"), ("present", "bigint"), ("missing", "bigint"), ("distinct", "bigint"), ("mean", "double"),
        ("std", "double"), ("var", "double"), ("std_pop", "double"), ("min", "double"), ("max", "double"),
        ("skew", "double"), ("kurt", "double"), ("zeros", "bigint"), ("negatives", "bigint"), ("is_unit", "boolean"),
        ("integers", "bigint"), ("q25", "double"), ("q50", "double"), ("q75", "double"), ("z_outliers", "bigint"),
        ("iqr_outliers", "bigint"), ("avg_length", "double"), ("spaced", "bigint"), ("numberlike", "bigint"),
        ("numberlike_any", "bigint"), ("castable", "bigint"),
    ]

    def table(self, *parts: str) -> DataFrame:
        """Facts as a DataFrame, one row per column. ``parts`` names the optional passes to make:
        distinct, quantiles, outliers."""
        scan = self.scan()
        distinct = self.distinct() if "distinct" in parts else {}
        quant = self.quantiles([0.25, 0.5, 0.75]) if "quantiles" in parts or "outliers" in parts else {}
        outs = self.outliers() if "outliers" in parts else {}
        rows = []
        for i, name in enumerate(self.columns):
            m = dict(scan[name])
            q, o = quant.get(name, {}), outs.get(name, (None, None))
            m |= {
                "ordinal": i, "column": name, "kind": self.kinds[name], "type": self.types[name],
                "is_int": name in self.whole, "rows": self._rows, "distinct": distinct.get(name),
                "q25": q.get(0.25), "q50": q.get(0.5), "q75": q.get(0.75), "z_outliers": o[0], "iqr_outliers": o[1],
            }
            rows.append(tuple(m.get(f) for f, _ in self.FIELDS))
        return small_table(self.spark, rows, self.FIELDS)


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]], means: dict[str, float]) -> dict[tuple[str, str], float | None]:
    """Pearson r of column pairs over rows where both are present, in one pass.

    Sums are taken of deviations from the known column means, which keeps them stable. Few pairs
    are summed by JVM aggregates; for many, every task multiplies its Arrow batches into one
    matrix of cross products and only those matrices are shuffled.
    """
    names = sorted({n for p in pairs for n in p})
    dev = {n: c(n).cast("double") - F.lit(means[n]) for n in names}
    if len(pairs) <= PAIRS_IN_JVM:
        aggs = []
        for j, (a, b) in enumerate(pairs):
            x, y = F.when(dev[b].isNotNull(), dev[a]), F.when(dev[a].isNotNull(), dev[b])
            aggs += [
                F.count(x).alias(f"n{j}"), F.sum(x).alias(f"x{j}"), F.sum(y).alias(f"y{j}"),
                F.sum(x * x).alias(f"xx{j}"), F.sum(y * y).alias(f"yy{j}"), F.sum(x * y).alias(f"xy{j}"),
            ]
        row = df.agg(*aggs).first()
        sums = {p: [row[f"{m}{j}"] for m in ("n", "x", "y", "xx", "yy", "xy")] for j, p in enumerate(pairs)}
    else:
        slim = df.select(*[dev[n].alias(f"x{i}") for i, n in enumerate(names)])
        fields = "i int, j int, n double, x double, y double, xx double, yy double, xy double"
        parts = slim.mapInPandas(_cross_products, fields)
        cols = ["n", "x", "y", "xx", "yy", "xy"]
        got = parts.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in cols]).collect()
        by_pair = {(names[r["i"]], names[r["j"]]): [r[m] for m in cols] for r in got}
        swap = lambda s: [s[0], s[2], s[1], s[4], s[3], s[5]]
        sums = {(a, b): by_pair[a, b] if (a, b) in by_pair else swap(by_pair[b, a]) if (b, a) in by_pair else [0] * 6 for a, b in pairs}
    return {p: _r_from_sums(*s) for p, s in sums.items()}


def _cross_products(batches):
    import numpy as np
    import pandas as pd

    total = None
    for batch in batches:
        x = batch.to_numpy(dtype=float)
        m = (~np.isnan(x)).astype(float)
        x = np.where(m == 1, x, 0.0)
        part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(total.shape[1], 1)
        yield pd.DataFrame({"i": i, "j": j, **{k: total[s][i, j] for s, k in enumerate(["n", "x", "y", "xx", "yy", "xy"])}})


def _r_from_sums(n, x, y, xx, yy, xy):
    if not n or n < 2:
        return None
    vx, vy = xx - x * x / n, yy - y * y / n
    scale = math.sqrt(max(vx, 0.0)) * math.sqrt(max(vy, 0.0))
    if vx <= 1e-12 * xx or vy <= 1e-12 * yy or scale == 0.0:
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / scale))


def top_values(counted: DataFrame, k: int) -> DataFrame:
    """Top-k values per column. The rank filter is applied inside every task before the shuffle
    (window group limit), so a column of unique texts sends k rows per task, not all of them."""
    from pyspark.sql import Window as W

    value = F.coalesce(F.col("txt"), F.col("big").cast("string"), F.col("num").cast("string"))
    order = W.partitionBy("column").orderBy(F.col("cnt").desc(), F.col("value").asc())
    return (
        counted.select("column", value.alias("value"), "cnt")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def small_table(spark, rows: list, fields: list[tuple[str, str]]) -> DataFrame:
    """A driver-made table of facts (one row per column, pair or check)."""
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    return spark.createDataFrame(rows, schema).coalesce(1)


def as_facts(df_or_facts) -> Facts:
    return df_or_facts if isinstance(df_or_facts, Facts) else Facts(df_or_facts)
