"""A fitted MLlib forest as flat arrays that score and explain whole batches of rows inside a task.

``predict`` walks all trees of a batch level by level. ``attribute`` gives exact Shapley values of the
trees: of a coalition of known features, a tree expects the mean of its leaves, each weighted by the
share of training rows that took an unknown feature's branches. A leaf with d different features on its
path is then a product game, whose Shapley values are an integral over t in [0, 1] of products of
``share * (1 - t) + met * t``: a polynomial of degree d - 1, which Gauss-Legendre quadrature with
(d + 1) / 2 points integrates exactly. No coalition is enumerated and no variant of a row leaves a task.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.sources.tables import shared_folder

CELLS = 1 << 20  # numbers of one intermediate array


class FlatForest:
    """Nodes of all trees, one after another; ``feature`` is -1 in leaves. ``value`` holds class
    probabilities (one column a class) or the prediction of a regression tree."""

    def __init__(self, tree, node, feature, threshold, left, right, value, weight, features: int):
        self.features, self.classes = features, value.shape[1]
        self.trees = int(tree.max()) + 1
        self.roots = np.searchsorted(tree, np.arange(self.trees))
        base = self.roots[tree]
        if not np.array_equal(node, np.arange(len(node)) - base):
            raise ValueError("nodes of a tree must be numbered from 0 without gaps")
        self.feature, self.threshold, self.value, self.weight = feature, threshold, value, weight
        self.left, self.right = np.where(feature < 0, 0, left + base), np.where(feature < 0, 0, right + base)
        self.uses = [{int(f) for f in feature[tree == t] if f >= 0} for t in range(self.trees)]
        self.depth, self.groups = self._paths()

    @classmethod
    def of(cls, model, features: int) -> FlatForest:
        """From a fitted RandomForest model with continuous features, by way of its saved form."""
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        n = F.col("nodeData")
        rows = spark.read.parquet(f"{path}/data").select(
            "treeID", n["id"].alias("id"), n["prediction"].alias("p"), n["impurityStats"].alias("s"), n["leftChild"].alias("l"), n["rightChild"].alias("r"),
            n["split"]["featureIndex"].alias("f"), n["split"]["leftCategoriesOrThreshold"].alias("t"), n["split"]["numCategories"].alias("c"),
        ).collect()
        rows.sort(key=lambda r: (r["treeID"], r["id"]))
        if any(r["c"] != -1 for r in rows if r["f"] >= 0):
            raise ValueError("only continuous features are supported")
        column = lambda name, kind: np.array([r[name] for r in rows], kind)
        stats = np.array([r["s"] for r in rows], float)
        if hasattr(model, "numClasses"):
            weight = stats.sum(axis=1)
            value = stats / weight[:, None]
        else:
            weight, value = stats[:, 0], column("p", float)[:, None]
        threshold = np.array([r["t"][0] if r["f"] >= 0 else 0.0 for r in rows])
        return cls(column("treeID", int), column("id", int), column("f", int), threshold, column("l", int), column("r", int), value, weight, features)

    def _paths(self):
        """Per leaf the different features of its path with their bounds (over, upto] and the share of rows
        that took the branches on that feature; leaves with equally many features are kept together."""
        found, deepest = defaultdict(list), 0
        for t in range(self.trees):
            pending = [(int(self.roots[t]), {}, 0)]
            while pending:
                at, path, depth = pending.pop()
                deepest = max(deepest, depth)
                f = int(self.feature[at])
                if f < 0:
                    if path:
                        found[len(path)].append((at, path))
                    continue
                over, upto, share = path.get(f, (-np.inf, np.inf, 1.0))
                cut = float(self.threshold[at])
                for child, bounds in ((self.left[at], (over, min(upto, cut))), (self.right[at], (max(over, cut), upto))):
                    pending.append((int(child), path | {f: (*bounds, share * self.weight[child] / self.weight[at])}, depth + 1))
        groups = []
        for d, leaves in sorted(found.items()):
            feature = np.array([list(p) for _, p in leaves])
            over, upto, share = (np.array([[b[i] for b in p.values()] for _, p in leaves]) for i in range(3))
            at, w = np.polynomial.legendre.leggauss((d + 1) // 2)
            groups.append((feature, over, upto, share, self.value[[i for i, _ in leaves]] / self.trees, (at + 1) / 2, w / 2))
        return deepest, groups

    def outputs(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """(rows, trees, classes) of the leaves that rows of ``x`` reach. NaN goes right, as in MLlib."""
        roots = self.roots if trees is None else self.roots[trees]
        at = np.repeat(roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            low = x[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
        return self.value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): mean output of the trees."""
        step = max(1, CELLS // (self.trees * self.classes))
        parts = [self.outputs(x[i : i + step]).mean(axis=1) for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.classes))

    def base(self) -> np.ndarray:
        """What the forest expects of a row of which nothing is known, one number a class."""
        out = np.zeros(self.classes)
        for t, root in enumerate(self.roots):
            end = self.roots[t + 1] if t + 1 < self.trees else len(self.feature)
            leaf = np.flatnonzero(self.feature[root:end] < 0) + root
            out += self.weight[leaf] @ self.value[leaf] / self.weight[leaf].sum()
        return out / self.trees

    def attribute(self, x: np.ndarray, classes: list[int] | None = None) -> np.ndarray:
        """(rows, features, classes) of Shapley values; they add up to ``predict - base``."""
        classes = list(range(self.classes)) if classes is None else classes
        out = np.zeros((len(x), self.features, len(classes)))
        for group in self.groups:
            d = group[0].shape[1]
            leaves = max(1, min(len(group[0]), CELLS // (64 * d)))
            rows = max(1, CELLS // (leaves * d))
            for a in range(0, len(group[0]), leaves):
                feature, over, upto, share, value = (g[a : a + leaves] for g in group[:5])
                order = np.argsort(feature.ravel(), kind="stable")
                which, starts = np.unique(feature.ravel()[order], return_index=True)
                table = self._table(share, group[5:]) if len(x) >= 2 ** d and (2 ** d) * d * len(feature) <= 4 * CELLS else None
                for b in range(0, len(x), rows):
                    v = x[b : b + rows][:, feature]
                    met = ~(v <= over) & ((v <= upto) | np.isposinf(upto))
                    if table is None:
                        total = self._shares(met, share, group[5:])
                    else:
                        total = table[np.arange(len(feature)), met @ (1 << np.arange(d))]
                    for i, k in enumerate(classes):
                        flat = (total * value[:, k][:, None]).reshape(len(v), -1)[:, order]
                        out[b : b + rows, which, i] += np.add.reduceat(flat, starts, axis=1)
        return out

    @staticmethod
    def _shares(met, share, points):
        """(..., leaves, d): what each feature of a path adds, for the features that are met."""
        total = np.zeros(met.shape)
        for t, w in zip(*points):
            factor = share * (1.0 - t) + met * t
            total += w * factor.prod(axis=-1, keepdims=True) / factor
        return total * (met - share)

    def _table(self, share, points):
        """(leaves, 2**d, d): ``_shares`` of every set of met features."""
        d = share.shape[1]
        sets = (np.arange(2 ** d)[:, None] >> np.arange(d)) & 1
        return self._shares(np.broadcast_to(sets[None] == 1, (len(share), 2 ** d, d)), share[:, None], points)

    def cells(self, x: np.ndarray):
        """(first, cell): rows between the same thresholds of every feature are one cell, which the trees
        cannot tell apart; the first row of each cell and the cell of each row."""
        code = np.zeros(x.shape, np.int32)
        for j in range(self.features):
            code[:, j] = np.searchsorted(np.unique(self.threshold[self.feature == j]), x[:, j])
        packed = np.ascontiguousarray(code).view(np.dtype((np.void, 4 * max(1, code.shape[1])))).ravel() if code.shape[1] else np.zeros(len(x), np.int8)
        _, first, cell = np.unique(packed, return_index=True, return_inverse=True)
        return first, cell


def explain_rows(df: DataFrame, forest: FlatForest, cols: list[str], key: str) -> DataFrame:
    """(key, output, base, values, inputs) per row: what the forest says of it, what it says of an unknown
    row, one Shapley value per column and the row's numbers.

    Two classes are explained by the probability of the second, a regression by its prediction; then
    the values add up to output - base. Of more classes the values are the mean size over all classes,
    output is the largest probability and base is null."""
    import pyarrow as pa

    many = forest.classes > 2
    classes = None if many else [forest.classes - 1]
    base = None if many else float(forest.base()[-1])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) if cols else np.zeros((batch.num_rows, 0))
            first, cell = forest.cells(x)
            shap = forest.attribute(x[first], classes)
            values = (np.abs(shap).mean(axis=2) if many else shap[:, :, 0])[cell]
            said = forest.predict(x[first])
            said = (said.max(axis=1) if many else said[:, -1])[cell]
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(said), pa.array([base] * len(x), pa.float64()), lists(values), lists(x)], names=[key, "output", "base", "values", "inputs"])

    slim = df.select(key, *cols)
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, output double, base double, values array<double>, inputs array<double>")


def permuted_scores(df: DataFrame, forest: FlatForest, cols: list[str], label: str, order: str, repeats: int, rows: int, block: int = 4096, seed: int = 42) -> DataFrame:
    """(feature, rep, n, hit, sse): right answers (classes) and squared error of the forest over ``df`` when
    the values of one column are shuffled; feature -1 is the table as it is, in rep 0.

    Rows are dealt by the hash text ``order`` into random blocks of about ``block`` rows, in one shuffle of
    the table whatever the number of columns and repeats; values are shuffled inside their block. Only
    trees that use the column are walked again, and only sums leave a task."""
    blocks = max(1, -(-rows // block))
    spot = F.conv(F.substring(F.md5(F.col(order)), 1, 8), 16, 10).cast("long") % blocks
    users = [np.array([t for t in range(forest.trees) if j in forest.uses[t]], int) for j in range(len(cols))]
    is_clf = forest.classes > 1

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        x, y = pdf[cols].to_numpy(float), pdf[label].to_numpy(float)
        rng = np.random.default_rng([seed, int(pdf["block"].iat[0])])
        each = forest.outputs(x)
        total, out = each.sum(axis=1), []

        def add(j, rep, said):
            guess = said.argmax(axis=1) if is_clf else said[:, 0] / forest.trees
            out.append((j, rep, len(y), int((guess == y).sum()), float(((guess - y) ** 2).sum())))

        add(-1, 0, total)
        for rep in range(repeats):
            donor = rng.permutation(len(y))
            for j, trees in enumerate(users):
                said = total
                if len(trees):
                    swapped, changed = x.copy(), each.copy()
                    swapped[:, j] = x[donor, j]
                    changed[:, trees] = forest.outputs(swapped, trees)
                    said = changed.sum(axis=1)
                add(j, rep, said)
        return pd.DataFrame(out, columns=["feature", "rep", "n", "hit", "sse"])

    slim = df.select(spot.alias("block"), order, label, *cols)
    parts = slim.groupBy("block").applyInPandas(run, "feature int, rep int, n long, hit long, sse double")
    return parts.groupBy("feature", "rep").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("sse").alias("sse"))
