"""Second-order boosted regression trees, grown best leaf first on binned features.

Rows are binned once and carry their prediction. For each new leaf the sums of
gradients and rows by (leaf, feature, bin) are grouped aggregates over all rows, made
in part inside the tasks; a leaf's sibling is its parent less itself, so only the
smaller child of a split is ever counted. Splits maximise the second-order gain under
an L2 penalty; the best leaf of the whole tree is split next, up to a number of leaves.
What the driver holds has the size of leaves x features x bins, whatever the rows.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

#: Trees after which rows get their new prediction written down.
REFRESH = 10


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` -1 marks a leaf. A row goes left where its bin is at most ``cut``."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
        return self.left[node], self.right[node]

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` (rows x features)."""
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            goes = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)


@dataclass
class BoostedTrees:
    columns: tuple
    edges: list
    base: float
    trees: list

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(values), 0), np.uint8)

    def score(self, bins: np.ndarray, trees=None) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees if trees is None else trees:
            out += np.asarray(tree.value)[tree.leaves_of(bins)]
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; missing features go where the lowest bin goes."""
        model, names, n = self, df.columns, len(df.columns)

        def run(batches):
            for batch in batches:
                values = np.stack([np.asarray(batch.column(n + i).cast(pa.float64()).fill_null(-np.inf)) for i in range(len(model.columns))], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(model.base + model.score(model.binned(values)))], [*names, out])

        rows = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").cast("double").alias(f"__f{i}") for i, c in enumerate(self.columns)])
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
        return rows.mapInArrow(run, f"{kinds}, `{out}` double")


def best_split(g: np.ndarray, n: np.ndarray, l2: float, least: int):
    """(gain, feature, cut) of a leaf from its sums by (feature, bin); gain 0 where no split helps. Ties take the first feature and cut."""
    total_g, total_n = g[0].sum(), n[0].sum()
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    right_g, right_n = total_g - left_g, total_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_n + l2) + right_g ** 2 / (right_n + l2) - total_g ** 2 / (total_n + l2)
    gain = np.where((left_n >= least) & (right_n >= least), gain / 2, -np.inf)
    if not gain.size or not gain.max() > 1e-12:
        return 0.0, -1, 0
    feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut)


def histograms(rows: DataFrame, model: BoostedTrees, fresh: list, tree: Tree, wanted: list, width: int) -> dict:
    """Sums of gradients and rows by feature and bin of the ``wanted`` leaves: one grouped pass."""
    number = {node: i for i, node in enumerate(wanted)}
    features = len(model.columns)

    def run(batches):
        g, n = np.zeros((len(wanted), features, width)), np.zeros((len(wanted), features, width), np.int64)
        place = np.full(len(tree.feature), -1)
        place[list(number)] = list(number.values())
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), features)
            slope = np.asarray(batch.column(1)) + model.score(bins, fresh) - np.asarray(batch.column(2))
            leaf = place[tree.leaves_of(bins)]
            bins, slope, leaf = bins[leaf >= 0], slope[leaf >= 0], leaf[leaf >= 0]
            for f in range(features):
                cell = leaf * width + bins[:, f]
                g[:, f] += np.bincount(cell, slope, len(wanted) * width).reshape(len(wanted), width)
                n[:, f] += np.bincount(cell, minlength=len(wanted) * width).reshape(len(wanted), width)
        leaf, feature, at = np.nonzero(n)
        if len(leaf):
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(feature, pa.int32()), pa.array(at, pa.int32()), pa.array(g[leaf, feature, at]), pa.array(n[leaf, feature, at], pa.int64())], ["leaf", "feature", "bin", "g", "n"])

    parts = rows.select("bins", "at", "y").mapInArrow(run, "leaf int, feature int, bin int, g double, n long")
    sums = parts.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    leaf, feature, at = (np.asarray(sums.column(c)) for c in ("leaf", "feature", "bin"))
    g, n = np.zeros((len(wanted), features, width)), np.zeros((len(wanted), features, width))
    g[leaf, feature, at], n[leaf, feature, at] = np.asarray(sums.column("g")), np.asarray(sums.column("n"))
    return {node: (g[i], n[i]) for node, i in number.items()}


def grow(counted, leaves: int, l2: float, least: int, rate: float) -> Tree:
    """One tree, best leaf first. ``counted(tree, nodes)`` gives the sums of new leaves.

    Splits are tried ahead of their turn, all open leaves at once, so a tree costs about as many
    passes as it has levels; only those whose turn comes before the last leaf stay.
    """
    tree = Tree()
    sums = counted(tree, [0])
    choice = {0: best_split(*sums[0], l2, least)}
    while True:
        # walk the best-first order as far as it is known
        open_, order = [0], []
        while len(open_) < leaves:
            node = max(open_, key=lambda k: (choice[k][0], -k))
            if choice[node][0] <= 0:
                break
            order.append(node)
            if tree.feature[node] < 0:
                break
            open_.remove(node)
            open_ += [tree.left[node], tree.right[node]]
        if not order or tree.feature[order[-1]] >= 0:
            break
        ahead = [k for k in sorted(open_, key=lambda k: -choice[k][0]) if choice[k][0] > 0 and tree.feature[k] < 0][:leaves - len(open_)]
        small = []
        for node in ahead:
            _, feature, cut = choice[node]
            pair = tree.split(node, feature, cut)
            left_n = sums[node][1][feature][:cut + 1].sum()
            small.append((node, *(pair if 2 * left_n <= sums[node][1][feature].sum() else pair[::-1])))
        found = counted(tree, [less for _, less, _ in small])
        for node, less, more in small:
            sums[less], sums[more] = found[less], (sums[node][0] - found[less][0], sums[node][1] - found[less][1])
            for k in (less, more):
                choice[k] = best_split(*sums[k], l2, least)
    stays = set(order)
    out = Tree()
    todo = [(0, 0)]
    while todo:
        node, at = todo.pop()
        if node in stays:
            a, b = out.split(at, tree.feature[node], tree.cut[node])
            todo += [(tree.left[node], a), (tree.right[node], b)]
        else:
            g, n = sums[node][0][0].sum(), sums[node][1][0].sum()
            out.value[at] = float(-rate * g / (n + l2)) if n + l2 > 0 else 0.0
    return out


def fit_boosted(df: DataFrame, columns, label: str, steps: int = 200, rate: float = 0.05, leaves: int = 31, l2: float = 1.0, least: int = 20, bins: int = 64) -> BoostedTrees:
    """Least-squares boosting of ``label`` on numeric ``columns``; rows without a label are left out.

    Bins are cut at approximate quantiles of each column (``bins`` of them at most, one row to the
    driver). Passes a tree: about its depth; every ``REFRESH`` trees rows are written with
    their prediction, so no pass scores more trees than that.
    """
    columns = tuple(columns)
    known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns)])
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = known.agg(F.avg("y").alias("base"), *[F.percentile_approx(f"__f{i}", cuts, F.lit(20 * bins)).alias(f"e{i}") for i in range(len(columns))]).first()
    model = BoostedTrees(columns, [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(columns))], row["base"] or 0.0, [])
    width = max([len(e) + 1 for e in model.edges], default=1)

    def start(batches):
        for batch in batches:
            values = np.stack([np.asarray(batch.column(1 + i).fill_null(-np.inf)) for i in range(len(columns))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in model.binned(values)], pa.binary()), pa.array(np.full(len(batch), model.base)), batch.column(0)], ["bins", "at", "y"])

    def refreshed(fresh):
        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), len(columns))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(batch.column(1)) + model.score(codes, fresh)), batch.column(2)], ["bins", "at", "y"])
        return run

    schema = "bins binary, at double, y double"
    rows, fresh = known.mapInArrow(start, schema).persist(StorageLevel.DISK_ONLY), []
    for _ in range(steps):
        # a plain copy of what tasks need: the trees so far stay on the driver
        shell = BoostedTrees(columns, model.edges, model.base, [])
        tree = grow(lambda t, nodes: histograms(rows, shell, fresh, t, nodes, width), leaves, l2, least, rate)
        model.trees.append(tree)
        fresh = fresh + [tree]
        if len(fresh) == REFRESH:
            later = rows.mapInArrow(refreshed(fresh), schema).persist(StorageLevel.DISK_ONLY)
            later.count()
            rows.unpersist()
            rows, fresh = later, []
    rows.unpersist()
    return model
