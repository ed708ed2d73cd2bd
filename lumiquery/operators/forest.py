"""Extremely randomized trees on all rows, grown level by level.

Equal rows are counted first, and weigh as many: columns of few values leave few rows, whatever
the table's size. A level is one aggregate: tasks walk their rows down the trees that exist so far, and sum,
for each open node and feature, the rows on the left of one random cut, their labels, and
the feature's range in the node. The driver sees one row for each open node and feature,
picks the best cut of each node, and broadcasts the grown trees; all trees of a level
grow in one job, unless their nodes and features exceed ``CELLS``, which deals the trees
to several.

A node draws its cuts from the ranges that its parent had, cut off at the parent's split. A node
whose cuts all miss its rows draws once more, from its own ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import Tree
from .ordering import cut

#: Rows of (node, feature) that a job sends to the driver at most.
CELLS = 400_000
#: Rows whose numbers a task holds at once, but at least an Arrow batch.
BLOCK_ROWS = 65_536
STATS = "tree int, node int, feature int, n long, s double, ss double, low double, high double, n_left long, s_left double"

#: Where in its range a feature is cut, from 0 to 1: of a tree, its node numbers, features and attempt.
Draw = Callable[[int, np.ndarray, int, int], np.ndarray]


def random_draw(seed: int) -> Draw:
    """Uniform numbers that only the seed, the tree, the node and the attempt decide."""
    return lambda tree, nodes, features, attempt: np.array([np.random.default_rng([seed, tree, int(n), attempt]).random(features) for n in nodes]).reshape(len(nodes), features)


class _Growing:
    """A tree while it grows: arrays of its nodes, and the ranges and attempts of those that are open."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0.0], [0], [0], [0.0]
        self.open: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {0: (low, high, 0, 0)}  # ranges, depth, attempt

    def tree(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right), np.array(self.value))

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1


def node_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, tree: Tree, nodes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over some weighted rows for the open nodes (sorted) that they reach: the node's place, and for each feature what ``STATS`` lists."""
    at = tree.leaves(x)
    place = np.searchsorted(nodes, at)
    rows = np.flatnonzero((place < len(nodes)) & (nodes[np.minimum(place, len(nodes) - 1)] == at))
    if not len(rows):
        return ()
    place = place.astype(np.uint16 if len(nodes) < 2**16 else np.int64)  # short numbers are sorted by their digits
    rows = rows[np.argsort(place[rows], kind="stable")]
    place = place[rows]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    part, label, w = x[rows], y[rows], weight[rows]
    is_left = part < cuts[place]
    total = lambda a: np.add.reduceat(a, first, axis=0)
    wy = w * label
    return place[first], total(w), total(wy), total(wy * label), np.minimum.reduceat(part, first), np.maximum.reduceat(part, first), total(is_left * w[:, None]), total(is_left * wy[:, None])


class _Sums:
    """What ``STATS`` lists of a tree's open nodes, over any number of blocks of rows."""

    def __init__(self, nodes: int, features: int) -> None:
        wide = (nodes, features)
        self.n, self.s, self.ss = np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes)
        self.low, self.high, self.n_left, self.s_left = np.full(wide, np.inf), np.full(wide, -np.inf), np.zeros(wide, np.int64), np.zeros(wide)

    def add(self, k: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray, low: np.ndarray, high: np.ndarray, n_left: np.ndarray, s_left: np.ndarray) -> None:
        for to, x in ((self.n, n), (self.s, s), (self.ss, ss), (self.n_left, n_left), (self.s_left, s_left)):
            to[k] += x
        self.low[k], self.high[k] = np.minimum(self.low[k], low), np.maximum(self.high[k], high)

    def rows(self, t: int, nodes: np.ndarray) -> pa.RecordBatch:
        met = np.flatnonzero(self.n)
        d = self.low.shape[1]
        wide = [np.full(len(met) * d, t, np.int32), np.repeat(nodes[met], d).astype(np.int32), np.tile(np.arange(d, dtype=np.int32), len(met))]
        wide += [np.repeat(c[met], d) for c in (self.n, self.s, self.ss)] + [c[met].ravel() for c in (self.low, self.high, self.n_left, self.s_left)]
        return pa.record_batch([pa.array(c) for c in wide], ["tree", "node", "feature", "n", "s", "ss", "low", "high", "n_left", "s_left"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of so many rows or a batch more as one block of numbers each, the first as a matrix."""
    held: list[pa.RecordBatch] = []

    def block() -> list[np.ndarray]:
        x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held])
        return [x, *(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(1, held[0].num_columns))]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield block()
            held = []
    if held:
        yield block()


def level_sums(data: DataFrame, trees: dict[int, tuple[Tree, np.ndarray, np.ndarray]]) -> DataFrame:
    """``STATS`` of some trees' open nodes over all rows of ``x`` (an array), ``y`` and the row's weight ``w``."""
    made = data.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: _Sums(*cuts.shape) for t, (_, _, cuts) in made.value.items()}
        for x, y, w in _blocks(batches, BLOCK_ROWS):
            for t, (tree, nodes, cuts) in made.value.items():
                if found := node_sums(x, y, w, tree, nodes, cuts):
                    sums[t].add(*found)
        for t, (_, nodes, _) in made.value.items():
            if sums[t].n.any():
                yield sums[t].rows(t, nodes)

    parts = data.select("x", "y", "w").mapInArrow(run, STATS)
    return parts.groupBy("tree", "node", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_left").alias("n_left"), F.sum("s_left").alias("s_left"))


def _split(grown: _Growing, node: int, stats: np.ndarray, cuts: np.ndarray, min_leaf: int, max_depth: int) -> None:
    """Close an open node: by its best cut, as a leaf, or open for one more attempt."""
    _, _, depth, attempt = grown.open.pop(node)
    n, s, ss = stats[0, 3:6]
    low, high, n_left, s_left = stats[:, 6], stats[:, 7], stats[:, 8], stats[:, 9]
    grown.value[node] = s / n
    if n < 2 * min_leaf or depth >= max_depth or ss - s * s / n <= 1e-12 * max(1.0, ss):
        return
    ok = (high > low) & (n_left >= min_leaf) & (n - n_left >= min_leaf)
    if not ok.any():
        if attempt == 0 and (high > low).any():
            grown.open[node] = (low, high, depth, 1)
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, s_left**2 / n_left + (s - s_left) ** 2 / (n - n_left), -np.inf)
    best = int(gain.argmax())
    at = float(cuts[best])
    grown.feature[node], grown.cut[node] = best, at
    left_high, right_low = high.copy(), low.copy()
    left_high[best], right_low[best] = min(at, high[best]), max(at, low[best])
    grown.left[node] = grown.add(s_left[best] / n_left[best])
    grown.right[node] = grown.add((s - s_left[best]) / (n - n_left[best]))
    if depth + 1 < max_depth:
        grown.open[grown.left[node]] = (low, left_high, depth + 1, 0)
        grown.open[grown.right[node]] = (right_low, high, depth + 1, 0)


def fit_extra_trees(df: DataFrame, features: list[str], label: str, trees: int = 100, min_leaf: int = 2, max_depth: int = 12, seed: int = 42, draw: Draw | None = None) -> list[Tree]:
    """Extra trees on all rows without missing values; ``learners.predict`` applies them.

    A tree has at most ``2 ** max_depth`` leaves, so trees are small whatever the rows.
    A task holds ``BLOCK_ROWS`` rows at once, and the sums of the open nodes. Without rows there
    are no trees.
    """
    draw = draw or random_draw(seed)
    numbers = [F.col(c).cast("double") for c in features]
    names = [f"_f{k}" for k in range(len(features))]
    rows = df.select(*[c.alias(n) for n, c in zip(names, numbers, strict=True)], F.col(label).cast("double").alias("y")).na.drop()
    data = cut(rows.groupBy(*names, "y").agg(F.count(F.lit(1)).alias("w")).select(F.array(*names).alias("x"), "y", "w"))
    ranges = data.select(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(len(features)) for f, name in ((F.min, "l"), (F.max, "h"))]).first()
    if ranges is None or ranges[0] is None:
        return []
    low, high = (np.array([ranges[f"{name}{k}"] for k in range(len(features))], float) for name in "lh")
    growing = [_Growing(low, high) for _ in range(trees)]
    while open_ := [t for t, g in enumerate(growing) if g.open]:
        todo: list[list[int]] = [[]]
        for t in open_:
            if todo[-1] and sum(len(growing[i].open) for i in [*todo[-1], t]) * len(features) > CELLS:
                todo.append([])
            todo[-1].append(t)
        for some in todo:
            asked = {}
            for t in some:
                nodes = np.array(sorted(growing[t].open))
                lows, highs, _, attempts = zip(*(growing[t].open[n] for n in nodes), strict=True)
                u = np.concatenate([draw(t, nodes[k : k + 1], len(features), attempts[k]) for k in range(len(nodes))])
                asked[t] = growing[t].tree(), nodes, np.array(lows) + (np.array(highs) - np.array(lows)) * u
            table = level_sums(data, asked).toPandas().sort_values(["tree", "node", "feature"]).to_numpy(float)
            starts = np.flatnonzero(np.r_[True, (table[1:, :2] != table[:-1, :2]).any(axis=1)]) if len(table) else []
            for first in starts:
                t, node = int(table[first, 0]), int(table[first, 1])
                cuts = asked[t][2][np.searchsorted(asked[t][1], node)]
                _split(growing[t], node, table[first : first + len(features)], cuts, min_leaf, max_depth)
    return [g.tree() for g in growing]


def node_table(trees: list[Tree]) -> list[tuple[int, int, int, float, float, float]]:
    """Inner nodes of trees: tree, node, feature, cut, and the values left and right of it."""
    return [(t, n, int(x.feature[n]), float(x.cut[n]), float(x.value[x.left[n]]), float(x.value[x.right[n]])) for t, x in enumerate(trees) for n in range(len(x.value)) if x.feature[n] >= 0]
