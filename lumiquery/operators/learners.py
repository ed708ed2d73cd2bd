"""Regressors that MLlib lacks, in NumPy: extra trees, linear support vector regression, a multilayer perceptron.

Each is fitted on a bounded sample (``sample_rows``): the trees in Spark tasks, one tree a
row, the others on the driver. Predictions run in Arrow batches over all rows with the
fitted model as a broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import seeded_sample

#: Rows that a learner is fitted on at most.
MAX_ROWS = 50_000


def sample_rows(df: DataFrame, features: list[str], label: str, key: list[str], rows: int = MAX_ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a reproducible sample without missing values."""
    some = seeded_sample(df.select(*key, *features, label).na.drop(subset=[*features, label]), [F.col(k) for k in key], rows, seed)
    data = some.select(*features, label).toPandas().to_numpy(float)
    return data[:, :-1], data[:, -1]


@dataclass
class Tree:
    """A regression tree in arrays: feature (below zero in a leaf), cut, children and value of each node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values of the leaves that the rows reach."""
        return self.value[self.leaves(x)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaves that the rows reach."""
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = np.where(x[i, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
        return at


def grow(x: np.ndarray, y: np.ndarray, seed: int, min_leaf: int = 2, max_depth: int = 30) -> Tree:
    """An extremely randomized tree on all rows: each feature gets one cut at random, the best of them splits."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    todo = [(np.arange(len(y)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here, v = len(nodes), y[rows]
        nodes.append([-1, 0.0, 0, 0, float(v.mean()) if len(v) else 0.0])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if len(rows) < 2 * min_leaf or depth >= max_depth or v.min() == v.max():
            continue
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        cuts = low + (high - low) * rng.random(x.shape[1])
        is_left = part < cuts
        n = is_left.sum(axis=0)
        total = v @ is_left
        ok = (high > low) & (n >= min_leaf) & (len(v) - n >= min_leaf)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, total**2 / n + (v.sum() - total) ** 2 / (len(v) - n), -np.inf)
        best = int(gain.argmax())
        nodes[here][0], nodes[here][1] = best, float(cuts[best])
        todo += [(rows[~is_left[:, best]], depth + 1, here, 1), (rows[is_left[:, best]], depth + 1, here, 0)]
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def fit_extra_trees(df: DataFrame, features: list[str], label: str, key: list[str], trees: int = 100, min_leaf: int = 2, max_depth: int = 30, rows: int = MAX_ROWS, seed: int = 42) -> list[Tree]:
    """Extra trees: each grown in a task of its own on the broadcast sample."""
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(sample_rows(df, features, label, key, rows, seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tree": b["id"], "model": [pickle.dumps(grow(*data.value, seed * 100_003 + int(k), min_leaf, max_depth)) for k in b["id"]]})

    parts = min(trees, max(1, spark.sparkContext.defaultParallelism))
    grown = spark.range(0, trees, 1, parts).mapInPandas(run, "tree long, model binary").orderBy("tree").collect()
    return [pickle.loads(bytes(r["model"])) for r in grown]  # noqa: S301  its own trees


def svr(x: np.ndarray, y: np.ndarray, epsilon: float = 0.1, c: float = 1.0, steps: int = 400, rate: float = 0.05) -> Callable[[np.ndarray], np.ndarray]:
    """Linear support vector regression: errors up to epsilon (in deviations of y) are free, larger ones linear, weights squared."""
    mean, std, ym, ys = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1), y.mean(), y.std() or 1.0
    z, t = np.hstack([(x - mean) / std, np.ones((len(x), 1))]), (y - ym) / ys
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, steps + 1):
        e = z @ w - t
        g = c * (np.where(np.abs(e) > epsilon, np.sign(e), 0) @ z) / len(t) + np.append(w[:-1], 0) / len(t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / step**0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return lambda q: np.hstack([(q - mean) / std, np.ones((len(q), 1))]) @ w * ys + ym


def fit_mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (32, 16), steps: int = 300, rate: float = 0.01, seed: int = 0, alpha: float = 0.0, val: float = 0.0, patience: int = 20, dropout: float = 0.0, loss: str = "squared") -> Callable[[np.ndarray], np.ndarray]:
    """A multilayer perceptron regressor on standardized inputs, by Adam with decoupled weight decay ``alpha``.

    With a validation share it stops when the mean absolute error there hasn't improved for
    ``patience`` steps, and the best weights are restored. ``loss`` is squared or smooth_l1.
    """
    rng = np.random.default_rng(seed)
    held = rng.random(len(x)) < val if val else np.zeros(len(x), bool)
    if held.all() or (val and not held.any()):
        held[:] = False
    xt, yt = x[~held], y[~held]
    mean, std, ym, ys = xt.mean(0), np.where(xt.std(0) > 0, xt.std(0), 1), yt.mean(), yt.std() or 1.0
    sizes = [x.shape[1], *hidden, 1]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def forward(z: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        out = [z]
        for k in range(0, len(params), 2):
            z = out[-1] @ params[k] + params[k + 1]
            if k + 2 < len(params):
                z = np.maximum(z, 0)
                if masks is not None:
                    masks.append((rng.random(z.shape) >= dropout) / (1 - dropout))
                    z = z * masks[-1]
            out.append(z)
        return out

    z, t = (xt - mean) / std, ((yt - ym) / ys)[:, None]
    zv, best, since, kept = (x[held] - mean) / std, np.inf, 0, None
    for step in range(1, steps + 1):
        masks: list[np.ndarray] | None = [] if dropout else None
        acts = forward(z, masks)
        e = acts[-1] - t
        grad, grads = (np.clip(e, -1, 1) if loss == "smooth_l1" else 2 * e) / len(t), [None] * len(params)
        for k in range(len(params) - 2, -1, -2):
            grads[k], grads[k + 1] = acts[k // 2].T @ grad, grad.sum(0)
            grad = (grad @ params[k].T) * (acts[k // 2] > 0)
            if masks and k >= 2:
                grad = grad * masks[k // 2 - 1]
        for p, g, m in zip(params, grads, moments, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            p -= rate * ((m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + alpha * p)
        if held.any():
            mae = np.abs(forward(zv)[-1][:, 0] * ys + ym - y[held]).mean()
            best, since, kept = (mae, 0, [p.copy() for p in params]) if mae < best else (best, since + 1, kept)
            if since >= patience:
                break
    if kept is not None:
        for p, k in zip(params, kept, strict=True):
            p[:] = k
    return lambda q: forward((q - mean) / std)[-1][:, 0] * ys + ym


def fit_mlp_grid(x: np.ndarray, y: np.ndarray, sizes: tuple[tuple[int, ...], ...] = ((32,), (32, 16), (64, 32)), alphas: tuple[float, ...] = (1e-4, 1e-3, 1e-2), seed: int = 0, **options) -> tuple[Callable[[np.ndarray], np.ndarray], dict]:  # noqa: ANN003
    """The best of several sizes and decays by validation error, and what it was."""
    rng = np.random.default_rng(seed + 1)
    test = rng.random(len(x)) < 0.2
    best = None
    for hidden in sizes:
        for alpha in alphas:
            f = fit_mlp(x[~test], y[~test], hidden, seed=seed, alpha=alpha, **options)
            mae = float(np.abs(f(x[test]) - y[test]).mean())
            if best is None or mae < best[1]["val_mae"]:
                best = (f, {"hidden": hidden, "alpha": alpha, "val_mae": mae})
    return best


def predict(df: DataFrame, features: list[str], model: Callable[[np.ndarray], np.ndarray] | list[Tree], out: str = "prediction") -> DataFrame:
    """Add predictions of a fitted learner; null where a feature is missing."""
    from pyspark import cloudpickle

    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = pickle.loads(packed.value)  # noqa: S301  the model that was just packed
        for column in batches:
            x = np.array([[np.nan if v is None else v for v in row] for row in column], float).reshape(-1, len(features))
            ok = np.isfinite(x).all(axis=1)
            y = np.full(len(x), np.nan)
            if ok.any():
                y[ok] = np.mean([t.predict(x[ok]) for t in f], axis=0) if isinstance(f, list) else f(x[ok])
            yield pd.Series(y).where(ok, None)

    return df.withColumn(out, run(F.array(*[F.col(c).cast("double") for c in features])))
