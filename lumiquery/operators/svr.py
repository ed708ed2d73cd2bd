"""Linear support vector regression on all rows.

Errors up to epsilon are free, larger ones count linearly, and weights are squared. Rows
stay in blocks of standardized numbers where they are; a step is one job that sums the
blocks' losses and subgradients in a tree, and only those sums reach the driver.
Steps are scaled by the subgradients so far, and the result is the average of the later half of
the iterates, which converges where single iterates go to and fro.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import cut

BLOCK_ROWS = 8_192


@dataclass
class LinearSVR:
    """Weights over standardized features; ``learners.predict`` applies it."""

    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float
    objective: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows."""
        return (((x - self.mean) / self.std) @ self.weights[:-1] + self.weights[-1]) * self.y_std + self.y_mean


def loss_sums(weights: np.ndarray, z: np.ndarray, t: np.ndarray, epsilon: float) -> np.ndarray:
    """Sum of the losses of some rows, then of their subgradients."""
    e = z @ weights[:-1] + weights[-1] - t
    sign = np.where(np.abs(e) > epsilon, np.sign(e), 0.0)
    return np.concatenate([[np.maximum(np.abs(e) - epsilon, 0).sum()], sign @ z, [sign.sum()]])


def descend(sums, n: int, width: int, c: float, steps: int, rate: float) -> tuple[np.ndarray, float]:  # noqa: ANN001
    """Weights and objective, from a function that gives the sums at some weights."""
    squares, weights, mean, taken = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), 0

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = sums(w)
        inner = np.append(w[:-1], 0)
        return 0.5 * inner @ inner / (c * n) + s[0] / n, s[1:] / n + inner / (c * n)

    best, least = weights, float("inf")
    for step in range(1, steps + 1):
        value, grad = objective(weights)
        if value < least:
            best, least = weights.copy(), value
        squares += grad * grad
        weights = weights - rate / step**0.25 * grad / np.sqrt(squares + 1e-12)
        if 2 * step > steps:
            taken += 1
            mean += (weights - mean) / taken
    value, _ = objective(mean)
    return (mean, value) if value < least else (best, least)


def fit(df: DataFrame, features: list[str], label: str, epsilon: float = 0.1, c: float = 1.0, steps: int = 150, rate: float = 0.5) -> LinearSVR:
    """Fit on all rows without missing values; ``epsilon`` is in deviations of the target, ``c`` weighs a row's loss."""
    numbers = [F.col(k).cast("double") for k in features]
    names = [*(f"_x{k}" for k in range(len(features))), "_y"]
    rows = cut(df.select(*[v.alias(k) for k, v in zip(names, [*numbers, F.col(label).cast("double")], strict=True)]).na.drop())
    stats = rows.agg(F.count(F.lit(1)), *[f(k) for k in names for f in (F.avg, F.stddev_pop)]).first()
    n = stats[0]
    if not n:
        raise ValueError("no rows to train on")
    mean, std = np.array(stats[1::2], float), np.array([s if s > 0 else 1.0 for s in stats[2::2]], float)

    def blocks(part: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple] = []
        for r in part:
            held.append(tuple(r))
            if len(held) >= BLOCK_ROWS:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def block(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        z = (np.array(held, float) - mean) / std
        return z[:, :-1], z[:, -1]

    data = rows.rdd.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    zero = np.zeros(len(features) + 2)
    try:
        sums = lambda w: data.treeAggregate(zero, lambda a, b: a + loss_sums(w, *b, epsilon), lambda a, b: a + b)
        weights, value = descend(sums, n, len(features), c, steps, rate)
    finally:
        data.unpersist()
    return LinearSVR(weights, mean[:-1], std[:-1], float(mean[-1]), float(std[-1]), float(value))
