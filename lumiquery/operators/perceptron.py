"""A multilayer perceptron trained by many tasks on all rows.

Tasks of a barrier stage hold a part of the rows each and the same weights. For each batch
they sum the gradients of their own rows, exchange the sums (``allGather``), and take the
same step, so the weights agree everywhere and don't depend on the number of tasks: which
batch a row belongs to, and whether it is held out, is decided by the hash of its key.
After each epoch the held-out error is exchanged too; training stops when it hasn't
improved for ``patience`` epochs, and the best weights are kept.

A stage runs ``EPOCHS_A_STAGE`` epochs and returns the state of the training, a few times
the weights. It is written to a folder, if one is given, and a training that was lost
goes on from there; a task that is lost makes Spark repeat the stage from its begin.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .ordering import cut
from .splits import hash_unit

EPOCHS_A_STAGE = 10


@dataclass
class State:
    """A training between two epochs: weights, moments of the steps, the best weights and their error."""

    weights: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0
    epoch: int = 0
    best: list[np.ndarray] | None = None
    best_error: float = float("inf")
    stale: int = 0
    history: list[float] = field(default_factory=list)


@dataclass
class Perceptron:
    """Fitted weights with the scales of features and target; ``learners.predict`` applies it."""

    weights: list[np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float
    history: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows."""
        return forward(self.weights, (x - self.mean) / self.std)[-1][:, 0] * self.y_std + self.y_mean


def start_state(sizes: list[int], seed: int) -> State:
    """Random weights for layers of these sizes."""
    rng = np.random.default_rng(seed)
    weights = [w for a, b in zip(sizes, sizes[1:], strict=False) for w in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    return State(weights, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights])


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Inputs and outputs of all layers."""
    out = [x]
    for k in range(0, len(weights), 2):
        z = out[-1] @ weights[k] + weights[k + 1]
        out.append(np.maximum(z, 0) if k + 2 < len(weights) else z)
    return out


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sums over rows of the gradients of the smooth absolute error (quadratic below 1)."""
    acts = forward(weights, x)
    grad = np.clip(acts[-1] - y[:, None], -1, 1)
    out: list[np.ndarray] = [np.empty(0)] * len(weights)
    for k in range(len(weights) - 2, -1, -2):
        out[k], out[k + 1] = acts[k // 2].T @ grad, grad.sum(axis=0)
        grad = (grad @ weights[k].T) * (acts[k // 2] > 0)
    return out


def take_step(state: State, grads: list[np.ndarray], rate: float, decay: float) -> None:
    """One step of Adam with decoupled weight decay."""
    state.step += 1
    for w, g, a, b in zip(state.weights, grads, state.first, state.second, strict=True):
        a *= 0.9
        a += 0.1 * g
        b *= 0.999
        b += 0.001 * g * g
        w -= rate * ((a / (1 - 0.9**state.step)) / (np.sqrt(b / (1 - 0.999**state.step)) + 1e-8) + decay * w)


def _packed(arrays: list[np.ndarray]) -> str:
    return base64.b64encode(np.concatenate([a.ravel() for a in arrays]).tobytes()).decode()


def _summed(texts: list[str], like: list[np.ndarray]) -> list[np.ndarray]:
    total = np.sum([np.frombuffer(base64.b64decode(t)) for t in texts], axis=0)
    ends = np.cumsum([a.size for a in like])
    return [p.reshape(a.shape) for p, a in zip(np.split(total, ends[:-1]), like, strict=True)]


def _train(rows: Iterator, state: State, epochs: int, batches: int, rate: float, decay: float, patience: int, seed: int) -> Iterator[bytes]:
    """What a task does in a stage: rows are (key hash, held out, features, target), scaled."""
    context = BarrierTaskContext.get()
    held = list(rows)
    width = state.weights[0].shape[0]
    keys = np.array([r[0] for r in held], np.int64).astype(np.uint64)
    out = np.array([r[1] for r in held], bool)
    x, y = np.array([r[2] for r in held], float).reshape(len(held), width), np.array([r[3] for r in held], float)
    for _ in range(epochs):
        # which batch a row is in changes with the epoch, and is the same wherever the row is
        mixed = (keys ^ np.uint64((seed * 1_000_003 + state.epoch) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        batch = ((mixed >> np.uint64(33)) % np.uint64(batches)).astype(np.int64)
        for b in range(batches):
            mine = np.flatnonzero((batch == b) & ~out)
            grads = gradients(state.weights, x[mine], y[mine]) if len(mine) else [np.zeros_like(w) for w in state.weights]
            *grads, n = _summed(context.allGather(_packed([*grads, np.array([float(len(mine))])])), [*state.weights, np.zeros(1)])
            if n[0]:
                take_step(state, [g / n[0] for g in grads], rate, decay)
        state.epoch += 1
        errors = np.abs(forward(state.weights, x[out])[-1][:, 0] - y[out]).sum() if out.any() else 0.0
        total = np.sum([json.loads(t) for t in context.allGather(json.dumps([float(errors), int(out.sum())]))], axis=0)
        if not total[1]:
            continue
        error = float(total[0] / total[1])
        state.history.append(error)
        if error < state.best_error:
            state.best, state.best_error, state.stale = [w.copy() for w in state.weights], error, 0
        else:
            state.stale += 1
            if state.stale >= patience:
                break
    if context.partitionId() == 0:
        yield pickle.dumps(state)


def _saved(spark, folder: str | None) -> State | None:  # noqa: ANN001
    if not folder or not files.exists(spark, f"{folder}/state"):
        return None
    return pickle.loads(base64.b64decode(files.read_text(spark, f"{folder}/state")))  # noqa: S301  its own state


def fit(df: DataFrame, features: list[str], label: str, key: str, hidden: tuple[int, ...] = (64, 32), epochs: int = 200, batch_rows: int = 16_384, rate: float = 1e-3, decay: float = 1e-2, val: float = 0.1, patience: int = 20, seed: int = 0, tasks: int | None = None, folder: str | None = None) -> Perceptron:
    """Train on all rows without missing values; ``key`` decides which rows are held out and in which batch a row is.

    An exchange of a stage takes about a second whatever is exchanged, so batches are large
    and few. The tasks of the stage run at once, so there are at most as many as the cluster has
    slots, and together they hold the rows in memory. Errors in ``history`` are in
    deviations of the target. With a ``folder`` a training goes on where it was lost.
    """
    spark = df.sparkSession
    numbers = [F.col(c).cast("double") for c in features]
    rows = df.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("_k"), (hash_unit(F.col(key), seed + 17) < val).alias("_out"), *[c.alias(f"_x{k}") for k, c in enumerate(numbers)], F.col(label).cast("double").alias("_y")).na.drop()
    rows = cut(rows)
    names = [*(f"_x{k}" for k in range(len(features))), "_y"]
    stats = rows.filter("NOT _out").agg(F.count(F.lit(1)), *[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    if not stats[0]:
        raise ValueError("no rows to train on")
    mean, std = np.array(stats[1::2], float), np.array([s if s and s > 0 else 1.0 for s in stats[2::2]], float)
    scaled = F.array(*[(F.col(c) - float(m)) / float(s) for c, m, s in zip(names[:-1], mean, std, strict=False)])
    data = rows.select("_k", "_out", scaled, (F.col("_y") - float(mean[-1])) / float(std[-1]))
    slots = tasks or spark.sparkContext.defaultParallelism
    data = data.repartition(slots, "_k").rdd.map(tuple)
    batches = max(1, round(stats[0] / batch_rows))
    state = _saved(spark, folder) or start_state([len(features), *hidden, 1], seed)
    while state.epoch < epochs and state.stale < patience:
        now, some = state, min(EPOCHS_A_STAGE, epochs - state.epoch)
        done = data.barrier().mapPartitions(lambda part: _train(part, now, some, batches, rate, decay, patience, seed)).collect()
        state = pickle.loads(done[0])  # noqa: S301  its own state
        if folder:
            files.write_text(spark, f"{folder}/state", base64.b64encode(done[0]).decode())
    return Perceptron(state.best or state.weights, mean[:-1], std[:-1], float(mean[-1]), float(std[-1]), state.history)
