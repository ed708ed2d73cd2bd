"""Shapley values of tree models, from a table of root-to-leaf paths.

A path is a leaf's value and, for each feature that it tests, the interval that leads
along the path and the share of training rows that go along at those tests. For a row, a
feature is either met or not; a leaf's worth under a set of known features is its value
times 1 or 0 for each known feature and the share for each other one. So the Shapley sums
over all sets of features are coefficients of a product of one factor a feature, and cost a
few operations for each pair of features of a path, not one for each set. Contributions of a row and
the base value add up to its prediction.

Paths are as many as the model has leaves and are broadcast; rows are read in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files

TOP = 25


@dataclass
class Path:
    """A leaf: its value, and for each tested feature the interval (low, high] and the share of rows that go along."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def path_of(value: float, tests: list[tuple[int, float, bool, float]]) -> Path:
    """A path from its tests: feature, threshold, whether the path goes left (at most the threshold), and the share that goes along."""
    found: dict[int, list[float]] = {}
    for feature, threshold, left, share in tests:
        held = found.setdefault(feature, [-math.inf, math.inf, 1.0])
        if left:
            held[1] = min(held[1], threshold)
        else:
            held[0] = max(held[0], threshold)
        held[2] *= share
    table = np.array([v for _, v in sorted(found.items())], float).reshape(-1, 3)
    return Path(value, np.array(sorted(found), int), *table.T)


def tree_paths(nodes: list[dict]) -> list[Path]:
    """Paths of a tree of numeric tests: nodes by ``id`` with children, feature, threshold, count and prediction."""
    by_id = {n["id"]: n for n in nodes}
    out, todo = [], [(0, [])]
    while todo:
        at, tests = todo.pop()
        n = by_id[at]
        if n["left"] < 0:
            out.append(path_of(n["prediction"], tests))
            continue
        for child, left in ((n["left"], True), (n["right"], False)):
            todo.append((child, [*tests, (n["feature"], n["threshold"], left, by_id[child]["count"] / n["count"])]))
    return out


def model_paths(fitted: PipelineModel, folder: str) -> list[Path]:
    """Paths of the forest or tree at a pipeline's end, read from the table that it is saved as; trees' values are averaged.

    Splits by category aren't intervals; a model with such splits is an error.
    """
    from pyspark.sql import SparkSession

    spark, model = SparkSession.getActiveSession(), fitted.stages[-1]
    if not files.exists(spark, folder):
        model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    rows = data.select("treeID", "id", "prediction", F.col("rawCount").cast("double").alias("count"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "split.numCategories")
    trees: dict[int, list[dict]] = {}
    for r in rows.collect():  # as many as the model has nodes
        if r["left"] >= 0 and r["numCategories"] >= 0:
            raise ValueError("a split by category")
        trees.setdefault(r["treeID"], []).append(r.asDict() | {"feature": r["featureIndex"]})
    weights = getattr(model, "treeWeights", [1.0] * len(trees))
    total = sum(weights) if "Forest" in type(model).__name__ else 1.0
    out = []
    for t, nodes in sorted(trees.items()):
        for p in tree_paths(nodes):
            p.value *= weights[t] / total
            out.append(p)
    return out


def base_value(paths: list[Path]) -> float:
    """The mean prediction over the training rows, as the paths' shares have it."""
    return float(sum(p.value * p.share.prod() for p in paths))


def contributions(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """Each row's contribution of each feature."""
    out = np.zeros(x.shape)
    for p in paths:
        d = len(p.features)
        part = x[:, p.features]
        met = ((part > p.low) & (part <= p.high)).astype(float)
        weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        for j in range(d):
            # coefficients by the number of known features of the product over all others
            sums = np.zeros((len(x), d))
            sums[:, 0] = 1.0
            for k in range(d):
                if k != j:
                    known = np.zeros_like(sums)
                    known[:, 1:] = sums[:, :-1] * met[:, [k]]
                    sums = sums * p.share[k] + known
            out[:, p.features[j]] += p.value * (met[:, j] - p.share[j]) * (sums @ weight)
    return out


def attribute(df: DataFrame, key: str, features: list[str], paths: list[Path]) -> DataFrame:
    """``key``, ``feature``, ``value`` and ``contribution``, one row for each row and feature; rows with a missing value are left out."""
    made = df.sparkSession.sparkContext.broadcast(paths)
    n = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                found = contributions(made.value, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["key", "x", "c"])

    kind = df.schema[key].dataType.simpleString()
    numbers = [F.col(c).cast("double") for c in features]
    whole = df.select(F.col(key).alias("key"), F.array(*numbers).alias("x")).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = whole.mapInArrow(run, f"key {kind}, x array<double>, c array<double>")
    cells = F.transform(F.arrays_zip("x", "c"), lambda v, i: F.struct(F.get(F.array(*[F.lit(f) for f in features]), i).alias("feature"), v["x"].alias("value"), v["c"].alias("contribution")))
    return rows.select(F.col("key").alias(key), F.inline(cells))


def summary(attributed: DataFrame, top: int = TOP) -> DataFrame:
    """The features with the largest mean absolute contribution, and how contributions move with values."""
    c, v = F.col("contribution"), F.col("value")
    table = attributed.groupBy("feature").agg(F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.when((F.var_pop(c) > 0) & (F.var_pop(v) > 0), F.corr(v, c)).alias("direction"))
    return table.orderBy(F.col("mean_abs").desc(), "feature").limit(top)
