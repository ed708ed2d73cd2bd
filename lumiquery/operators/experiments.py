"""Experiment loops: models x targets x splits x seeds, with failures recorded and everything else going on."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..sources import files
from . import metrics, models, splits

#: Order of the targets in a comparison; others follow.
TARGET_ORDER = ("emission_nm", "quantum_yield")
SCHEMA = "target string, model string, split string, seed int, train_rows long, test_rows long, mae double, rmse double, r2 double"

Fit = Callable[[DataFrame, DataFrame, list[str], str, int], DataFrame]


def mllib(kind: str, **options) -> Fit:  # noqa: ANN003
    """A fit of one MLlib regressor: training rows in, test rows with ``prediction`` out."""
    return lambda train, test, features, target, seed: models.build(features, target, kind, **({"seed": seed} if kind != "linear" else {}), **options).fit(train).transform(test).drop("_features")


def split_rows(df: DataFrame, how: str, key: str, groups: dict[str, str], seed: int) -> DataFrame:
    """Rows by hash (``random``), or by the group column of that name."""
    return splits.random_split(df, F.col(key), 0.2, seed) if how == "random" else splits.group_split(df, groups[how], 0.2, seed)


def run_matrix(df: DataFrame, features: list[str], targets: list[str], fits: dict[str, Fit], hows: list[str], seeds: list[int], key: str, groups: dict[str, str], path: str, min_rows: int = models.MIN_ROWS) -> tuple[DataFrame, list[dict]]:
    """Fit every combination, write its test predictions below ``path`` (partitioned by it), and give all metrics and the failures.

    A combination with too few rows or a failing fit is recorded, and the others go on.
    """
    spark, failures = df.sparkSession, []
    for target in targets:
        rows = df.filter(F.col(target).isNotNull())
        if rows.limit(min_rows).count() < min_rows:
            failures.append({"target": target, "error": f"fewer than {min_rows} rows"})
            continue
        for how in hows:
            for seed in seeds:
                parted = split_rows(rows, how, key, groups, seed)
                train, test = parted.filter("split = 'train'"), parted.filter("split = 'test'")
                n_train = train.count()
                for name, fit in fits.items():
                    try:
                        done = fit(train, test, features, target, seed)
                        out = done.select(F.col(key).cast("string").alias("row_key"), F.col(target).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"), F.lit(n_train).alias("train_rows"))
                        out.write.mode("overwrite").parquet(f"{path}/target={target}/model={name}/split={how}/seed={seed}")
                    except Exception as e:  # one failing run doesn't stop the sweep
                        failures.append({"target": target, "model": name, "split": how, "seed": seed, "error": str(e).splitlines()[0][:300]})
    return recompute(spark, path), failures


def saved_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All saved predictions as one long table; an error if there are none."""
    if not files.find(spark, path, "part-*"):
        raise FileNotFoundError(f"no predictions below {path}")
    return spark.read.option("basePath", path).parquet(path)


def recompute(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of each run from the saved predictions alone."""
    if not files.exists(spark, path) or not files.find(spark, path, "part-*"):
        return spark.createDataFrame([], SCHEMA)
    r = metrics.regression(F.col("y_true"), F.col("y_pred"))
    out = saved_predictions(spark, path).groupBy("target", "model", "split", F.col("seed").cast("int").alias("seed")).agg(F.max("train_rows").alias("train_rows"), F.count(F.lit(1)).alias("test_rows"), *[v.alias(k) for k, v in r.items()])
    return out.select("target", "model", "split", "seed", "train_rows", "test_rows", "mae", "rmse", "r2")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Mean error by wavelength region of the saved emission predictions."""
    p = saved_predictions(spark, path).filter("target = 'emission_nm'").withColumn("region", bins.MANUSCRIPT.label(F.col("y_true")))
    return p.groupBy("split", "model", "seed", "region").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


def collect_metrics(spark: SparkSession, path: str, name: str = "metrics.json") -> tuple[DataFrame, list[str]]:
    """One row for each target of each model folder's metrics document, and a warning for each folder without one."""
    rows, warnings = [], []
    for folder in [n for n in files.names(spark, path) if not n.startswith((".", "_"))]:
        at = f"{path}/{folder}/{name}"
        if not files.exists(spark, at):
            warnings.append(f"{folder}: no {name}")
            continue
        for target, values in json.loads(files.read_text(spark, at)).items():
            if isinstance(values, dict):
                number = lambda k, values=values: float(values[k]) if isinstance(values.get(k), (int, float)) else None
                rows.append((folder, target, number("mae"), number("rmse"), number("r2"), values.get("train_rows"), values.get("test_rows")))
    return ordered(spark.createDataFrame(rows, "model string, target string, mae double, rmse double, r2 double, train_rows long, test_rows long")), warnings


def ordered(table: DataFrame) -> DataFrame:
    """Emission first, then quantum yield, then other targets; within them the smallest error first."""
    rank = reduce(lambda c, x: F.when(F.col("target") == x[1], x[0]).otherwise(c), list(enumerate(TARGET_ORDER))[::-1], F.lit(len(TARGET_ORDER)))
    return table.orderBy(rank, "target", F.col("mae").asc_nulls_last(), "model")


def sweep(runs: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Run each model family; a failing one is recorded with its message."""
    parts, failed = [], {}
    for name, run in runs.items():
        try:
            parts.append(run().withColumn("family", F.lit(name)))
        except Exception as e:  # recorded, and the next family runs
            failed[name] = str(e).splitlines()[0][:300]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None), failed
