"""Tuning with early rejection: successive halving over nested samples.

All settings are tried on a small sample of the training rows, the better ones on a larger
one that holds the smaller, and so on to all rows. Samples, and the rows that errors are
measured on, are decided by the hash of a key. Trials of a rung run as parallel jobs. Each
trial's error is a small document in a folder, so a search that was lost goes on with the
trials that it has not finished.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import models
from .ordering import cut
from .splits import hash_unit

#: Of each rung one setting in so many goes on; a rung has so many times the rows of the one before.
ETA = 3

#: Fits a setting on some rows and gives its predictions on others, in ``prediction``.
Fit = Callable[[dict, DataFrame, DataFrame], DataFrame]


def forest_fit(features: list[str], label: str, seed: int = 42) -> Fit:
    """Random forests of MLlib by their parameters."""
    return lambda setting, train, test: models.build(features, label, "rf", seed=seed, **setting).fit(train).transform(test)


def rungs(n: int, eta: int = ETA) -> list[tuple[int, float]]:
    """How many settings each rung has, and what share of the rows."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(max(1, sizes[-1] // eta))
    return [(size, float(eta) ** -(len(sizes) - 1 - k)) for k, size in enumerate(sizes)]


def successive_halving(df: DataFrame, label: str, key: str, settings: list[dict], fit: Fit, eta: int = ETA, val: float = 0.2, seed: int = 42, parallel: int = 4, folder: str | None = None) -> tuple[dict, DataFrame]:
    """The best setting, and all trials: ``rung``, ``setting`` (a number), ``share``, ``train_rows`` and ``mae``.

    Of equal errors the setting listed first wins. A setting whose fit fails has no error and doesn't go on.
    """
    spark = df.sparkSession
    rows = cut(df.filter(F.col(label).isNotNull()).withColumns({"_part": hash_unit(F.col(key), seed), "_val": hash_unit(F.col(key), seed + 1) < val}))
    test, trials, alive = rows.filter("_val"), [], list(range(len(settings)))

    def trial(rung: int, share: float, k: int) -> dict:
        at = f"{folder}/rung={rung}/setting={k}.json" if folder else None
        if at and files.exists(spark, at):
            return json.loads(files.read_text(spark, at))
        train = rows.filter(~F.col("_val") & (F.col("_part") < share))
        found = {"rung": rung, "setting": k, "share": share, "train_rows": train.count(), "mae": None}
        try:
            found["mae"] = fit(settings[k], train, test).agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]
        except Exception as e:  # recorded, and the others go on
            found["error"] = str(e).splitlines()[0][:300]
        if at:
            files.write_text(spark, at, json.dumps(found))
        return found

    for rung, (size, share) in enumerate(rungs(len(settings), eta)):
        alive = alive[:size]
        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(lambda k, r=rung, s=share: trial(r, s, k), alive))
        trials += done
        alive = [t["setting"] for t in sorted((t for t in done if t["mae"] is not None), key=lambda t: (t["mae"], t["setting"]))]
        if not alive:
            raise RuntimeError("no setting could be fitted")
    table = spark.createDataFrame([(t["rung"], t["setting"], t["share"], t["train_rows"], t["mae"]) for t in trials], "rung int, setting int, share double, train_rows long, mae double")
    return settings[alive[0]], table
