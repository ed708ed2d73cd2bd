"""Rounds of the registered bootstrap."""

from __future__ import annotations

import inspect
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquery.operators import metrics
from lumiquery.plans import registry

DATA = "/root/testdata/sf0.001"


def test_bootstrap_ci_runs_500_rounds(spark, monkeypatch):
    signature, asked = inspect.signature(metrics.bootstrap), []

    def bootstrap(*args, real=metrics.bootstrap, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        asked.append(call.arguments["rounds"])
        return real(*args, **kwargs)

    monkeypatch.setattr(metrics, "bootstrap", bootstrap)
    assert registry.queries()["bootstrap_ci"](spark, DATA).count() > 0
    assert asked == [500]


def pairs(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        y = 400 + rnd.choice([rnd.random() * 300, 50.0, 50.0])
        rows.append((["a", "b", None][k % 3], y, y + rnd.gauss(0, 20), "x"))
    return rows


def medians_by_hand(rows, rounds, spark):
    """Weighted medians of each round, from all weights at once."""
    same = spark.createDataFrame([(y, p, 1) for _, y, p, _ in rows], "_y double, _p double, _c long").groupBy("_y", "_p").agg(F.sum("_c").alias("_c"))
    each = metrics.with_weights(same.withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))), 0)
    found = {}
    for r in each.collect():
        found.setdefault(r["_round"], []).append((abs(r["_y"] - r["_p"]), int(r["_w"])))
    return [statistics.median([e for e, w in sorted(v) for _ in range(w)]) for _, v in sorted(found.items())]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_metrics_in_any_partitions(spark, monkeypatch, parts):
    rows, rounds = pairs(600), 40
    d = spark.createDataFrame(rows, "model string, y double, p double, _part string")
    monkeypatch.setattr(metrics, "LEAST_PARTS", 3 * parts)
    got = {(r["model"], r["metric"]): tuple(r)[2:] for r in metrics.bootstrap_metrics(d.repartition(parts), ["model"], "y", "p", rounds).collect()}
    assert len(got) == 18 and all(v[3] == rounds and v[1] <= v[2] for v in got.values())
    for model in ("a", "b", None):
        own = [r for r in rows if r[0] == model]
        errors = [abs(p - y) for _, y, p, _ in own]
        ev = [abs(1240 / y - 1240 / p) for _, y, p, _ in own]
        mean = statistics.fmean(y for _, y, _, _ in own)
        want = {
            "mae": statistics.fmean(errors), "median_absolute_error": statistics.median(errors), "rmse": statistics.fmean(e * e for e in errors) ** 0.5, "mae_ev": statistics.fmean(ev),
            "rmse_ev": statistics.fmean(e * e for e in ev) ** 0.5, "r2": 1 - sum(e * e for e in errors) / sum((y - mean) ** 2 for _, y, _, _ in own),
        }
        assert all(abs(got[model, m][0] - v) < 1e-9 for m, v in want.items())
        drawn = medians_by_hand(own, rounds, spark)
        assert [round(x, 9) for x in got[model, "median_absolute_error"][1:3]] == [round(float(np.percentile(drawn, q)), 9) for q in (2.5, 97.5)]


def test_metrics_of_odd_samples(spark):
    rows = [("one", 500.0, 510.0), ("bad", 500.0, -1.0), ("bad", 510.0, 500.0), ("null", None, 1.0), ("same", 500.0, 500.0), ("same", 500.0, 500.0)]
    got = {(r["model"], r["metric"]): tuple(r)[2:] for r in metrics.bootstrap_metrics(spark.createDataFrame(rows, "model string, y double, p double"), ["model"], "y", "p", 30).collect()}
    assert {k for k, _ in got} == {"one", "bad", "same"}
    assert got["one", "r2"] == (None, None, None, 0) and got["one", "median_absolute_error"][0] == 10
    assert got["bad", "mae_ev"][0] is None and got["bad", "mae_ev"][3] < 30 and got["same", "mae"][:3] == (0, 0, 0)
    plain = metrics.bootstrap_metrics(spark.createDataFrame(rows[:1], "model string, y double, p double"), [], "y", "p", 10, wavelength=False).collect()
    assert len(plain) == 6 and all(r["usable"] == 0 for r in plain if r["metric"].endswith("_ev"))
