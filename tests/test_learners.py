"""Extra trees and a perceptron on all rows, against one machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquery.operators import forest, learners, perceptron

NAMES = ["a", "b", "c"]


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 4 * np.sin(x[:, 0]) + (x[:, 1] > 0) * 3 + rng.normal(0, 0.1, n)
    rows = [(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


def test_trees_on_all_rows_match_one_machine(spark):
    df, x, y = table(spark, 3_000)
    test, tx, ty = table(spark, 1_000, 1)
    trees = forest.fit_extra_trees(df.repartition(5), NAMES, "y", trees=30, max_depth=8)
    alone = [learners.grow(x, y, 1_000 + k, 2, 8) for k in range(30)]
    mae = lambda ts: np.abs(np.mean([t.predict(tx) for t in ts], axis=0) - ty).mean()
    assert abs(mae(trees) / mae(alone) - 1) < 0.08 and mae(trees) < mae([learners.grow(x, y, 5, 2, 8)])
    # each row of the sample reaches a leaf of its own side, leaves hold the means of their rows and enough of them
    for t in trees[:3]:
        at = t.leaves(x)
        for leaf in np.unique(at):
            assert (at == leaf).sum() >= 2 and abs(t.value[leaf] - y[at == leaf].mean()) < 1e-9
    got = learners.predict(test, NAMES, trees).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert abs(got - mae(trees)) < 1e-9


def test_trees_in_any_partitions_and_jobs(spark, monkeypatch):
    df, _, _ = table(spark, 400)
    one = forest.fit_extra_trees(df.coalesce(1), NAMES, "y", trees=6, max_depth=5)
    monkeypatch.setattr(forest, "CELLS", 30)
    many = forest.fit_extra_trees(df.repartition(7), NAMES, "y", trees=6, max_depth=5)
    for a, b in zip(one, many, strict=True):
        assert (a.feature == b.feature).all() and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_trees_hold_few_rows_of_a_partition(spark, monkeypatch):
    df, _, _ = table(spark, 2_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    before = forest.fit_extra_trees(df.coalesce(1), NAMES, "y", trees=2, max_depth=4)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 200, raising=False)
    sums, most = forest.node_sums, 300

    def few(x, *more):  # tasks take it along, so a larger block fails them
        assert len(x) <= most, f"{len(x)} rows at once"
        return sums(x, *more)

    monkeypatch.setattr(forest, "node_sums", few)
    try:
        after = forest.fit_extra_trees(df.coalesce(1), NAMES, "y", trees=2, max_depth=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(before, after, strict=True):
        assert (a.feature == b.feature).all() and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_trees_count_equal_rows_once(spark, monkeypatch):
    few, x, y = table(spark, 500)
    many = few.unionAll(few).unionAll(few.filter("id % 3 = 0")).repartition(4)
    sums = forest.level_sums
    seen = []
    monkeypatch.setattr(forest, "level_sums", lambda data, trees: seen.append(data.count()) or sums(data, trees))
    trees = forest.fit_extra_trees(many, NAMES, "y", trees=2, max_depth=4)
    assert seen and max(seen) == 500
    weight = 2 + (np.arange(500) % 3 == 0)
    for t in trees:
        at = t.leaves(x)
        for leaf in np.unique(at):
            assert abs(t.value[leaf] - np.average(y[at == leaf], weights=weight[at == leaf])) < 1e-9
    # as many rows as a leaf must have may be one row that stands for them
    pair = spark.createDataFrame([(0.0, 1.0)] * 2 + [(1.0, 5.0)] * 2, "a double, y double")
    assert [sorted(t.value) for t in forest.fit_extra_trees(pair, ["a"], "y", trees=1)] == [[1.0, 3.0, 5.0]]


def test_trees_of_odd_tables(spark):
    schema = "a double, b double, y double"
    rows = [(1.0, None, 5.0), (2.0, 1.0, None), (1.0, 1.0, 3.0), (1.0, 1.0, 5.0), (1.0, 1.0, 4.0)]
    same = forest.fit_extra_trees(spark.createDataFrame(rows, schema), ["a", "b"], "y", trees=2)
    assert all(len(t.value) == 1 and abs(t.value[0] - 4) < 1e-12 for t in same)
    assert forest.fit_extra_trees(spark.createDataFrame(rows[:2], schema), ["a", "b"], "y", trees=2) == []
    far = [(float(k), 0.0, float(k > 5)) for k in range(12)] + [(1e12, 0.0, 1.0)]
    trees = forest.fit_extra_trees(spark.createDataFrame(far, schema), ["a", "b"], "y", trees=5, min_leaf=1, max_depth=4)
    assert any(len(t.value) > 3 for t in trees)  # cuts that miss the rows are drawn again


def test_weights_do_not_depend_on_the_number_of_tasks(spark):
    df, x, y = table(spark, 600)
    fitted = [perceptron.fit(df.repartition(3), NAMES, "y", "id", (8, 4), epochs=2, batch_rows=200, tasks=n, rate=1e-2) for n in (1, 4)]
    assert all(np.abs(a - b).max() < 1e-6 for a, b in zip(fitted[0].weights, fitted[1].weights, strict=True))
    assert np.allclose(fitted[0].history, fitted[1].history) and len(fitted[0].history) == 2


def test_perceptron_learns_stops_and_goes_on(spark, tmp_path, monkeypatch):
    df, x, y = table(spark, 1_500)
    monkeypatch.setattr(perceptron, "EPOCHS_A_STAGE", 5)
    model = perceptron.fit(df, NAMES, "y", "id", (16, 8), epochs=8, batch_rows=700, rate=5e-2, decay=1e-4, tasks=3, folder=str(tmp_path / "m"))
    assert np.abs(model(x) - y).mean() < 2.2 and model.history[-1] < model.history[0]
    assert learners.predict(df, NAMES, model).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 2.2
    # a training that was lost after its last stage goes on from there, and does nothing once it is over
    again = perceptron.fit(df, NAMES, "y", "id", (16, 8), epochs=8, batch_rows=700, rate=5e-2, decay=1e-4, tasks=3, folder=str(tmp_path / "m"))
    assert again.history == model.history and all((a == b).all() for a, b in zip(again.weights, model.weights, strict=True))
    stopped = perceptron.fit(df, NAMES, "y", "id", (4,), epochs=20, batch_rows=2_000, rate=0.0, patience=3, tasks=2)
    assert len(stopped.history) == 4  # the first is the best, three more don't improve it
    with pytest.raises(ValueError):
        perceptron.fit(df.limit(0), NAMES, "y", "id", epochs=1)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    state = perceptron.start_state([3, 5, 4, 1], 2)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20) * 2

    def loss():
        e = np.abs(perceptron.forward(state.weights, x)[-1][:, 0] - y)
        return np.where(e < 1, 0.5 * e * e, e - 0.5).sum()

    for w, g in zip(state.weights, perceptron.gradients(state.weights, x, y), strict=True):
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_support_vector_regression_on_all_rows(spark):
    from lumiquery.operators import svr

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)) * [1, 20, 0.1]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + 5 + rng.standard_t(2, 900)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(4)
    model = svr.fit(df, NAMES, "y", steps=80)
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    _, long = svr.descend(lambda w: svr.loss_sums(w, z, t, 0.1), 900, 3, 1.0, 20_000, 0.5)
    assert long <= model.objective * (1 + 1e-9) and model.objective < 1.01 * long
    assert abs(model(x).mean() - (2 * x[:, 0] - 0.3 * x[:, 1] + 5).mean()) < 0.3
    got = learners.predict(df, NAMES, model).agg(F.avg("prediction")).first()[0]
    assert abs(got - model(x).mean()) < 1e-9
    with pytest.raises(ValueError):
        svr.fit(df.limit(0), NAMES, "y")


def forest_of(spark, tmp_path, trees=3, depth=4):
    from lumiquery.operators import models

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) * 2 + rng.normal(0, 0.1, 400)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")
    return df, x, names, models.build(names, "y", "rf", numTrees=trees, maxDepth=depth, seed=1).fit(df)


def shapley_by_sets(paths, row):
    """Contributions from the worth of every set of known features."""
    from itertools import combinations
    from math import factorial

    n = len(row)

    def worth(known):
        total = 0.0
        for p in paths:
            w = p.value
            for f, low, high, share in zip(p.features, p.low, p.high, p.share, strict=True):
                w *= float(low < row[f] <= high) if f in known else share
            total += w
        return total

    out = np.zeros(n)
    for j in range(n):
        others = [k for k in range(n) if k != j]
        for size in range(n):
            for s in combinations(others, size):
                out[j] += factorial(size) * factorial(n - size - 1) / factorial(n) * (worth({*s, j}) - worth(set(s)))
    return out


def test_shapley_values_of_a_forest(spark, tmp_path):
    from lumiquery.operators import attribution

    df, x, names, fitted = forest_of(spark, tmp_path)
    paths = attribution.model_paths(fitted, str(tmp_path / "m"))
    found = attribution.contributions(paths, x)
    want = np.array([r["prediction"] for r in fitted.transform(df).orderBy("id").collect()])
    assert np.abs(found.sum(axis=1) + attribution.base_value(paths) - want).max() < 1e-9
    for k in range(0, 400, 40):
        assert np.abs(found[k] - shapley_by_sets(paths, x[k])).max() < 1e-9
    more = df.unionByName(spark.createDataFrame([(9_999, None, 1.0, 1.0, 1.0, 0.0)], df.schema))
    rows = attribution.attribute(more, "id", names, paths).collect()
    assert len(rows) == 1_600 and all(abs(r["contribution"] - found[r["id"], names.index(r["feature"])]) < 1e-9 for r in rows)
    table = attribution.summary(attribution.attribute(df, "id", names, paths), 2).collect()
    assert table[0]["feature"] == "a" and table[0]["direction"] > 0.5 and len(table) == 2


def test_successive_halving(spark, tmp_path):
    from lumiquery.operators import tuning

    df, x, _ = table(spark, 900)
    asked = []

    def fit(setting, train, test):
        asked.append(setting["c"])
        if setting["c"] == 7:
            raise ValueError("no such setting")
        mean = train.agg(F.avg("y")).first()[0]
        return test.withColumn("prediction", F.lit(mean) + setting["c"] * F.col("a"))

    settings = [{"c": c} for c in (-3, 7, 0, 9, 2.5, 1, 5, -1, 4)]
    best, trials = tuning.successive_halving(df, "y", "id", settings, fit, folder=str(tmp_path / "t"))
    rows = trials.collect()
    full = {k: r for k, r in ((s["c"], None) for s in settings)}
    errors = {c: df.filter("id >= 0").agg(F.avg(F.abs(F.col("y") - (F.lit(df.agg(F.avg("y")).first()[0]) + c * F.col("a"))))).first()[0] for c in full if c != 7}
    assert best["c"] == min(errors, key=errors.get) == 2.5
    assert [r["rung"] for r in rows].count(0) == 9 and [r["rung"] for r in rows].count(1) == 3 and len(rows) == 13
    whole = max(r["train_rows"] for r in rows)
    assert sum(r["train_rows"] for r in rows) < 0.4 * 9 * whole
    n = len(asked)
    again, _ = tuning.successive_halving(df, "y", "id", settings, fit, folder=str(tmp_path / "t"))
    assert again == best and len(asked) == n  # what was finished isn't done again
    assert tuning.rungs(1) == [(1, 1.0)] and tuning.rungs(9) == [(9, 1 / 9), (3, 1 / 3), (1, 1.0)]
