"""Commands, stored models, experiments, reports and learners."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lumiquery import cli
from lumiquery.operators import artifacts, experiments, features, learners, models, reports
from lumiquery.sources import files, readers, writers

MOLECULES = ["C" * n + t for n in range(1, 10) for t in ("O", "N", "Cl", "Br", "F", "S", "I", "C#N", "c1ccccc1")]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = [(m, s, 300.0 + 5 * len(m) + 10 * k + rnd.random(), 0.5 + 0.01 * len(m), f"src{k % 2}") for m in MOLECULES for k, s in enumerate(("O", "CCO"))]
    path = str(tmp_path_factory.mktemp("data") / "rows.parquet")
    df = spark.createDataFrame(rows, "canonical_chromophore_smiles string, canonical_solvent_smiles string, emission_nm double, quantum_yield double, source_dataset string")
    df.write.parquet(path)
    return path


def test_train_predict_screen_and_job(spark, data, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["train", "--input", data, "--out-dir", out, "--n-bits", "64", "--trees", "5", "--model", "rf"], spark) == 0
    figures = json.loads(files.read_text(spark, f"{out}/metrics.json"))
    assert set(figures) == {"emission_nm", "quantum_yield"} and figures["emission_nm"]["test_rows"] > 10
    found = artifacts.discover(spark, [out, f"{out}/models", str(tmp_path / "none")])
    assert len(found) == 1
    assert cli.main(["predict", "--models", out, "--smiles", "OCC", "--output", f"{out}/p", "--known-emission", "300"], spark) == 0
    p = spark.read.option("header", True).csv(f"{out}/p/predictions").collect()
    assert len(p) == 1 and p[0]["molecule_smiles"] == "CCO" and 200 < float(p[0]["predicted_emission_nm"]) < 500
    assert spark.read.option("header", True).csv(f"{out}/p/disagreement").count() == 7
    cli.main(["generate-candidates", "--output", f"{out}/library.csv", "--scaffolds", "coumarin_7_substituted"], spark)
    assert cli.main(["screen", "--candidates", f"{out}/library.csv", "--models", out, "--references", data, "--target-emission", "350", "--output", f"{out}/s"], spark) == 0
    s = spark.read.option("header", True).csv(f"{out}/s")
    assert s.count() == 12 and {"score", "similarity", "outside_domain"} <= set(s.columns)
    cli.main(["summarize-screening", "--inputs", f"{out}/s", "--targets", "350", "--out", f"{out}/top", "--top-n", "3", "--markdown", f"{out}/top.md"], spark)
    assert [r["rank"] for r in spark.read.option("header", True).csv(f"{out}/top").collect()] == ["1", "2", "3"] and "# Candidates" in files.read_text(spark, f"{out}/top.md")


def request(**changes):
    return {"job_id": "j1", "user_id": "u", "molecule_smiles": "OCC", "solvent_smiles": "O", "model_choice": "all", "requested_at": "now"} | changes


def test_prediction_job_contract(spark, data, tmp_path):
    root = str(tmp_path / "models")
    cli.main(["train", "--input", data, "--out-dir", f"{root}/rf", "--n-bits", "32", "--trees", "3", "--targets", "emission_nm"], spark)
    files.write_text(spark, str(tmp_path / "in.json"), json.dumps(request()))
    assert cli.main(["prediction-job", "--input", str(tmp_path / "in.json"), "--output", str(tmp_path / "o.json"), "--models", root], spark) == 0
    answer = json.loads(files.read_text(spark, str(tmp_path / "o.json")))
    assert answer["status"] == "success" and answer["canonical_molecule_smiles"] == "CCO"
    assert [p["model_name"] for p in answer["predictions"]] == ["rf"] and answer["predictions"][0]["predicted_quantum_yield"] is None
    assert answer["warnings"] == [artifacts.unavailable(n) for n in ("extratrees", "gbdt", "histgb", "graph_model_later")]
    predict = artifacts.backend(spark, root)
    code = lambda job: artifacts.run_job(job, predict).get("error_code")
    assert code(request(model_choice="histgb")) == code(request(model_choice="graph_model_later")) == "MODEL_UNAVAILABLE"
    assert artifacts.run_job(request(), artifacts.backend(spark, str(tmp_path / "x")))["error_code"] == "PREDICTION_BACKEND_NOT_CONNECTED"
    assert code(request(model_choice="best")) == "INVALID_MODEL_CHOICE" and code(request(user_id=" ")) == code(None) == code([]) == "INVALID_INPUT"
    assert code(request(molecule_smiles="not one")) == "PREDICTION_JOB_FAILED"


def test_folders_are_found_once(spark, tmp_path):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(20)], "a double, y double")
    spec = features.fit(df, ["a"], n_bits=0)
    fitted = Pipeline(stages=[LinearRegression(featuresCol="features", labelCol="y")]).fit(features.matrix(df, spec))
    for run in ("one", "two"):
        artifacts.save({"emission_nm": fitted}, spec, str(tmp_path / "models" / run), spark, model=f"graph_gin_{run}", family="graph_neural")
    assert len(artifacts.discover(spark, [str(tmp_path / "outputs"), str(tmp_path / "models"), str(tmp_path / "models/one")])) == 2
    (tmp_path / "models" / "broken").mkdir()
    files.write_text(spark, str(tmp_path / "models/broken/feature_metadata.json"), "{}")
    (tmp_path / "models/broken/emission_nm/metadata").mkdir(parents=True)
    table, warnings = artifacts.predict_all(spark, [str(tmp_path / "models")], df.limit(3))
    assert table.count() == 6 and len(warnings) == 1 and "broken" in warnings[0]
    got = {r["subset"]: r["n"] for r in artifacts.disagreement(table).collect()}
    assert got["all_emission"] == got["graph_gin_emission"] == 6 and got["tree_neural_emission"] == got["graph_gcn_emission"] == 0
    (tmp_path / "models/one/feature_metadata.json").unlink()
    assert artifacts.load(spark, str(tmp_path / "models/one"))[2]["inferred"]


def test_experiments_go_on_after_failures(spark, data, tmp_path):
    out = str(tmp_path / "runs")
    assert cli.main(["run-experiments", "--input", data, "--out-dir", out, "--n-bits", "16", "--trees", "2", "--models", "rf,linear", "--splits", "random,molecule,scaffold", "--targets", "emission_nm,quantum_yield"], spark) == 0
    runs = experiments.recompute(spark, f"{out}/runs")
    assert runs.count() == 12 and runs.filter("test_rows > 0 AND mae IS NOT NULL").count() == 12
    df = spark.read.parquet(data).withColumn("k", F.xxhash64("canonical_chromophore_smiles", "canonical_solvent_smiles").cast("string")).withColumn("x", F.length("canonical_chromophore_smiles").cast("double")).withColumn("rare", F.lit(None).cast("double"))

    def broken(*_):
        raise RuntimeError("no memory")

    got, failures = experiments.run_matrix(df, ["x"], ["rare", "emission_nm"], {"bad": broken, "linear": experiments.mllib("linear")}, ["random"], [0, 1], "k", {}, str(tmp_path / "m"))
    assert got.count() == 2 and len(failures) == 3 and failures[0]["target"] == "rare" and "no memory" in failures[1]["error"]
    table, failed = experiments.sweep({"a": lambda: got, "b": lambda: broken()})
    assert table.count() == 2 and failed == {"b": "no memory"}
    assert cli.main(["paper-summary", "--runs", f"{out}/runs", "--output", str(tmp_path / "paper.md")], spark) == 0
    text = files.read_text(spark, str(tmp_path / "paper.md"))
    assert "## Emission models" in text and "For emission_nm, held-out scaffolds are" in text
    cli.main(["summarize-seeds", "--runs", f"{out}/runs", "--output", str(tmp_path / "seeds")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "seeds")).count() == 12


def test_metrics_documents(spark, tmp_path):
    for name, doc in (("b", {"quantum_yield": {"mae": 0.1, "r2": "x"}, "emission_nm": {"mae": 20, "rmse": 30.5, "train_rows": 5}}), ("a", {"emission_nm": {"mae": 25.0}, "lifetime_ns": {}})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps(doc))
    (tmp_path / "c").mkdir()
    t, warnings = experiments.collect_metrics(spark, str(tmp_path))
    assert [(r["target"], r["model"]) for r in t.collect()] == [("emission_nm", "b"), ("emission_nm", "a"), ("quantum_yield", "b"), ("lifetime_ns", "a")] and warnings == ["c: no metrics.json"]
    cli.main(["compare-models", "--a", str(tmp_path / "a/metrics.json"), "--b", str(tmp_path / "b/metrics.json"), "--output", str(tmp_path / "cmp")], spark)
    got = {r["target"]: r["better_mae"] for r in spark.read.option("header", True).csv(str(tmp_path / "cmp")).collect()}
    assert got == {"emission_nm": "b", "quantum_yield": "b", "lifetime_ns": "tie"}


def test_small_commands(spark, data, tmp_path, capsys):
    assert cli.main(["check-molecule", "--smiles", "OC", "--solvent", " o ", "--dataset", data, "--solvent-column", "canonical_solvent_smiles", "--out", str(tmp_path / "c")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"molecule_rows": 2, "exact_rows": 1}
    assert cli.main(["profile", "--input", data, "--out-dir", str(tmp_path / "p"), "--categories", "source_dataset"], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "p/numbers")).count() == 2
    assert cli.main(["yield-noise", "--input", data, "--out-dir", str(tmp_path / "n")], spark) == 0
    assert cli.main(["clean", "--input", data, "--output", str(tmp_path / "cl"), "--molecule", "canonical_chromophore_smiles", "--solvent", "canonical_solvent_smiles", "--values", "emission_nm"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == len(MOLECULES) * 2
    assert cli.main(["graph-tables", "--input", data, "--out-dir", str(tmp_path / "g")], spark) == 0 and spark.read.parquet(str(tmp_path / "g/edges")).count() > 0
    files.write_text(spark, str(tmp_path / "d.json"), "{}")
    assert cli.main(["duplicate-check-job", "--input", str(tmp_path / "d.json"), "--output", str(tmp_path / "d.out")], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["prepare", "--out-dir", str(tmp_path / "x")], spark)
    with pytest.raises(SystemExit):
        cli.main(["unknown"], spark)


def test_worker_command(spark, data, tmp_path, capsys):
    root = str(tmp_path / "models")
    cli.main(["train", "--input", data, "--out-dir", f"{root}/rf", "--n-bits", "16", "--trees", "2", "--targets", "emission_nm"], spark)
    spark.sql("SELECT id, 'u' AS user_id, 'CCO' AS molecule_smiles, 'O' AS solvent_smiles, 'rf' AS model_choice, 'queued' AS status, timestamp_seconds(id) AS created_at FROM range(3)").write.parquet(str(tmp_path / "q.parquet"))
    (tmp_path / "jobs").mkdir()
    args = ["worker", "--queue", str(tmp_path / "q.parquet"), "--jobs-dir", str(tmp_path / "jobs"), "--models", root, "--results", str(tmp_path / "res"), "--limit", "2", "--interval", "0", "--idle-exit", "1"]
    assert cli.main(args, spark) == 0
    done = json.loads(capsys.readouterr().out)
    assert (done["submitted"], done["collected"], done["errors"]) == (3, 3, 0)
    got = spark.read.parquet(str(tmp_path / "res"))
    assert {(r["job_id"], r["status"]) for r in got.collect()} == {("0", "success"), ("1", "success"), ("2", "success")}


def test_report_helpers(spark):
    assert [writers.number(x, s) for x, s in ((1.5, ".4f"), (1.5, ".4f0"), (0.000123456, ".3g"), (12345.678, ".4g"), (None, ".4f"), (float("nan"), ".4f"), (3, ".4f"), ("a|b", ".4f"))] == ["1.5000", "1.5", "0.000123", "1.235e+04", "", "", "3", "a\\|b"]
    t = writers.markdown_table(spark.range(5), rows=2)
    assert t.endswith("3 more rows are not shown.") and t.count("\n| ") == 3  # the rule and two rows
    audit = spark.createDataFrame([("rows", "b", "n", "7"), ("rows", "a", "m", "8")], "section string, source_dataset string, metric string, value string")
    row = reports.dataset_scale(audit, {"raw": ("rows", "n"), "none": ("x", "y")}, "this").first()
    assert (row["dataset_sources"], row["raw"], row["none"]) == ("a, b", "7", "not available")
    done = spark.createDataFrame([("g", "emission_nm", 5.0, 1.0, 4.0, 3)], "model string, target string, mae_mean double, mae_std double, mae_min double, seeds int")
    assert reports.graph_table(done).first().asDict() == {"model": "g", "seeds": 3, "emission_mae_mean": 5.0, "emission_mae_std": 1.0, "best_seed_mae": 4.0, "yield_mae": None}
    with pytest.raises(ValueError, match="mae"):
        reports.graph_table(done.drop("mae_mean"))


def test_column_helpers(spark, tmp_path):
    assert readers.split_list(" a, ,b,") == ["a", "b"] and readers.strip_affixes("pred_x.csv", "pred_", ".csv") == "x"
    assert readers.reorder(["_t", "score", "name", "z", "tmp"], ["name", "q"], ["score"], ("tmp",)) == ["name", "z", "score"]
    assert readers.property_columns(["id", "Emission max", "x", "PLQY"], ("id",)) == ["id", "Emission max", "PLQY"]
    df = spark.range(10, numPartitions=3).withColumn("v", F.col("id") * 2)
    assert readers.insert_first(df, tag=F.lit("t"), v=F.lit(1)).columns == ["tag", "v", "id"]
    assert [(r["id"], r["row_index"]) for r in readers.with_ordinal(df).orderBy("row_index").collect()] == [(k, k) for k in range(10)]
    (tmp_path / "a").mkdir()
    for n in ("x.csv", "skip.csv", "y.txt"):
        (tmp_path / "a" / n).write_text("a\n1\n")
    assert [p.rsplit("/", 1)[1] for p in readers.discover(str(tmp_path), "*.csv", ("skip*",), spark)] == ["x.csv"]
    assert readers.first_existing(None, str(tmp_path / "no"), str(tmp_path / "a"), spark=spark).endswith("/a")


def test_learners(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = 4 * np.sin(x[:, 0]) + (x[:, 1] > 0) * 3 + rng.normal(0, 0.1, 800)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").repartition(5)
    trees = learners.fit_extra_trees(df, ["a", "b", "c"], "y", ["id"], trees=20)
    again = learners.fit_extra_trees(df.repartition(2), ["a", "b", "c"], "y", ["id"], trees=20)
    got = learners.predict(df.unionByName(spark.createDataFrame([(9999, None, 1.0, 1.0, 0.0)], df.schema)), ["a", "b", "c"], trees)
    mae = got.filter("id < 9999").agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert mae < 0.6 and got.filter("id = 9999").first()["prediction"] is None
    assert all((a.cut == b.cut).all() for a, b in zip(trees, again, strict=True))
    line = 2 * x[:, 0] - x[:, 2] + 5
    assert np.abs(learners.svr(x, line)(x) - line).mean() < 0.4
    stopped = learners.fit_mlp(x, y, val=0.2, patience=15, steps=400, loss="smooth_l1", alpha=1e-3, dropout=0.05)
    assert np.abs(stopped(x) - y).mean() < 1.0
    f, chosen = learners.fit_mlp_grid(x, y, sizes=((4,), (16, 8)), alphas=(1e-4,), steps=80)
    assert chosen["hidden"] in ((4,), (16, 8)) and f(x).shape == (800,)
    base, top = models.stack(df, ["a", "b"], "y", "id", ("rf", "linear"), 2, {"rf": {"numTrees": 5, "seed": 1}})
    assert models.predict_stack(base, top, df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 2
    best = models.random_search(df, ["a", "b"], "y", tries=2, folds=2)
    assert best.transform(df).count() == 800
    labelled = df.withColumn("bright", (F.col("b") > 0).cast("double"))
    done = models.perceptron_classifier(["a", "b", "c"], "bright", (4,), maxIter=60).fit(labelled).transform(labelled)
    assert done.filter("prediction = bright").count() > 700
    assert models.optional_backend("xgboost")[0] is None or models.optional_backend("xgboost")[1] == ""
