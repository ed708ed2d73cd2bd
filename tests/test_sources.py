"""Readers, writers, column resolution, jobs and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiquery.operators import dedup, joins, metrics, models, ordering, profile, splits
from lumiquery.sources import readers, writers
from lumiquery.streaming import jobs


def test_encodings(spark, tmp_path):
    for k, name in enumerate(("utf-8-sig", "utf-8", "cp1252")):
        p = tmp_path / f"{k}.csv"
        p.write_bytes("name;value\ncafé;1\n".encode(name))
        got = readers.read_csv(spark, str(p), sniff=True)
        assert got.columns == ["name", "value"] and got.first()["name"] == "café"


def test_ragged(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("a,b,notes\n1,2,x\n3,4,one, two\n5\n", encoding="utf-8")
    got = {tuple(r) for r in readers.read_csv_ragged(spark, str(p)).collect()}
    assert got == {("1", "2", "x"), ("3", "4", "one, two"), ("5", None, None)}


def test_optional(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    assert readers.read_csv_optional(spark, str(tmp_path / "none.csv"), schema).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert readers.read_csv_optional(spark, str(tmp_path / "e.csv"), schema).count() == 0
    (tmp_path / "a.csv").write_text("a\nx\n")
    assert readers.read_csv_optional(spark, str(tmp_path / "a.csv"), schema).first().asDict() == {"a": "x", "b": None}
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_discover_and_label(spark, tmp_path):
    for n in ("run_a.csv", "run_b.csv", "skip.csv"):
        (tmp_path / n).write_text("x\n1\n")
    found = readers.discover(str(tmp_path), "*.csv", ("skip*",))
    assert len(found) == 2
    assert {r["run_label"] for r in readers.read_labelled(spark, found).collect()} == {"run a", "run b"}
    with pytest.raises(FileNotFoundError):
        readers.discover(str(tmp_path), "*.nope")


def test_resolve():
    cols = ["Emission Max (nm)", "SMILES", "solvent"]
    assert readers.resolve_column(cols, ["smiles"]) is None
    assert readers.resolve_column(cols, ["smiles"], "casefold") == "SMILES"
    assert readers.resolve_column(cols, ["emission_max_nm"], "alnum") == "Emission Max (nm)"
    assert readers.resolve_column(cols, ["x"], keyword="emission") == "Emission Max (nm)"
    with pytest.raises(KeyError):
        readers.resolve_column(cols, ["x"], required=True)
    assert readers.sanitize_names(["a b", "a-b", "c"]) == ["a_b", "a_b_1", "c"]


def test_writers(spark, tmp_path):
    assert json.loads(writers.stable_json({"b": float("nan"), "a": [1.0]})) == {"a": [1.0], "b": None}
    table = writers.markdown_table(spark.createDataFrame([("x|y", 1.5)], "n string, v double"))
    assert table.splitlines()[-1] == "| x\\|y | 1.5 |"
    df = spark.createDataFrame([("t", "m", "s", 0, 1.0)], "target string, model string, split string, seed int, y double")
    writers.write_predictions(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("model = 'm'").count() == 1


def test_dedup(spark):
    rows = [("m", "s", 500.0, "Aggregate", 1), ("m", "s", 500.0, "Handbook", 2), ("m", "s", 510.0, "literature", 3), (None, "s", 1.0, "other", 4)]
    df = spark.createDataFrame(rows, "molecule string, solvent string, emission double, source_dataset string, ord int")
    kept = dedup.keep_source_preferred(df, ["molecule", "solvent", "emission"], [F.col("ord")])
    assert {(r["molecule"], r["emission"], r["source_dataset"]) for r in kept.collect()} == {("m", 500.0, "Handbook"), ("m", 510.0, "literature"), (None, 1.0, "other")}
    again = dedup.keep_source_preferred(kept, ["molecule", "solvent", "emission"], [F.col("ord")])
    assert again.count() == kept.count()
    r = dedup.replicates(df, ["molecule", "solvent"], F.col("emission"), ["emission"]).collect()
    assert [(x["n_rows"], x["n_distinct"]) for x in r] == [(3, 2)]


def test_fallback_fires_on_all_null(spark):
    dim = spark.createDataFrame([("k1", "water", None, 1), ("k2", "water", 80.1, 2), ("k3", "ethanol", 24.6, 3)], "key string, label string, d double, o int")
    df = spark.createDataFrame([("k1", "Water "), ("k3", "x"), ("k9", "none"), (None, "ETHANOL")], "key string, name string")
    got = {(r["key"], r["name"]): (r["d"], r["descriptor_match"]) for r in joins.two_step_join(df, dim.withColumnRenamed("key", "dk"), "key", F.col("name"), "dk", "label", ["d"], [F.col("o")]).collect()}
    assert got[("k1", "Water ")] == (None, "none")  # the first row of the label has no value either
    assert got[("k3", "x")] == (24.6, "canonical") and got[("k9", "none")] == (None, "none") and got[(None, "ETHANOL")] == (24.6, "label")


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 5.0, 4.0)], "g string, y double, p double")
    r = {x["g"]: x for x in df.groupBy("g").agg(*[v.alias(k) for k, v in metrics.regression(F.col("y"), F.col("p")).items()]).collect()}
    assert r["a"]["r2"] == 1 and r["a"]["mae"] == 0 and r["b"]["r2"] is None and r["b"]["mae"] == 1
    assert metrics.spearman(df, ["g"], "y", "p").filter("g = 'b'").first()["spearman"] == 0
    auc = spark.createDataFrame([("m", True, 0.9), ("m", False, 0.1), ("m", False, 0.9), ("n", True, 0.3)], "g string, a boolean, s double")
    assert {(x["g"], x["roc_auc"]) for x in metrics.roc_auc(auc, ["g"], F.col("a"), "s").collect()} == {("m", 0.75), ("n", None)}
    ci = metrics.bootstrap(df.filter("g = 'a'"), ["g"], "y", "p", rounds=50).first()
    assert ci["mae_low"] == ci["mae_high"] == 0


def test_noise(spark):
    rows = [("m", "s", q, "a") for q in (0.1, 0.2, 0.3, -0.1, 1.2)] + [("n", "s", 0.5, "b")]
    n = profile.noise_statistics(spark.createDataFrame(rows, "m string, s string, q double, src string"), ["m", "s"], "q", "src").collect()
    assert len(n) == 1 and n[0]["n"] == 3 and n[0]["iqr"] is None and n[0]["range"] == pytest.approx(0.2) and n[0]["std"] == pytest.approx(0.1)


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(70)], "id int, g string")
    s = splits.group_split(df, "g")
    assert joins.leakage(s, "g").first().asDict() == {"train_groups": 5, "test_groups": 2, "shared_groups": 0}
    three = splits.group_split_three(df, "g")
    assert three.count() == 70 and three.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split"] for r in three.collect()} == {"train", "val", "test"}
    assert splits.seeded_sample(df, [F.col("id")], 10).count() == 10


def test_models(spark):
    df = spark.createDataFrame([(i, f"g{i % 20}", float(i % 13), float(2 * (i % 13) + 1)) for i in range(200)], "id int, g string, x double, y double")
    fitted, out = models.train_target(df, ["x"], "y", "g", "rf", numTrees=5, seed=1)
    assert out.count() == 200 and models.feature_importance(fitted, ["x"])[0][0] == "x"
    assert models.train_target(df.limit(50), ["x"], "y", "g") is None
    import numpy as np

    x = np.linspace(-1, 1, 80)[:, None]
    assert np.abs(models.fit_mlp(x, 3 * x[:, 0])(x) - 3 * x[:, 0]).mean() < 0.2


def test_jobs(spark, tmp_path):
    lines = spark.createDataFrame([('{"job_id": "1", "molecule_smiles": "C", "solvent_smiles": "O", "model_choice": "all"}',), ('{"job_id": "2", "molecule_smiles": " "}',), ("broken",)], "value string")
    r = jobs.parse_requests(lines)
    code = F.coalesce("parse_error", jobs.error_code(["molecule_smiles", "solvent_smiles"], "model_choice", ["all"]))
    assert sorted((x["job_id"] or "", x["c"] or "") for x in r.select("job_id", code.alias("c")).collect()) == [("", "INVALID_INPUT"), ("1", ""), ("2", "INVALID_INPUT")]
    doc = json.loads(r.filter("job_id = '1'").select(jobs.response(F.col("job_id"), F.lit(None).cast("string"), F.array(F.lit(1.0))).alias("d")).first()["d"])
    assert doc == {"job_id": "1", "status": "completed", "predictions": [1.0]}
    batch = spark.createDataFrame([(1, "completed"), (1, "completed"), (2, "failed")], "id int, status string")
    for k in (0, 0, 1):  # a replayed batch and a repeated job change nothing
        jobs.upsert(spark, batch, str(tmp_path / "out"), k)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_state_machine(spark):
    df = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (1, "completed", 2), (2, "queued", 1)], "id int, status string, updated_at int")
    assert {(r["id"], r["status"]) for r in jobs.state_machine(df).collect()} == {(1, "completed"), (2, "queued")}


@pytest.mark.parametrize("one_task_rows", [10, 10_000])
def test_running_sum(spark, one_task_rows):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 5).alias("v"))
    got = sorted((r["k"], r["v"], r["before"]) for r in ordering.running_sum(df, [F.col("k").desc()], F.col("v"), one_task_rows=one_task_rows).collect())
    at = 0
    for _, v, before in reversed(got):
        assert before == at
        at += v


def test_more_sources_than_bits(spark):
    rows = [(f"k{k % 40}", f"src{k % 90:02d}", float(k % 3)) for k in range(720)] + [("k1", None, 1.0)]
    df = spark.createDataFrame(rows, "key string, source_dataset string, v double")
    want = {}
    for key, source, _ in rows:
        want.setdefault(key, set()).update([source] if source else [])
    got = {tuple(r) for r in dedup.overlap_by_sources(df, ["key"]).collect()}
    assert sum(r[1] for r in got) == 40 and {r[0] for r in got} == {"+".join(sorted(s)) for s in want.values()}
    again = {r["key"]: r["sources"] for r in dedup.replicates(df, ["key"], F.col("v"), ["v"]).collect()}
    assert again == {k: ",".join(sorted(s)) for k, s in want.items()}
    few = df.filter("source_dataset < 'src05' OR source_dataset IS NULL")
    assert {r["sources"] for r in dedup.overlap_by_sources(few, ["key"]).collect()} <= {"+".join(sorted(x for x in s if x < "src05")) for s in want.values()}


def test_alignment_tells_what_it_changed(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, x int, y int")
    out, added, dropped = readers.align(df, T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "c")]), F.lit(0))
    assert (out.first().asDict(), added, dropped) == ({"a": 0, "b": 1, "c": 0}, ["a", "c"], ["x", "y"])
