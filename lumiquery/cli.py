"""Command line: one command for each job of the engine. ``python -m lumiquery <command> --help`` lists its options.

Tables are CSV or Parquet by their ending; outputs are folders of part files, small
documents are JSON or Markdown.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bins, smiles
from .operators import artifacts, chemistry, dedup, diagnose, duplicate_check, experiments, features, joins, learners, metrics, models, neighbours, perceptron, profile, reports, screening, solvents, standardize
from .session import get_session
from .sources import files, readers, writers

Run = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Run, list[tuple[str, dict]]]] = {}


def command(name: str, *options: tuple[str, dict]) -> Callable[[Run], Run]:
    """Register a command with its options."""

    def add(f: Run) -> Run:
        COMMANDS[name] = (f, list(options))
        return f

    return add


def opt(name: str, default: object = None, kind: type = str, required: bool = False, many: bool = False, flag: bool = False) -> tuple[str, dict]:
    """One option of a command."""
    if flag:
        return name, {"action": "store_true"}
    return name, {"type": kind, "required": required, "default": default} | ({"action": "append"} if many else {})


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") or files.exists(spark, f"{path}/_SUCCESS") and not files.find(spark, path, "*.csv") else readers.read_csv(spark, path, sniff=True)


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers, where they are there."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns}) if any(c in df.columns for c in columns) else df


def document(spark: SparkSession, path: str, value: object) -> None:
    """Write a small JSON document."""
    files.write_text(spark, path, writers.stable_json(value) + "\n")


@command("prepare", opt("--handbook"), opt("--literature"), opt("--aggregate"), opt("--out-dir", required=True))
def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    """Standardize the sources that are given, combine and deduplicate them, and report overlap, replicates and coverage."""
    given = [(p, names, source) for p, names, source in ((a.handbook, standardize.HANDBOOK, "handbook"), (a.literature, standardize.LITERATURE, "literature"), (a.aggregate, standardize.AGGREGATE, "aggregate")) if p]
    if not given:
        raise SystemExit("give one source at least")
    parts = standardize.prepare([standardize.standardize(table(spark, p), names, source, infer=source == "handbook") for p, names, source in given])
    for name, df in parts.items():
        writers.write_csv(df, f"{a.out_dir}/{name}") if name not in ("combined", "deduplicated") else df.write.mode("overwrite").parquet(f"{a.out_dir}/{name}")
    summary = {"rows_before": parts["combined"].count(), "rows_after": parts["deduplicated"].count()}
    document(spark, f"{a.out_dir}/summary.json", summary)
    files.write_text(spark, f"{a.out_dir}/report.md", writers.report("Preparation", [("Rows", json.dumps(summary)), ("Overlap", parts["overlap"]), ("Coverage", parts["coverage_after"])]))
    return 0


@command("profile", opt("--input", required=True), opt("--out-dir", required=True), opt("--numeric"), opt("--categories"))
def profile_table(spark: SparkSession, a: argparse.Namespace) -> int:
    """Missing values, numbers and frequencies of a table."""
    df = table(spark, a.input)
    numeric = readers.split_list(a.numeric) or features.numeric_columns(df)
    writers.write_csv(profile.missing_profile(df, df.columns), f"{a.out_dir}/missing")
    if numeric:
        writers.write_csv(profile.numeric_profile(numbers(df, numeric), numeric), f"{a.out_dir}/numbers")
    for c in readers.split_list(a.categories):
        writers.write_csv(profile.value_counts(df, c).orderBy(F.col("n").desc(), "value"), f"{a.out_dir}/counts_{readers.sanitize_names([c])[0]}")
    return 0


@command("make-solvent-descriptors", opt("--input", required=True), opt("--existing", required=True), opt("--output", required=True), opt("--column", "Solvent"), opt("--report"))
def make_solvents(spark: SparkSession, a: argparse.Namespace) -> int:
    """Describe the distinct solvents of a table and join the measured descriptors."""
    existing = numbers(table(spark, a.existing), list(solvents.PHYSICAL))
    out = solvents.build_table(table(spark, a.input), a.column, existing)
    writers.write_csv(out, a.output)
    if a.report:
        counts = out.groupBy("existing_match").agg(F.count(F.lit(1)).alias("solvents"), F.sum("row_count").alias("rows"))
        files.write_text(spark, a.report, writers.report("Solvent descriptors", [("Matches", counts)]))
    return 0


@command("solvent-template", opt("--input", required=True), opt("--column", "Solvent"), opt("--output", required=True))
def template(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write a table of the distinct solvents to be filled in."""
    solvents.write_template(spark, table(spark, a.input), a.column, a.output)
    return 0


TRAIN = (opt("--input", required=True), opt("--out-dir", required=True), opt("--targets", "emission_nm,quantum_yield"), opt("--molecule", "canonical_chromophore_smiles"), opt("--n-bits", 2048, int), opt("--radius", 2, int), opt("--descriptors"), opt("--max-train-rows", None, int), opt("--trees", 100, int), opt("--seed", 42, int))


def _features(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, features.FeatureSpec]:
    df = numbers(table(spark, a.input), [*readers.split_list(a.targets), *readers.split_list(a.descriptors)])
    if getattr(a, "max_train_rows", None):
        df = df.orderBy(F.xxhash64(a.molecule, F.lit(a.seed)), a.molecule).limit(a.max_train_rows)
    spec = features.fit(df, readers.split_list(a.descriptors), [], a.n_bits, a.radius)
    return features.matrix(df, spec, a.molecule if a.n_bits else None), spec


def _pipeline(kind: str, target: str, a: argparse.Namespace):  # noqa: ANN202
    options = {"numTrees": a.trees, "seed": a.seed} if kind == "rf" else {"maxIter": a.trees, "seed": a.seed} if kind in ("gbdt", "histgb") else {}
    return models.REGRESSORS[kind](featuresCol="features", labelCol=target, **options)


@command("train", opt("--model", "rf"), *TRAIN)
def train(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fit one model for each target on held-in molecules; write models, test predictions and metrics."""
    from pyspark.ml import Pipeline

    from .operators.splits import group_split

    rows, spec = _features(spark, a)
    fitted, figures = {}, {}
    for target in readers.split_list(a.targets):
        some = rows.filter(F.col(target).isNotNull())
        n, groups = some.agg(F.count(F.lit(1)), F.countDistinct(a.molecule)).first()
        if n < models.MIN_ROWS or groups < models.MIN_GROUPS:
            figures[target] = {"skipped": f"{n} rows of {groups} molecules"}
            continue
        parted = group_split(some, a.molecule, 0.2, a.seed)
        fitted[target] = Pipeline(stages=[_pipeline(a.model, target, a)]).fit(parted.filter("split = 'train'"))
        test = fitted[target].transform(parted.filter("split = 'test'")).select(a.molecule, F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"), (F.col(target) - F.col("prediction")).alias("residual"))
        test.write.mode("overwrite").parquet(f"{a.out_dir}/predictions/{target}")
        r = metrics.regression(F.col("y_true"), F.col("y_pred"))
        figures[target] = spark.read.parquet(f"{a.out_dir}/predictions/{target}").agg(F.count(F.lit(1)).alias("test_rows"), *[v.alias(k) for k, v in r.items()]).first().asDict() | {"train_rows": parted.filter("split = 'train'").count()}
    document(spark, f"{a.out_dir}/metrics.json", figures)
    if fitted:
        artifacts.save(fitted, spec, f"{a.out_dir}/models", spark, model=a.model, family="tree")
    return 0


@command("run-experiments", opt("--models", "rf,histgb,gbdt,linear"), opt("--splits", "random,molecule"), opt("--seeds", "0"), opt("--skip-training", flag=True), *TRAIN)
def run_experiments(spark: SparkSession, a: argparse.Namespace) -> int:
    """Models x targets x splits x seeds; failures are listed, and metrics come from the saved predictions."""
    failures: list[dict] = []
    if not a.skip_training:
        rows, _ = _features(spark, a)
        rows = rows.withColumn("row_key", F.xxhash64(*[c for c in rows.columns if c != "features"]).cast("string"))
        options = {"rf": {"numTrees": a.trees}, "gbdt": {"maxIter": a.trees}, "histgb": {"maxIter": a.trees}}
        fits = {m: _vector_fit(m, options.get(m, {})) for m in readers.split_list(a.models)}
        groups = {h: "murcko" if h == "scaffold" else a.molecule for h in readers.split_list(a.splits)}
        if "scaffold" in groups:
            rows = chemistry.on_distinct(rows, a.molecule, chemistry.text_udf(lambda s: smiles.scaffold(s, "<ACYCLIC>"), "string"), "murcko")
        failures = experiments.run_matrix(rows, ["features"], readers.split_list(a.targets), fits, list(groups), [int(s) for s in readers.split_list(a.seeds)], "row_key", groups, f"{a.out_dir}/runs")[1]
    runs = experiments.recompute(spark, f"{a.out_dir}/runs")
    writers.write_csv(experiments.ordered(runs), f"{a.out_dir}/metrics")
    document(spark, f"{a.out_dir}/failures.json", failures)
    if runs.filter("target = 'emission_nm'").take(1):
        writers.write_csv(experiments.regions(spark, f"{a.out_dir}/runs"), f"{a.out_dir}/regions")
    return 0


def _vector_fit(kind: str, options: dict) -> experiments.Fit:
    def fit(train_rows: DataFrame, test: DataFrame, _: list[str], target: str, seed: int) -> DataFrame:
        return models.REGRESSORS[kind](featuresCol="features", labelCol=target, **options, **({} if kind == "linear" else {"seed": seed})).fit(train_rows).transform(test)

    return fit


@command("run-neural", opt("--input", required=True), opt("--features", required=True), opt("--target", "emission_nm"), opt("--key", required=True), opt("--out-dir", required=True), opt("--epochs", 200, int), opt("--patience", 20, int), opt("--tasks", None, int), opt("--seed", 0, int))
def run_neural(spark: SparkSession, a: argparse.Namespace) -> int:
    """A multilayer perceptron with early stopping, trained by many tasks on all rows of the training molecules; a run that was lost goes on."""
    from .operators.splits import group_split

    names = readers.split_list(a.features)
    rows = group_split(numbers(table(spark, a.input), [*names, a.target]).filter(F.col(a.target).isNotNull()), a.key, 0.2, a.seed)
    f = perceptron.fit(rows.filter("split = 'train'"), names, a.target, a.key, epochs=a.epochs, patience=a.patience, seed=a.seed, tasks=a.tasks, folder=f"{a.out_dir}/training")
    out = learners.predict(rows.filter("split = 'test'"), names, f).select(a.key, F.col(a.target).alias("y_true"), F.col("prediction").alias("y_pred"))
    out.write.mode("overwrite").parquet(f"{a.out_dir}/predictions")
    r = metrics.regression(F.col("y_true"), F.col("y_pred"))
    document(spark, f"{a.out_dir}/metrics.json", {a.target: spark.read.parquet(f"{a.out_dir}/predictions").na.drop().agg(F.count(F.lit(1)).alias("test_rows"), *[v.alias(k) for k, v in r.items()]).first().asDict()})
    return 0


@command("graph-tables", opt("--input", required=True), opt("--molecule", "canonical_chromophore_smiles"), opt("--out-dir", required=True))
def graph_tables(spark: SparkSession, a: argparse.Namespace) -> int:
    """Node and edge tables of the molecules of a table."""
    distinct = table(spark, a.input).select(F.col(a.molecule).alias("molecule")).filter("molecule IS NOT NULL").distinct()
    nodes, edges = chemistry.graph_tables(distinct, "molecule", "molecule")
    nodes.write.mode("overwrite").parquet(f"{a.out_dir}/nodes")
    edges.write.mode("overwrite").parquet(f"{a.out_dir}/edges")
    return 0


@command("predict", opt("--models", required=True, many=True), opt("--smiles"), opt("--solvent-smiles"), opt("--csv"), opt("--smiles-column", "SMILES"), opt("--known-emission", None, float), opt("--known-yield", None, float), opt("--output", required=True))
def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    """Predictions of all given model folders for one molecule or a table, with their disagreement."""
    if not a.smiles and not a.csv:
        raise SystemExit("give --smiles or --csv")
    rows = spark.createDataFrame([(a.smiles, a.solvent_smiles)], "molecule string, solvent string") if a.smiles else table(spark, a.csv).withColumnRenamed(a.smiles_column, "molecule")
    rows = chemistry.canonicalize(rows, "molecule", "molecule_smiles")
    out, warnings = artifacts.predict_all(spark, a.models, rows.filter("molecule_smiles IS NOT NULL"), "molecule_smiles")
    if out is None:
        raise SystemExit("no model folder could be used: " + "; ".join(warnings))
    for name, known in (("emission_nm", a.known_emission), ("quantum_yield", a.known_yield)):
        if known is not None:
            out = out.withColumn(f"residual_{name}", F.col(artifacts.COLUMNS[name]) - known)
    writers.write_csv(out, f"{a.output}/predictions")
    writers.write_csv(artifacts.disagreement(out, ["molecule_smiles"]), f"{a.output}/disagreement")
    document(spark, f"{a.output}/warnings.json", warnings)
    return 0


@command("generate-candidates", opt("--scaffolds"), opt("--substituents"), opt("--output", required=True))
def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    """The candidate library: scaffolds with substituents, invalid ones dropped, equal ones once."""
    some = lambda listed, wanted: {k: v for k, v in listed.items() if not wanted or k in wanted}
    rows = chemistry.enumerate_library(some(chemistry.TEMPLATES, readers.split_list(a.scaffolds)), some(chemistry.SUBSTITUENTS, readers.split_list(a.substituents)))
    writers.write_csv(spark.createDataFrame(rows, "scaffold string, substituent string, smiles string"), a.output)
    return 0


@command("screen", opt("--candidates", required=True), opt("--models", required=True, many=True), opt("--references"), opt("--reference-column", "canonical_chromophore_smiles"), opt("--target-emission", required=True, kind=float), opt("--threshold", screening.SCREEN_THRESHOLD, float), opt("--output", required=True))
def screen(spark: SparkSession, a: argparse.Namespace) -> int:
    """Predict, score and rank candidates for a wavelength; with references, flag those out of domain."""
    rows = chemistry.canonicalize(table(spark, a.candidates), "smiles", "canonical_smiles").filter("canonical_smiles IS NOT NULL")
    out, warnings = artifacts.predict_all(spark, a.models, rows, "canonical_smiles")
    if out is None:
        raise SystemExit("no model folder could be used: " + "; ".join(warnings))
    out = out.withColumns({"predicted_emission_nm": F.col("predicted_emission_nm"), "predicted_qy": F.col("predicted_quantum_yield"), "log_extinction": F.lit(None).cast("double"), "similarity": F.lit(None).cast("double")})
    if a.references:
        known = table(spark, a.references).select(F.col(a.reference_column).alias("reference")).filter("reference IS NOT NULL").distinct()
        near = nearest_by_bits(out.select("canonical_smiles").distinct(), known)
        out = out.drop("similarity").join(near, "canonical_smiles", "left")
    out = screening.score_candidates(out, a.target_emission).withColumn("outside_domain", screening.out_of_domain(F.col("similarity"), a.threshold))
    order = readers.reorder(out.columns, ["name", "scaffold", "substituent"], ["predicted_emission_nm", "predicted_quantum_yield", "similarity", "outside_domain", "score"], ("predicted_qy",))
    writers.write_csv(out.select(*order).orderBy(F.col("score").desc_nulls_last(), "canonical_smiles"), a.output)
    return 0


def nearest_by_bits(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Largest similarity of each candidate to the references, by fingerprint bits; null without any reference."""
    bits = lambda df, c: chemistry.on_distinct(df, c, chemistry.bits_udf(), "bits").filter("bits IS NOT NULL").select(c, "bits")
    return neighbours.top_k_sets(bits(candidates, "canonical_smiles"), bits(references, "reference"), 1, "canonical_smiles", "reference").select("canonical_smiles", "similarity")


@command("summarize-screening", opt("--inputs", required=True, many=True), opt("--targets", required=True), opt("--out", required=True), opt("--markdown"), opt("--top-n", 10, int))
def summarize(spark: SparkSession, a: argparse.Namespace) -> int:
    """The best candidates of each screening table, ranked, one table for all targets."""
    targets = [float(t) for t in readers.split_list(a.targets)]
    if len(targets) != len(a.inputs):
        raise SystemExit("one target for each input")
    parts = [joins.best_by(numbers(table(spark, p), ["score", "predicted_emission_nm"]).withColumn("target_nm", F.lit(t)), ["target_nm"], [F.col("score").desc_nulls_last(), F.col("canonical_smiles")], a.top_n) for p, t in zip(a.inputs, targets, strict=True)]
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).withColumn("target_note", bins.target_note(F.col("target_nm")))
    writers.write_csv(readers.insert_first(out, target_nm=F.col("target_nm"), rank=F.col("rank")).orderBy("target_nm", "rank"), a.out)
    if a.markdown:
        files.write_text(spark, a.markdown, writers.report("Candidates", [("Best of each target", out.orderBy("target_nm", "rank"))]))
    return 0


@command("check-molecule", opt("--smiles", required=True), opt("--solvent", required=True), opt("--dataset", required=True, many=True), opt("--smiles-column"), opt("--solvent-column"), opt("--out"))
def check_molecule(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rows of the datasets that hold a molecule, and whether their solvent matches."""
    wanted = smiles.canonical(a.smiles)
    if wanted is None:
        raise SystemExit("the molecule can't be read")
    parts = []
    for path in a.dataset:
        df = readers.with_ordinal(table(spark, path), "dataset_row_index")
        find = lambda names, given, df=df: readers.resolve_column(df.columns, names, "casefold", given, required=True)
        molecule, solvent = find(["canonical_chromophore_smiles", "smiles", "chromophore"], a.smiles_column), find(["solvent_original", "solvent"], a.solvent_column)
        df = chemistry.canonicalize(df, molecule, "matched_canonical_smiles").withColumn("source_file", F.lit(path))
        hits = joins.membership(df, "matched_canonical_smiles", F.col(solvent), wanted, a.solvent)
        parts.append(hits.select(*readers.property_columns(hits.columns, ("source_file", "dataset_row_index", molecule, "matched_canonical_smiles", solvent, "solvent_match"))))
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    n = out.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("solvent_match").cast("int")), F.lit(0))).first()
    print(json.dumps({"molecule_rows": n[0], "exact_rows": n[1]}))
    if a.out:
        writers.write_csv(out, a.out)
    return 0


@command("duplicate-check-job", opt("--input", required=True), opt("--output", required=True), opt("--dataset"), opt("--max-matches", duplicate_check.MAX_MATCHES, int))
def duplicate_job(spark: SparkSession, a: argparse.Namespace) -> int:
    """Answer a duplicate-check request."""
    answer = duplicate_check.run(_request(spark, a.input), table(spark, a.dataset) if a.dataset else None, a.max_matches)
    document(spark, a.output, answer)
    return int(answer["status"] == "failed")


def _request(spark: SparkSession, path: str) -> object:
    try:
        return json.loads(files.read_text(spark, path))
    except Exception:  # an unreadable request is answered like an invalid one
        return None


@command("prediction-job", opt("--input", required=True), opt("--output", required=True), opt("--models", required=True))
def prediction_job(spark: SparkSession, a: argparse.Namespace) -> int:
    """Answer a prediction request from the model folders below a root."""
    answer = artifacts.run_job(_request(spark, a.input), artifacts.backend(spark, a.models))
    document(spark, a.output, answer)
    return int(answer["status"] == "failed")


@command("worker", opt("--queue", required=True), opt("--jobs-dir", required=True), opt("--models", required=True), opt("--results", required=True), opt("--limit", 5, int), opt("--interval", 30.0, float), opt("--max-loops", None, int), opt("--idle-exit", None, int), opt("--submit-only", flag=True), opt("--collect-only", flag=True), opt("--dry-run", flag=True))
def run_worker(spark: SparkSession, a: argparse.Namespace) -> int:
    """Poll a queue table, answer its jobs one by one and collect finished outputs; one worker at a time."""
    from .streaming import jobs, worker

    answer = artifacts.backend(spark, a.models)
    done = lambda: {n.removeprefix("prediction_") for n in files.names(spark, a.jobs_dir) if n.startswith("prediction_")}

    def submit(batch: DataFrame) -> int:
        rows = [r.asDict() for r in batch.collect()]  # at most ``limit`` rows
        for r in rows:
            job = {k: str(v) if v is not None else None for k, v in r.items()} | {"job_id": str(r["id"]), "requested_at": str(r["created_at"])}
            document(spark, f"{a.jobs_dir}/prediction_{r['id']}/output.json", artifacts.run_job(job, answer))
        return len(rows)

    def queue() -> DataFrame:
        q = table(spark, a.queue)
        return q.filter(~F.col("id").cast("string").isin(*sorted(done()))) if done() else q

    mode = "submit" if a.submit_only else "collect" if a.collect_only else "both"
    collect = lambda: worker.collect_outputs(spark, a.jobs_dir, lambda b, k: jobs.write_batch(b, a.results, k), f"{a.results}-checkpoint")
    with worker.Lock(spark, f"{a.results}.lock"):
        print(json.dumps(worker.work(queue, submit, collect, a.limit, a.interval, a.max_loops, a.idle_exit, mode, a.dry_run)))
    return 0


@command("diagnose-benchmark", opt("--predictions", required=True, many=True), opt("--training", required=True), opt("--out-dir", required=True), opt("--emission-error", diagnose.EMISSION_ERROR, float), opt("--low-similarity", diagnose.LOW_SIMILARITY, float))
def diagnose_benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """Summaries by model and molecule, training overlap, failure modes and confidence of benchmark predictions."""
    names = ["expected_emission_nm", "expected_qy", "predicted_emission_nm", "predicted_quantum_yield", "nearest_training_similarity"]
    raw = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [numbers(table(spark, p), names) for p in a.predictions])
    for c in names:
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("double"))
    p = raw.withColumns({"emission_abs_error": F.abs(F.col("predicted_emission_nm") - F.col("expected_emission_nm")), "qy_abs_error": F.abs(F.col("predicted_quantum_yield") - F.col("expected_qy")), "nearest_similarity": F.col("nearest_training_similarity"), "family": F.col("model_family") if "model_family" in raw.columns else F.lit("tree")})
    training = numbers(table(spark, a.training), ["emission_nm"]).select(F.col("molecule_smiles").alias("molecule"), "solvent", "emission_nm")
    p = p.withColumn("molecule", F.coalesce("molecule_smiles", "molecule")) if "molecule" in p.columns else p.withColumnRenamed("molecule_smiles", "molecule")
    summary = diagnose.molecule_summary(p).join(p.groupBy("molecule").agg(F.min("solvent").alias("solvent")), "molecule")
    cases = diagnose.confidence(diagnose.failure_mode(diagnose.training_overlap(summary, training)))
    writers.write_csv(diagnose.model_summary(p, ["family", "model"]), f"{a.out_dir}/models")
    writers.write_csv(cases, f"{a.out_dir}/molecules")
    writers.write_csv(diagnose.attach_confidence(p, cases, ["molecule"]), f"{a.out_dir}/predictions")
    modes = cases.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("molecules")).orderBy(F.col("molecules").desc(), "failure_mode")
    files.write_text(spark, f"{a.out_dir}/report.md", writers.report("Benchmark", [("Failure modes", modes), ("Models", diagnose.model_summary(p, ["family", "model"]))]))
    return 0


@command("analyze-errors", opt("--predictions", required=True), opt("--out-dir", required=True), opt("--top-n", 50, int))
def analyze_errors(spark: SparkSession, a: argparse.Namespace) -> int:
    """Errors by region, and the worst and best rows, of a prediction table."""
    p = numbers(table(spark, a.predictions), ["y_true", "y_pred"])
    e = p.withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred"))).filter("abs_error IS NOT NULL")
    writers.write_csv(profile.grouped_errors(p, bins.ERROR.label(F.col("y_true")), "region"), f"{a.out_dir}/regions")
    ties = [F.col(c) for c in p.columns]
    writers.write_csv(e.orderBy(F.col("abs_error").desc(), *ties).limit(a.top_n), f"{a.out_dir}/worst")
    writers.write_csv(e.orderBy("abs_error", *ties).limit(a.top_n), f"{a.out_dir}/best")
    return 0


@command("compare-models", opt("--a", required=True), opt("--b", required=True), opt("--output", required=True))
def compare_models(spark: SparkSession, a: argparse.Namespace) -> int:
    """Two metrics documents compared over the union of their targets."""
    docs = [json.loads(files.read_text(spark, p)) for p in (a.a, a.b)]
    number = lambda x: float(x) if isinstance(x, (int, float)) else None
    rows = [(t, *[number((d.get(t) or {}).get(k)) for d in docs for k in ("mae", "r2")]) for t in sorted({t for d in docs for t in d})]
    t = spark.createDataFrame(rows, "target string, mae_a double, r2_a double, mae_b double, r2_b double")
    c = F.col
    writers.write_csv(t.withColumns({"better_mae": bins.better(c("mae_a"), c("mae_b"), "a", "b"), "better_r2": bins.better(c("r2_a"), c("r2_b"), "a", "b", lower=False)}), a.output)
    return 0


@command("report-models", opt("--results", required=True), opt("--output", required=True))
def report_models(spark: SparkSession, a: argparse.Namespace) -> int:
    """All models' metrics documents as one Markdown report."""
    t, warnings = experiments.collect_metrics(spark, a.results)
    files.write_text(spark, a.output, writers.report("Models", [("Metrics", t), ("Warnings", "\n".join(warnings) or "None.")]))
    return 0


@command("paper-summary", opt("--runs", required=True), opt("--output", required=True), opt("--classifiers"), opt("--graph"))
def paper_summary(spark: SparkSession, a: argparse.Namespace) -> int:
    """The paper's tables and findings from saved predictions."""
    runs = experiments.recompute(spark, a.runs)
    cl = numbers(table(spark, a.classifiers), ["accuracy", "f1"]) if a.classifiers else spark.createDataFrame([], "split string, model string, accuracy double, f1 double")
    graph = numbers(table(spark, a.graph), ["mae", "mae_mean", "mae_std", "mae_min", "seeds"]) if a.graph else None
    files.write_text(spark, a.output, reports.paper(runs, cl, graph=graph))
    return 0


@command("yield-noise", opt("--input", required=True), opt("--out-dir", required=True), opt("--min-replicates", 2, int), opt("--top-n", 25, int))
def yield_noise(spark: SparkSession, a: argparse.Namespace) -> int:
    """Spread of repeated quantum yields, the largest of them, and the data of the charts."""
    df = numbers(table(spark, a.input), ["quantum_yield"])
    stats = profile.noise_statistics(df, ["canonical_chromophore_smiles", "canonical_solvent_smiles"], "quantum_yield", "source_dataset", a.min_replicates)
    writers.write_csv(stats, f"{a.out_dir}/groups")
    writers.write_csv(stats.orderBy(F.col("range").desc(), "canonical_chromophore_smiles", "canonical_solvent_smiles").limit(a.top_n), f"{a.out_dir}/largest")
    writers.write_csv(reports.histogram(stats, "range", 0.05), f"{a.out_dir}/histogram")
    files.write_text(spark, f"{a.out_dir}/report.md", writers.report("Quantum yield noise", [("All groups", profile.noise_report(stats))]))
    return 0


@command("yield-fit", opt("--input", required=True), opt("--out-dir", required=True), opt("--actual", "y_true"), opt("--predicted", "y_pred"), opt("--allow-out-of-range", flag=True))
def yield_fit(spark: SparkSession, a: argparse.Namespace) -> int:
    """Predicted against actual yields: metrics, line, and the chart's data on a grid."""
    p = numbers(table(spark, a.input), [a.actual, a.predicted]).select(F.col(a.actual).alias("y_true"), F.col(a.predicted).alias("y_pred")).na.drop()
    p = p if a.allow_out_of_range else p.filter("y_true BETWEEN 0 AND 1")
    y, q = F.col("y_true"), F.col("y_pred")
    document(spark, f"{a.out_dir}/fit.json", p.agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in (metrics.regression(y, q) | metrics.line_fit(y, q)).items()]).first().asDict())
    writers.write_csv(reports.scatter_density(p, "y_true", "y_pred", 0.02), f"{a.out_dir}/grid")
    return 0


@command("summarize-seeds", opt("--runs", required=True), opt("--output", required=True))
def summarize_seeds(spark: SparkSession, a: argparse.Namespace) -> int:
    """Metrics over seeds of each target and model."""
    v, r = F.col("mae"), F.col("r2")
    out = experiments.recompute(spark, a.runs).groupBy("target", "model", "split").agg(F.count(F.lit(1)).alias("seeds"), F.avg(v).alias("mae_mean"), F.stddev_samp(v).alias("mae_std"), F.min(v).alias("mae_min"), F.max(v).alias("mae_max"), F.avg(r).alias("r2_mean"), F.min(r).alias("r2_min"), F.max(r).alias("r2_max"))
    writers.write_csv(out, a.output)
    return 0


@command("clean", opt("--input", required=True), opt("--output", required=True), opt("--molecule", "SMILES"), opt("--solvent", "solvent"), opt("--values", required=True))
def clean(spark: SparkSession, a: argparse.Namespace) -> int:
    """Legacy cleaning: rows without molecule or solvent go, duplicates are averaged; prints what was observed."""
    values = readers.split_list(a.values)
    raw = numbers(table(spark, a.input), values)
    df = chemistry.canonicalize(raw, a.molecule, "canonical_smiles").na.drop(subset=["canonical_smiles", a.solvent])
    flagged = dedup.duplicate_counts(df, ["canonical_smiles", a.solvent])
    out = df.groupBy("canonical_smiles", a.solvent).agg(F.min(a.molecule).alias(a.molecule), *[F.avg(c).alias(c) for c in values])
    writers.write_csv(out, a.output)
    repeated = flagged.filter("is_duplicate").first()
    print(json.dumps({"raw_rows": raw.count(), "valid_rows": df.count(), "rows_in_duplicates": repeated["n_rows"] if repeated else 0, "rows": out.count()}))
    return 0


def parser() -> argparse.ArgumentParser:
    """All commands with their options."""
    top = argparse.ArgumentParser(prog="lumiquery", description=__doc__.split("\n")[0])
    sub = top.add_subparsers(dest="command", required=True)
    for name, (run, options) in sorted(COMMANDS.items()):
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0], description=run.__doc__)
        for flag, settings in options:
            p.add_argument(flag, **settings)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns its exit code."""
    a = parser().parse_args(argv)
    return COMMANDS[a.command][0](spark or get_session(), a)


if __name__ == "__main__":
    sys.exit(main())
