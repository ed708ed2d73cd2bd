"""Queries through files and job documents: what is written is read back whole.

Files go to the shared folder; the table a query returns is read from them when the caller runs it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins, splits, standardize
from ..sources import files, readers, writers
from ..streaming import jobs as job_queue
from . import views
from .catalog import query
from .views import JOBS, MEAS, MOL, PRED, SOLV


def _folder(spark: SparkSession, name: str) -> str:
    return f"{job_queue.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", """
SELECT molecule_id, name || ', "' || scaffold || '"; ' || chr(10) || 'µ ' || substituent AS note, log_extinction, similarity FROM mol""", MOL)
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every molecule through CSV: quotes, commas, line breaks, other alphabets and missing numbers come back as they were."""
    note = F.concat("name", F.lit(', "'), "scaffold", F.lit('"; \nµ '), "substituent")
    rows = views.mol(spark, d).select("molecule_id", note.alias("note"), "log_extinction", "similarity")
    path = _folder(spark, "csv")
    writers.write_csv(rows, path)
    return readers.read_csv_optional(spark, path, rows.schema)


@query("csv_optional", "SELECT s_suppkey, lower(trim(label)) AS solvent, dielectric, NULL::VARCHAR AS note FROM solv", SOLV)
def csv_optional(spark: SparkSession, d: str) -> DataFrame:
    """A table in the columns asked for, found by name whatever its case and signs, and no rows from a file that isn't there."""
    path = _folder(spark, "csv")
    writers.write_csv(views.solv(spark, d).select(F.col("s_suppkey").alias("Supp-Key"), F.lower(F.trim("label")).alias("SOLVENT"), F.col("dielectric").alias("Dielectric constant")), path)
    raw = readers.read_csv(spark, path, sniff=True)
    named = {"s_suppkey": readers.resolve_column(raw.columns, ["suppkey"], "alnum", required=True), "solvent": readers.resolve_column(raw.columns, ["solvent"], "casefold"), "dielectric": readers.resolve_column(raw.columns, [], keyword="dielectric")}
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("solvent", T.StringType()), T.StructField("dielectric", T.DoubleType()), T.StructField("note", T.StringType())])
    found = readers.fit_schema(raw.select(*[F.col(f"`{c}`").alias(out) for out, c in named.items()]), schema)
    return found.unionByName(readers.read_csv_optional(spark, f"{path}/absent.csv", schema))


@query("predictions_by_folder", """
SELECT model, split, seed, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae FROM pred WHERE target = 'emission_nm' GROUP BY ALL""", PRED)
def predictions_by_folder(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written by target, model, split and seed; one target is read back from its folders alone."""
    path = _folder(spark, "predictions")
    writers.write_predictions(views.pred(spark, d).select("target", "model", "split", "seed", "y_true", "y_pred"), path)
    kept = spark.read.parquet(path).filter("target = 'emission_nm'")
    return kept.groupBy("model", "split", F.col("seed").cast("long").alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 6).alias("mae"))


@query("request_responses", """
SELECT CASE status WHEN 'error' THEN 'INVALID_INPUT' WHEN 'signup' THEN 'INVALID_MODEL_CHOICE' END AS code, CASE WHEN status IN ('error', 'signup') THEN 'failed' ELSE 'completed' END AS state,
  count(*) AS n, count(DISTINCT CASE WHEN status <> 'error' THEN id END) AS n_jobs FROM jobs GROUP BY 1, 2""", JOBS)
def request_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every job as a line of JSON, read, checked and answered: unreadable lines and unknown models fail with a code."""
    s = F.col("status")
    request = F.struct(F.col("id").cast("string").alias("job_id"), F.lit("C").alias("molecule_smiles"), F.lit("O").alias("solvent_smiles"), F.when(s == "signup", "other").otherwise("all").alias("model_choice"))
    parsed = job_queue.parse_requests(views.jobs(spark, d).select(F.when(s == "error", F.lit("{job_id: ")).otherwise(F.to_json(request)).alias("value")))
    code = F.coalesce("parse_error", job_queue.error_code(["molecule_smiles", "solvent_smiles"], "model_choice", ["all", "best", "gnn", "traditional"]))
    answered = parsed.select("job_id", job_queue.response(F.col("job_id"), code, F.array(F.lit(1.0))).alias("document"))
    return answered.groupBy(F.get_json_object("document", "$.error.code").alias("code"), F.get_json_object("document", "$.status").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("n_jobs"))


@query("job_states", """
SELECT user_id, status, created_at AS last_at, n_updates FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_updates,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, list_position(['queued', 'running', 'completed', 'failed'], status) DESC NULLS LAST) AS rn FROM jobs) WHERE rn = 1""", JOBS)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last state, its time and the number of updates."""
    return job_queue.state_machine(views.jobs(spark, d), "user_id", "status", "created_at").withColumnRenamed("created_at", "last_at")


@query("upsert_replay", "SELECT status, count(*) AS n, count(DISTINCT id) AS n_jobs FROM jobs GROUP BY 1", JOBS)
def upsert_replay(spark: SparkSession, d: str) -> DataFrame:
    """Jobs written once although their batch is replayed and sent again under another number."""
    path, rows = _folder(spark, "jobs"), views.jobs(spark, d)
    for batch_id in (0, 0, 1):
        job_queue.upsert(spark, rows, path, batch_id)
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_jobs"))


@query("first_alias_value", """
, k AS (SELECT solvent_key, dielectric FROM solv WHERE dielectric IS NOT NULL)
SELECT molecule_id, (SELECT dielectric FROM k WHERE solvent_key IN ('S77', 'S5', 'S2') ORDER BY CASE solvent_key WHEN 'S77' THEN 0 WHEN 'S5' THEN 1 ELSE 2 END, dielectric LIMIT 1) AS found, NULL::DOUBLE AS absent FROM mol""", MOL, SOLV)
def first_alias_value(spark: SparkSession, d: str) -> DataFrame:
    """The value of the first alias that the table holds, beside each molecule; null where no alias is there, and no row is lost."""
    table = views.solv(spark, d).filter("dielectric IS NOT NULL")
    out = joins.first_alias(views.mol(spark, d).select("molecule_id"), table, "found", ["S77", "S5", "S2"], "solvent_key", "dielectric")
    return joins.first_alias(out, table, "absent", ["S77", "S78"], "solvent_key", "dielectric")


UNIT = "('0x' || substr(md5(molecule_id::VARCHAR || '|42'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("random_hash_split", f"SELECT molecule_id, CASE WHEN {UNIT} < 0.2 THEN 'test' ELSE 'train' END AS split FROM mol", MOL)
def random_hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows to test and train by hash, the same in any partitioning."""
    return splits.random_split(views.mol(spark, d), F.col("molecule_id")).select("molecule_id", "split")


@query("seeded_sample", "SELECT molecule_id, scaffold FROM mol ORDER BY md5(molecule_id::VARCHAR || '|42'), molecule_id LIMIT 100", MOL)
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred molecules, the same for the same seed."""
    return splits.seeded_sample(views.mol(spark, d), [F.col("molecule_id")], 100).select("molecule_id", "scaffold")


@query("labelled_files", """
SELECT replace(r_name, '_', ' ') AS run_label, n_nationkey, n_name, (SELECT count(*) FROM region) AS n_files FROM nation JOIN region ON n_regionkey = r_regionkey""")
def labelled_files(spark: SparkSession, d: str) -> DataFrame:
    """One small file for each region, found by pattern without the one excluded, read as one table with the file's label."""
    path = _folder(spark, "labelled")
    regions = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name")
    rows = spark.read.parquet(f"{d}/nation.parquet").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name"))), "\n").alias("body"))
    for r in lines.collect():  # a file a region, five by definition
        files.write_text(spark, f"{path}/runs/{r['r_name']}.csv", f"n_nationkey,n_name\n{r['body']}\n")
    files.write_text(spark, f"{path}/runs/summary.csv", "n_nationkey,n_name\n-1,none\n")
    folder = readers.first_existing(f"{path}/absent", f"{path}/runs", spark=spark)
    found = readers.discover(folder, "*.csv", ("summary*",), spark=spark)
    out = readers.read_labelled(spark, found)
    return out.select("run_label", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(len(found)).cast("long").alias("n_files"))


@query("markdown_lines", """
, t AS (SELECT coalesce(solvent, '') AS solvent, count(*) AS n FROM meas GROUP BY 1)
SELECT 0::BIGINT AS line, '| solvent | n |' AS text UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY solvent), '| ' || solvent || ' | ' || n || ' |' FROM t""", MEAS)
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each solvent as a report table, one row for each line of it."""
    table = views.meas(spark, d).groupBy("solvent").agg(F.count(F.lit(1)).alias("n")).orderBy("solvent")
    text = writers.markdown_table(table).split("\n")
    return spark.createDataFrame(list(enumerate(text)), "line long, text string")


@query("measurement_keys", """
SELECT ord, line, concat_ws('|', molecule, coalesce(solvent, '<NA>'), coalesce((absorption_nm::DOUBLE)::VARCHAR, '<NA>'), coalesce((emission_nm::DOUBLE)::VARCHAR, '<NA>'), coalesce(quantum_yield::DOUBLE::VARCHAR, '<NA>'), coalesce(log_extinction::DOUBLE::VARCHAR, '<NA>')) AS measurement_key FROM meas""", MEAS)
def measurement_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of equal measurements of every row."""
    m = views.meas(spark, d).withColumnsRenamed({"molecule": "canonical_chromophore_smiles", "solvent": "canonical_solvent_smiles"})
    return standardize.measurement_key(m).select("ord", "line", "measurement_key")
