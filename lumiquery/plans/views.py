"""Surrogate views: the engine's measurement, prediction and dimension tables over the driver's tables.

Each view is given twice, as a DataFrame and as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = ["absorption_nm", "emission_nm", "lifetime_ns", "quantum_yield", "log_extinction"]
KEY = ["molecule", "solvent", "absorption_nm", "emission_nm", "quantum_yield", "log_extinction"]

MEAS = """meas AS (
  SELECT 'M' || (l_partkey % 200) AS molecule,
         CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE 'S' || (l_suppkey % 10) END AS solvent,
         CASE l_returnflag WHEN 'A' THEN 'literature' WHEN 'N' THEN 'handbook' ELSE 'Aggregate' END AS source_dataset,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE 250 + 9 * l_quantity END AS absorption_nm,
         CASE WHEN l_quantity > 45 THEN NULL ELSE 300 + 10 * l_quantity END AS emission_nm,
         CAST(l_linenumber AS DOUBLE) / 2 AS lifetime_ns,
         round(l_discount * 10, 6) AS quantum_yield,
         round(3 + 25 * l_tax, 6) AS log_extinction,
         l_orderkey AS ord, l_linenumber AS line
  FROM lineitem)"""

PRED = """pred AS (
  SELECT 'M' || (l_partkey % 200) AS molecule, 'S' || (l_suppkey % 10) AS solvent,
         l_linestatus AS family, l_linestatus || (l_suppkey % 3) AS model, l_linenumber % 3 AS seed,
         CASE l_returnflag WHEN 'A' THEN 'absorption_nm' WHEN 'N' THEN 'emission_nm' ELSE 'quantum_yield' END AS target,
         CASE l_suppkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'molecule' ELSE 'scaffold' END AS split,
         300 + 10 * l_quantity AS y_true, round(300 + 10 * l_quantity + 1000 * l_tax - 40, 6) AS y_pred,
         round(l_discount * 10, 6) AS similarity, l_orderkey AS ord, l_linenumber AS line, l_extendedprice AS price
  FROM lineitem)"""

MOL = """mol AS (
  SELECT p_partkey AS molecule_id, p_name AS name, p_brand AS scaffold, p_type AS substituent, p_size AS size,
         400 + p_size * 5 AS predicted_emission_nm, round((p_partkey % 101) / 101.0::DOUBLE, 6) AS predicted_qy,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE 3 + (p_partkey % 7) * 0.25::DOUBLE END AS log_extinction,
         CASE WHEN p_size % 11 = 0 THEN NULL ELSE round((p_partkey % 97) / 97.0::DOUBLE, 6) END AS similarity
  FROM part)"""

SOLV = """solv AS (
  SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'S' || (s_suppkey % 9) END AS solvent_key,
         CASE WHEN s_suppkey % 2 = 0 THEN ' ' || upper('s' || (s_suppkey % 12)) ELSE 's' || (s_suppkey % 12) END AS label,
         CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE s_acctbal END AS dielectric,
         CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE round(s_acctbal / 3, 6) END AS polarity, s_suppkey
  FROM supplier)"""

JOBS = """jobs AS (
  SELECT event_id AS id, user_id, ts AS created_at,
         CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' ELSE event_type END AS status, props, value
  FROM events)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def meas(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of molecules in solvents."""
    c = F.col
    return _t(spark, d, "lineitem").select(
        F.concat(F.lit("M"), (c("l_partkey") % 200).cast("string")).alias("molecule"),
        F.when(c("l_suppkey") % 13 != 0, F.concat(F.lit("S"), (c("l_suppkey") % 10).cast("string"))).alias("solvent"),
        F.when(c("l_returnflag") == "A", "literature").when(c("l_returnflag") == "N", "handbook").otherwise("Aggregate").alias("source_dataset"),
        F.when(c("l_linenumber") != 7, 250 + 9 * c("l_quantity")).alias("absorption_nm"),
        F.when(c("l_quantity") <= 45, 300 + 10 * c("l_quantity")).alias("emission_nm"),
        (c("l_linenumber").cast("double") / 2).alias("lifetime_ns"),
        F.round(c("l_discount") * 10, 6).alias("quantum_yield"),
        F.round(3 + 25 * c("l_tax"), 6).alias("log_extinction"),
        c("l_orderkey").alias("ord"),
        c("l_linenumber").alias("line"),
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of several models, seeds, targets and splits."""
    c = F.col
    s = c("l_suppkey") % 3
    return _t(spark, d, "lineitem").select(
        F.concat(F.lit("M"), (c("l_partkey") % 200).cast("string")).alias("molecule"),
        F.concat(F.lit("S"), (c("l_suppkey") % 10).cast("string")).alias("solvent"),
        c("l_linestatus").alias("family"),
        F.concat("l_linestatus", s.cast("string")).alias("model"),
        (c("l_linenumber") % 3).alias("seed"),
        F.when(c("l_returnflag") == "A", "absorption_nm").when(c("l_returnflag") == "N", "emission_nm").otherwise("quantum_yield").alias("target"),
        F.when(s == 0, "random").when(s == 1, "molecule").otherwise("scaffold").alias("split"),
        (300 + 10 * c("l_quantity")).alias("y_true"),
        F.round(300 + 10 * c("l_quantity") + 1000 * c("l_tax") - 40, 6).alias("y_pred"),
        F.round(c("l_discount") * 10, 6).alias("similarity"),
        c("l_orderkey").alias("ord"),
        c("l_linenumber").alias("line"),
        c("l_extendedprice").alias("price"),
    )


def mol(spark: SparkSession, d: str) -> DataFrame:
    """Candidate molecules with predictions."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return _t(spark, d, "part").select(
        k.alias("molecule_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("scaffold"),
        F.col("p_type").alias("substituent"),
        size.alias("size"),
        (400 + size * 5).alias("predicted_emission_nm"),
        F.round((k % 101) / 101.0, 6).alias("predicted_qy"),
        F.when(size % 5 != 0, 3 + (k % 7) * 0.25).alias("log_extinction"),
        F.when(size % 11 != 0, F.round((k % 97) / 97.0, 6)).alias("similarity"),
    )


def solv(spark: SparkSession, d: str) -> DataFrame:
    """Solvent descriptors, with missing keys and values and labels of mixed case."""
    k = F.col("s_suppkey")
    label = F.concat(F.lit("s"), (k % 12).cast("string"))
    return _t(spark, d, "supplier").select(
        F.when(k % 7 != 0, F.concat(F.lit("S"), (k % 9).cast("string"))).alias("solvent_key"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(label))).otherwise(label).alias("label"),
        F.when(k % 9 != 4, F.col("s_acctbal")).alias("dielectric"),
        F.when(k % 9 != 4, F.round(F.col("s_acctbal") / 3, 6)).alias("polarity"),
        "s_suppkey",
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Job queue."""
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t == "view", "running").otherwise(t)
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), status.alias("status"), "props", "value")


def fp(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints: signs of the embeddings."""
    from ..operators.neighbours import pack_bits

    return pack_bits(_t(spark, d, "embeddings"), "embedding").select("vec_id", "label", "fp")
