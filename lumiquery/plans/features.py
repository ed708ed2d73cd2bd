"""Queries over features and solvents: descriptor selection, feature rows, solvent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, solvents
from . import views
from .catalog import query
from .views import MEAS, MOL, SOLV

R6 = lambda c: F.round(c, 6)


@query("descriptor_selection", """
SELECT * FROM (SELECT 'dielectric' AS column_name, count(dielectric) AS n FROM solv UNION ALL SELECT 'polarity', count(polarity) FROM solv UNION ALL SELECT 's_suppkey', count(s_suppkey) FROM solv) WHERE n > 0""", SOLV)
def descriptor_selection(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the solvent table that are numbers, with their counts; names and empty columns are left out."""
    s = views.solv(spark, d).withColumn("empty", F.lit(None).cast("double")).withColumn("note", F.lit("text"))
    found = features.numeric_columns(s)
    return s.agg(*[F.count(c).alias(c) for c in found]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in found])))


FEATURE_TRAIN = "tr AS (SELECT *, CASE WHEN molecule_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM mol)"


@query("feature_matrix", """
, k AS (SELECT DISTINCT substituent FROM tr WHERE split = 'train'), m AS (SELECT median(log_extinction) a, median(similarity) b FROM tr WHERE split = 'train')
SELECT molecule_id, split, round(coalesce(log_extinction, a, 0), 6) AS log_extinction, round(coalesce(similarity, b, 0), 6) AS similarity, (SELECT count(*) FROM k) AS n_columns,
  CASE WHEN tr.substituent IN (SELECT substituent FROM k) THEN 1 ELSE 0 END AS hot_sum FROM tr, m""", MOL, FEATURE_TRAIN)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Imputed descriptors and one-hot columns of all rows, by medians and vocabulary of the training side."""
    m = views.mol(spark, d).withColumn("split", F.when(F.col("molecule_id") % 5 == 0, "test").otherwise("train"))
    spec = features.fit(m.filter("split = 'train'"), ["log_extinction", "similarity"], ["substituent"], n_bits=0)
    hot = [c for n, c in features.values(spec).items() if n not in spec.descriptor_columns]
    v = features.values(spec)
    return m.select("molecule_id", "split", R6(v["log_extinction"]).alias("log_extinction"), R6(v["similarity"]).alias("similarity"), F.lit(len(hot)).cast("long").alias("n_columns"), sum(hot[1:], hot[0]).alias("hot_sum"))


SOLVENT_DIM = """fl AS (SELECT lab, dielectric FROM (SELECT *, lower(trim(label)) lab, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY s_suppkey) rn FROM solv) WHERE rn = 1),
fc AS (SELECT solvent_key, dielectric FROM (SELECT *, row_number() OVER (PARTITION BY solvent_key ORDER BY s_suppkey) rn FROM solv WHERE solvent_key IS NOT NULL) WHERE rn = 1)"""


@query("solvent_table", """
, c AS (SELECT solvent AS solvent_original, count(*) AS row_count FROM meas WHERE solvent IS NOT NULL GROUP BY 1)
SELECT solvent_original, row_count, CASE WHEN fl.lab IS NOT NULL THEN 'label' WHEN fc.solvent_key IS NOT NULL THEN 'canonical' ELSE 'none' END AS existing_match,
  round(CASE WHEN fl.lab IS NOT NULL THEN fl.dielectric ELSE fc.dielectric END, 6) AS dielectric FROM c LEFT JOIN fl ON lower(solvent_original) = fl.lab LEFT JOIN fc ON solvent_original = fc.solvent_key""", MEAS, SOLV, SOLVENT_DIM)
def solvent_table(spark: SparkSession, d: str) -> DataFrame:
    """Distinct solvents with counts, joined by label, and by key where the label is unknown."""
    counts = solvents.solvent_counts(views.meas(spark, d), "solvent").withColumn("canonical", F.col("solvent_original"))
    out = solvents.direct_then_canonical(counts, views.solv(spark, d), F.col("solvent_original"), "canonical", "label", "solvent_key", ["dielectric"], [F.col("s_suppkey")])
    return out.select("solvent_original", "row_count", "existing_match", R6("dielectric").alias("dielectric"))


@query("solvent_train_missing", """
, t AS (SELECT m.solvent, s.dielectric, s.polarity FROM meas m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(solvent_key) ORDER BY s_suppkey) rn FROM solv WHERE solvent_key IS NOT NULL) WHERE rn = 1) s ON trim(m.solvent) = trim(s.solvent_key))
SELECT solvent, count(*) AS n_rows FROM t WHERE dielectric IS NULL OR polarity IS NULL GROUP BY 1""", MEAS, SOLV)
def solvent_train_missing(spark: SparkSession, d: str) -> DataFrame:
    """Solvents of the training rows that lack a descriptor, with their rows."""
    dim = views.solv(spark, d).withColumnRenamed("solvent_key", "solvent")
    return solvents.train_join(views.meas(spark, d).select("solvent"), dim, "solvent", ["dielectric", "polarity"], [F.col("s_suppkey")])[1]


@query("solvent_inference_flags", """
, md AS (SELECT median(dielectric) AS a, median(polarity) AS b FROM solv),
t AS (SELECT m.solvent, s.k, s.dielectric, s.polarity FROM meas m LEFT JOIN (SELECT solvent_key AS k, dielectric, polarity FROM (SELECT *, row_number() OVER (PARTITION BY trim(solvent_key) ORDER BY s_suppkey) rn FROM solv WHERE solvent_key IS NOT NULL) WHERE rn = 1) s ON trim(m.solvent) = trim(s.k))
SELECT solvent, k IS NOT NULL AS solvent_known, (dielectric IS NULL)::INT + (polarity IS NULL)::INT AS values_imputed, count(*) AS n_rows, round(max(coalesce(dielectric, a)), 6) AS dielectric, round(max(coalesce(polarity, b)), 6) AS polarity FROM t, md GROUP BY 1, 2, 3""", MEAS, SOLV)
def solvent_inference_flags(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of new rows with medians where they are missing, and what was missing."""
    dim = views.solv(spark, d).withColumnRenamed("solvent_key", "solvent")
    medians = features.fit(dim, ["dielectric", "polarity"], n_bits=0).medians
    out = solvents.inference_join(views.meas(spark, d).select("solvent"), dim, "solvent", ["dielectric", "polarity"], medians, [F.col("s_suppkey")])
    return out.groupBy("solvent", "solvent_known", "values_imputed").agg(F.count(F.lit(1)).alias("n_rows"), R6(F.max("dielectric")).alias("dielectric"), R6(F.max("polarity")).alias("polarity"))
