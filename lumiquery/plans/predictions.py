"""Queries over predictions: errors, regions, metrics, summaries, rankings, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, scalars
from ..operators import dedup, diagnose, joins, metrics, profile, splits
from . import views
from .catalog import query
from .views import MEAS, MOL, PRED

R6 = lambda c: F.round(c, 6)


def _y() -> Column:
    return F.col("y_true")


def _p() -> Column:
    return F.col("y_pred")


def _n() -> Column:
    return F.count(F.lit(1))



def _region_sql(name: str) -> str:
    case = {
        "experiment": "CASE WHEN y < 400 THEN 'UV' WHEN y < 500 THEN 'blue' WHEN y < 550 THEN 'green' WHEN y < 600 THEN 'yellow/orange' ELSE 'red/NIR' END",
        "error": "CASE WHEN y IS NULL THEN 'missing' WHEN y < 400 THEN 'UV' WHEN y < 480 THEN 'blue' WHEN y < 560 THEN 'green' WHEN y <= 620 THEN 'yellow/orange' ELSE 'red/NIR' END",
        "manuscript": "CASE WHEN y < 400 THEN 'UV' WHEN y < 500 THEN 'blue' WHEN y < 560 THEN 'green' WHEN y < 620 THEN 'yellow/orange' ELSE 'red/NIR' END",
    }[name]
    return f"""
SELECT region, count(*) AS n_rows, round(avg(abs(r)), 6) AS mae, round(median(abs(r)), 6) AS median_ae, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(r), 6) AS mean_residual FROM (
  SELECT {case} AS region, y - y_pred AS r FROM (SELECT CASE WHEN line = 5 AND y_true > 700 THEN NULL ELSE y_true END AS y, y_pred FROM pred)) GROUP BY 1"""


def _regions(spark: SparkSession, d: str, binner: bins.Binner) -> DataFrame:
    y = F.when(~((F.col("line") == 5) & (_y() > 700)), _y())
    p = views.pred(spark, d).withColumn("y_true", y)
    e = profile.grouped_errors(p, binner.label(F.col("y_true")), "region")
    return e.select("region", "n_rows", *[R6(c).alias(c) for c in ("mae", "median_ae", "rmse", "mean_residual")])


@query("region_error_a", _region_sql("experiment"), PRED)
def region_error_a(spark: SparkSession, d: str) -> DataFrame:
    """Errors by wavelength region, experiment binner: a missing value falls into the last region."""
    return _regions(spark, d, bins.EXPERIMENT)


@query("region_error_b", _region_sql("error"), PRED)
def region_error_b(spark: SparkSession, d: str) -> DataFrame:
    """The same by the error-analysis binner, with a bin for missing values."""
    return _regions(spark, d, bins.ERROR)


@query("region_error_c", _region_sql("manuscript"), PRED)
def region_error_c(spark: SparkSession, d: str) -> DataFrame:
    """The same by the manuscript binner."""
    return _regions(spark, d, bins.MANUSCRIPT)


@query("similarity_bin_mae", """
SELECT model, target, CASE WHEN similarity < 0.3 THEN '0.00-0.30' WHEN similarity < 0.5 THEN '0.30-0.50' WHEN similarity < 0.7 THEN '0.50-0.70' WHEN similarity < 0.85 THEN '0.70-0.85' ELSE '0.85-1.00' END AS similarity_bin,
  count(*) AS n_rows, round(avg(abs(y_true - y_pred)), 6) AS mae FROM pred GROUP BY 1, 2, 3""", PRED)
def similarity_bin_mae(spark: SparkSession, d: str) -> DataFrame:
    """Errors by half-open bins of nearest-neighbour similarity."""
    b = bins.SIMILARITY.label(F.col("similarity")).alias("similarity_bin")
    return views.pred(spark, d).groupBy("model", "target", b).agg(_n().alias("n_rows"), R6(F.avg(F.abs(_y() - _p()))).alias("mae"))


@query("group_error_category", """
SELECT solvent, count(*) AS n_rows, round(avg(abs(y_true - y_pred)), 6) AS mae, round(median(abs(y_true - y_pred)), 6) AS median_ae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
  round(avg(y_true - y_pred), 6) AS mean_residual FROM pred GROUP BY 1""", PRED)
def group_error_category(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each solvent."""
    e = profile.grouped_errors(views.pred(spark, d), F.col("solvent"), "solvent")
    return e.select("solvent", "n_rows", *[R6(c).alias(c) for c in ("mae", "median_ae", "rmse", "mean_residual")])


@query("top_molecules_by_error", """
SELECT molecule, n_rows, mae FROM (SELECT molecule, count(*) AS n_rows, round(avg(abs(y_true - y_pred)), 6) AS mae FROM pred GROUP BY 1) ORDER BY mae DESC, molecule LIMIT 25""", PRED)
def top_molecules_by_error(spark: SparkSession, d: str) -> DataFrame:
    """The 25 molecules with the largest mean error (a report of the top k)."""
    e = views.pred(spark, d).groupBy("molecule").agg(_n().alias("n_rows"), R6(F.avg(F.abs(_y() - _p()))).alias("mae"))
    return e.orderBy(F.col("mae").desc(), "molecule").limit(25)


@query("overall_error_table", """
SELECT target, count(*) AS n_rows, round(avg(abs(y_true - y_pred)), 6) AS mae, min_by(model, (abs(y_true - y_pred), model)) AS best_model, round(max(abs(y_true - y_pred)), 6) AS worst FROM pred GROUP BY 1""".replace("min_by(model, (abs(y_true - y_pred), model))", "min(model) FILTER (abs(y_true - y_pred) = mn)").replace("FROM pred", "FROM (SELECT *, min(abs(y_true - y_pred)) OVER (PARTITION BY target) AS mn FROM pred)"), PRED)
def overall_error_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a target, with the model of its smallest error."""
    e = F.abs(_y() - _p())
    return views.pred(spark, d).groupBy("target").agg(_n().alias("n_rows"), R6(F.avg(e)).alias("mae"), F.min_by("model", F.struct(e, "model")).alias("best_model"), R6(F.max(e)).alias("worst"))


BENCH = """bench AS (SELECT molecule, solvent, family, model, y_true AS expected_emission_nm, y_pred AS predicted_emission_nm, abs(y_pred - y_true) AS emission_abs_error,
  round(abs(similarity - 0.5), 6) AS qy_abs_error, similarity AS nearest_similarity FROM pred WHERE target = 'emission_nm')"""


def _bench(spark: SparkSession, d: str) -> DataFrame:
    p = views.pred(spark, d).filter("target = 'emission_nm'")
    return p.select("molecule", "solvent", "family", "model", _y().alias("expected_emission_nm"), _p().alias("predicted_emission_nm"), F.abs(_p() - _y()).alias("emission_abs_error"), R6(F.abs(F.col("similarity") - 0.5)).alias("qy_abs_error"), F.col("similarity").alias("nearest_similarity"))


@query("model_error_summary", """
SELECT family, model, count(*) AS n_rows, count(DISTINCT molecule) AS n_molecules,
""" + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("emission_abs_error", "qy_abs_error") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("max", "max"))) + " FROM bench GROUP BY 1, 2", PRED, BENCH)
def model_error_summary(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each model in two measures."""
    s = diagnose.model_summary(_bench(spark, d), ["family", "model"])
    return s.select("family", "model", "n_rows", "n_molecules", *[R6(c).alias(c) for c in s.columns[4:]])


SUMMARY = """summary AS (SELECT molecule, count(*) AS n_predictions, (min(struct_pack(e := emission_abs_error, m := model))).m AS best_model, min(emission_abs_error) AS best_error, (min(struct_pack(e := emission_abs_error, m := model, x := expected_emission_nm)) FILTER (expected_emission_nm IS NOT NULL)).x AS expected_emission_nm,
  avg(predicted_emission_nm) AS predicted_mean, stddev_samp(predicted_emission_nm) AS predicted_std, min(predicted_emission_nm) AS predicted_min, max(predicted_emission_nm) AS predicted_max,
  avg(emission_abs_error) AS mean_emission_error, avg(qy_abs_error) AS mean_qy_error, max(nearest_similarity) AS similarity FROM bench GROUP BY 1)"""


@query("molecule_summary_best", "SELECT molecule, n_predictions, best_model, round(expected_emission_nm, 6) AS expected_emission_nm, round(best_error, 6) AS best_error, round(predicted_mean, 6) AS predicted_mean, round(predicted_std, 6) AS predicted_std, round(mean_qy_error, 6) AS mean_qy_error FROM summary", PRED, BENCH, SUMMARY)
def molecule_summary_best(spark: SparkSession, d: str) -> DataFrame:
    """Best model and spread of each molecule."""
    s = diagnose.molecule_summary(_bench(spark, d))
    return s.select("molecule", "n_predictions", "best_model", *[R6(c).alias(c) for c in ("expected_emission_nm", "best_error", "predicted_mean", "predicted_std", "mean_qy_error")])


LADDER = """case_in AS (SELECT molecule, solvent, max(expected_emission_nm) AS expected_emission_nm, avg(predicted_emission_nm) AS predicted_mean, stddev_samp(predicted_emission_nm) / 4 AS predicted_std,
    avg(predicted_emission_nm) AS predicted_min, avg(predicted_emission_nm) AS predicted_max, avg(emission_abs_error) AS mean_emission_error, avg(qy_abs_error) / 2 AS mean_qy_error, max(nearest_similarity) AS similarity
  FROM bench GROUP BY 1, 2),
train AS (SELECT molecule, solvent, emission_nm FROM meas WHERE source_dataset = 'handbook'),
tm AS (SELECT molecule, median(emission_nm) AS med_m, stddev_samp(emission_nm) AS std_m FROM train GROUP BY 1),
tp AS (SELECT molecule, solvent, median(emission_nm) AS med_p, stddev_samp(emission_nm) AS std_p FROM train WHERE solvent IS NOT NULL GROUP BY 1, 2),
ts AS (SELECT DISTINCT solvent FROM train WHERE solvent IS NOT NULL),
j AS (SELECT c.*, tm.molecule IS NOT NULL AS mol_seen, tp.molecule IS NOT NULL AS pair_seen, ts.solvent IS NOT NULL AS solv_seen, coalesce(med_p, med_m) AS tr, coalesce(std_p, std_m) AS tstd
  FROM case_in c LEFT JOIN tm ON c.molecule = tm.molecule LEFT JOIN tp ON c.molecule = tp.molecule AND c.solvent = tp.solvent LEFT JOIN ts ON c.solvent = ts.solvent),
f AS (SELECT *, abs(expected_emission_nm - tr) AS delta, coalesce(mean_emission_error > 25, false) AS he, coalesce(mean_qy_error > 0.2, false) AS hq,
  coalesce(abs(predicted_mean - tr) < abs(predicted_mean - expected_emission_nm), false) AS closer, coalesce(predicted_std > 30, false) OR coalesce(predicted_max - predicted_min > 60, false) AS dis FROM j)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    b = _bench(spark, d).groupBy("molecule", "solvent").agg(
        F.max("expected_emission_nm").alias("expected_emission_nm"), F.avg("predicted_emission_nm").alias("predicted_mean"), (F.stddev_samp("predicted_emission_nm") / 4).alias("predicted_std"),
        F.avg("predicted_emission_nm").alias("predicted_min"), F.avg("predicted_emission_nm").alias("predicted_max"), F.avg("emission_abs_error").alias("mean_emission_error"),
        (F.avg("qy_abs_error") / 2).alias("mean_qy_error"), F.max("nearest_similarity").alias("similarity"),
    )
    train = views.meas(spark, d).filter("source_dataset = 'handbook'").select("molecule", "solvent", "emission_nm")
    return diagnose.confidence(diagnose.failure_mode(diagnose.training_overlap(b, train)))


@query("failure_ladder", """
SELECT molecule, solvent, round(delta, 6) AS training_delta, CASE WHEN NOT he AND NOT hq THEN 'reasonable_prediction' WHEN pair_seen AND coalesce(delta <= 25, false) AND he THEN 'model_failure_exact_pair'
  WHEN (pair_seen OR mol_seen) AND coalesce(delta > 25, false) AND closer THEN 'benchmark_training_label_mismatch' WHEN mol_seen AND NOT pair_seen AND he THEN 'solvent_or_condition_mismatch'
  WHEN dis THEN 'high_model_disagreement' WHEN hq AND NOT he THEN 'qy_condition_sensitive' WHEN NOT mol_seen AND coalesce(similarity < 0.65, false) THEN 'structural_extrapolation' ELSE 'model_failure_exact_pair' END AS failure_mode FROM f""", PRED, BENCH, MEAS, LADDER)
def failure_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Failure mode of each benchmark pair."""
    return _cases(spark, d).select("molecule", "solvent", R6("training_delta").alias("training_delta"), "failure_mode")


@query("confidence_score", """
, s AS (SELECT *, least(greatest(coalesce(similarity, 0), 0), 1) AS sim, CASE WHEN predicted_std IS NULL THEN 0.5::DOUBLE WHEN predicted_std <= 10 THEN 1 WHEN predicted_std >= 30 THEN 0 ELSE 1 - (predicted_std - 10) / 20 END AS agree,
  CASE WHEN tstd IS NULL THEN 0.5::DOUBLE WHEN tstd <= 10 THEN 1 WHEN tstd >= 60 THEN 0 ELSE 1 - (tstd - 10) / 50 END AS lab FROM f),
o AS (SELECT *, 0.20::DOUBLE * mol_seen::INT + 0.15::DOUBLE * solv_seen::INT + 0.20::DOUBLE * pair_seen::INT + 0.20::DOUBLE * sim + 0.15::DOUBLE * lab + 0.10::DOUBLE * agree AS score FROM s)
SELECT molecule, solvent, round(score, 6) AS confidence_score, CASE WHEN round(score, 9) < 0.5 THEN 'low' WHEN round(score, 9) >= 0.75 AND sim >= 0.85 AND agree >= 0.6 THEN 'high' ELSE 'medium' END AS confidence_label FROM o""", PRED, BENCH, MEAS, LADDER)
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Overall confidence of each benchmark pair."""
    return _cases(spark, d).select("molecule", "solvent", R6("confidence_score").alias("confidence_score"), "confidence_label")


@query("train_label_statistics", """
SELECT molecule, min(emission_nm) AS min_molecule, round(median(emission_nm), 6) AS median_molecule, round(avg(emission_nm), 6) AS mean_molecule, max(emission_nm) AS max_molecule,
  round(stddev_samp(emission_nm), 6) AS std_molecule FROM meas WHERE source_dataset = 'handbook' GROUP BY 1""", MEAS)
def train_label_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Training labels of each molecule."""
    e = F.col("emission_nm")
    g = views.meas(spark, d).filter("source_dataset = 'handbook'").groupBy("molecule")
    return g.agg(F.min(e).alias("min_molecule"), R6(F.median(e)).alias("median_molecule"), R6(F.avg(e)).alias("mean_molecule"), F.max(e).alias("max_molecule"), R6(F.stddev_samp(e)).alias("std_molecule"))


@query("disagreement_by_family", """
SELECT family, target, round(avg(y_pred), 6) AS mean, round(median(y_pred), 6) AS median, round(stddev_pop(y_pred), 6) AS std, min(y_pred) AS min, max(y_pred) AS max, round(max(y_pred) - min(y_pred), 6) AS range,
  CASE WHEN max(y_pred) - min(y_pred) < 20 THEN 'low' WHEN max(y_pred) - min(y_pred) < 60 THEN 'moderate' ELSE 'high' END AS level FROM pred GROUP BY GROUPING SETS ((family, target), (target))""", PRED)
def disagreement_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Spread of predictions by family and over all, with its level."""
    agg = [R6(F.avg(_p())).alias("mean"), R6(F.median(_p())).alias("median"), R6(F.stddev_pop(_p())).alias("std"), F.min(_p()).alias("min"), F.max(_p()).alias("max"), R6(F.max(_p()) - F.min(_p())).alias("range")]
    out = views.pred(spark, d).groupingSets([["family", "target"], ["target"]], "family", "target").agg(*agg)
    return out.withColumn("level", bins.EMISSION_SPREAD.label(F.col("range")))


@query("spread_across_models", """
SELECT target, model, round(mean, 6) AS mean, round(max(mean) OVER (PARTITION BY target) - min(mean) OVER (PARTITION BY target), 6) AS spread FROM (SELECT target, model, avg(y_pred) AS mean FROM pred GROUP BY 1, 2)""", PRED)
def spread_across_models(spark: SparkSession, d: str) -> DataFrame:
    """Range over models, beside each model's mean."""
    m = views.pred(spark, d).groupBy("target", "model").agg(F.avg(_p()).alias("mean"))
    w = Window.partitionBy("target")
    return m.select("target", "model", R6("mean").alias("mean"), R6(F.max("mean").over(w) - F.min("mean").over(w)).alias("spread"))


MET = "met AS (SELECT target, model, split, seed, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (count(*) * var_pop(y_true)) AS r2 FROM pred GROUP BY 1, 2, 3, 4)"


def _met(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.regression(_y(), _p())
    return views.pred(spark, d).groupBy("target", "model", "split", "seed").agg(_n().alias("n"), *[r[c].alias(c) for c in ("mae", "rmse", "r2")])


@query("seed_summary", """
SELECT target, model, count(*) AS n_seeds, round(avg(mae), 6) AS mean_mae, round(stddev_samp(mae), 6) AS std_mae, round(min(mae), 6) AS min_mae, round(max(mae), 6) AS max_mae, round(avg(r2), 6) AS mean_r2, round(min(r2), 6) AS min_r2, round(max(r2), 6) AS max_r2
FROM met GROUP BY 1, 2""", PRED, MET)
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Metrics over seeds."""
    a = [R6(f(c)).alias(f"{n}_{c}") for c, fs in (("mae", (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))), ("r2", (("mean", F.avg), ("min", F.min), ("max", F.max)))) for n, f in fs]
    return _met(spark, d).groupBy("target", "model").agg(_n().alias("n_seeds"), *a)


@query("paper_regression", """
SELECT target, split, model, round(avg(mae), 6) AS mae, round(avg(r2), 6) AS r2, CAST(sum(n) AS BIGINT) AS n_rows FROM met GROUP BY 1, 2, 3""", PRED, MET)
def paper_regression(spark: SparkSession, d: str) -> DataFrame:
    """Mean over seeds of each target, split and model."""
    return _met(spark, d).groupBy("target", "split", "model").agg(R6(F.avg("mae")).alias("mae"), R6(F.avg("r2")).alias("r2"), F.sum("n").alias("n_rows"))


@query("best_variant_flag", """
SELECT target, model, seed, split, row_number() OVER (PARTITION BY target, model ORDER BY round(mae, 9), split, seed) = 1 AND count(*) OVER (PARTITION BY target, model) > 1 AS is_best FROM met""", PRED, MET)
def best_variant_flag(spark: SparkSession, d: str) -> DataFrame:
    """Best variant of each target and model, where there are several."""
    w = Window.partitionBy("target", "model")
    best = (F.row_number().over(w.orderBy(F.round("mae", 9), "split", "seed")) == 1) & (F.count(F.lit(1)).over(w) > 1)
    return _met(spark, d).select("target", "model", "seed", "split", best.alias("is_best"))


@query("top3_average", """
SELECT target, round(avg(mae), 6) AS top3_mae FROM (SELECT target, mae, row_number() OVER (PARTITION BY target ORDER BY round(mae, 9), model, split, seed) AS rn FROM met) WHERE rn <= 3 GROUP BY 1""", PRED, MET)
def top3_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the three best variants."""
    best = joins.best_by(_met(spark, d), ["target"], [F.round("mae", 9), F.col("model"), F.col("split"), F.col("seed")], 3)
    return best.groupBy("target").agg(R6(F.avg("mae")).alias("top3_mae"))


@query("better_metric_compare", """
, a AS (SELECT target, split, avg(mae) AS mae, avg(r2) AS r2 FROM met WHERE model LIKE 'F%' AND NOT (target = 'quantum_yield' AND split = 'random') GROUP BY 1, 2), b AS (SELECT target, split, avg(mae) AS mae, avg(r2) AS r2 FROM met WHERE model LIKE 'O%' AND NOT (target = 'emission_nm' AND split = 'scaffold') GROUP BY 1, 2)
SELECT target, split, CASE WHEN a.mae IS NULL AND b.mae IS NULL THEN 'tie' WHEN a.mae IS NULL THEN 'O' WHEN b.mae IS NULL THEN 'F' WHEN a.mae = b.mae THEN 'tie' WHEN a.mae < b.mae THEN 'F' ELSE 'O' END AS better_mae,
  CASE WHEN a.r2 IS NULL AND b.r2 IS NULL THEN 'tie' WHEN a.r2 IS NULL THEN 'O' WHEN b.r2 IS NULL THEN 'F' WHEN a.r2 = b.r2 THEN 'tie' WHEN a.r2 > b.r2 THEN 'F' ELSE 'O' END AS better_r2 FROM a FULL JOIN b USING (target, split)""", PRED, MET)
def better_metric_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two families compared over the union of their keys; a missing metric loses."""
    m = _met(spark, d)
    side = lambda p, cond: m.filter(F.col("model").startswith(p) & ~cond).groupBy("target", "split").agg(F.avg("mae").alias(f"mae_{p}"), F.avg("r2").alias(f"r2_{p}"))
    a = side("F", (F.col("target") == "quantum_yield") & (F.col("split") == "random"))
    b = side("O", (F.col("target") == "emission_nm") & (F.col("split") == "scaffold"))
    j = a.join(b, ["target", "split"], "full")
    c = F.col
    return j.select("target", "split", bins.better(c("mae_F"), c("mae_O"), "F", "O").alias("better_mae"), bins.better(c("r2_F"), c("r2_O"), "F", "O", lower=False).alias("better_r2"))


@query("pivot_region_worst", """
, g AS (SELECT model, CASE WHEN y_true < 400 THEN 'UV' WHEN y_true < 500 THEN 'blue' WHEN y_true < 560 THEN 'green' WHEN y_true < 620 THEN 'orange' ELSE 'red' END AS region, avg(abs(y_true - y_pred)) AS mae FROM pred GROUP BY 1, 2),
p AS (SELECT model, round(max(mae) FILTER (region = 'UV'), 6) AS uv, round(max(mae) FILTER (region = 'blue'), 6) AS blue, round(max(mae) FILTER (region = 'green'), 6) AS green, round(max(mae) FILTER (region = 'orange'), 6) AS orange, round(max(mae) FILTER (region = 'red'), 6) AS red FROM g GROUP BY 1)
SELECT *, CASE greatest(uv, blue, green, orange, red) WHEN red THEN 'red' WHEN orange THEN 'orange' WHEN green THEN 'green' WHEN blue THEN 'blue' ELSE 'uv' END AS worst_region FROM p""", PRED)
def pivot_region_worst(spark: SparkSession, d: str) -> DataFrame:
    """Mean error by region as columns, and the worst of them (of equal ones, the last)."""
    cols = dict(zip(bins.REGIONS, ("uv", "blue", "green", "orange", "red"), strict=True))
    g = views.pred(spark, d).withColumn("region", bins.MANUSCRIPT.label(_y()))
    p = g.groupBy("model").pivot("region", list(cols)).agg(F.avg(F.abs(_y() - _p())))
    p = p.select("model", *[R6(f"`{r}`").alias(c) for r, c in cols.items()])
    worst = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(cols.values())]))["name"]
    return p.withColumn("worst_region", worst)


@query("modal_expected", """
, n AS (SELECT CAST(floor(y_true / 10) AS BIGINT) AS band, y_pred AS p, abs(y_pred - y_true) AS e FROM pred WHERE target = 'emission_nm'),
v AS (SELECT band, round(p - e, 6) AS value FROM n UNION ALL SELECT band, round(p + e, 6) FROM n WHERE round(p - e, 6) <> round(p + e, 6)),
c AS (SELECT band, value, count(*) AS votes FROM v GROUP BY 1, 2), r AS (SELECT band, count(*) AS n_rows FROM n GROUP BY 1)
SELECT band, value AS expected, votes, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY votes DESC, value) AS rn FROM c) JOIN r USING (band) WHERE rn = 1 AND votes >= greatest(2, n_rows // 3)""", PRED)
def modal_expected(spark: SparkSession, d: str) -> DataFrame:
    """Expected value that most predictions and errors agree on."""
    p = views.pred(spark, d).filter("target = 'emission_nm'").select(F.floor(_y() / 10).alias("band"), _p().alias("p"), F.abs(_p() - _y()).alias("e"))
    return profile.modal_value(p, ["band"], "p", "e").select("band", "expected", "votes", "n_rows")


@query("worst_50", """
SELECT molecule, solvent, model, y_true, y_pred, round(abs(y_true - y_pred), 6) AS abs_error, ord, line, price FROM pred ORDER BY abs_error DESC, ord, line, price, molecule, model, solvent, y_true LIMIT 50""", PRED)
def worst_50(spark: SparkSession, d: str) -> DataFrame:
    """The 50 largest errors (a report of the top k)."""
    p = views.pred(spark, d).select("molecule", "solvent", "model", "y_true", "y_pred", R6(F.abs(_y() - _p())).alias("abs_error"), "ord", "line", "price")
    return p.orderBy(F.col("abs_error").desc(), "ord", "line", "price", "molecule", "model", "solvent", "y_true").limit(50)


@query("mae_rmse_r2", """
SELECT target, model, count(*) AS n_rows, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (count(*) * var_pop(y_true)), 6) AS r2,
  round(median(abs(y_true - y_pred)), 6) AS median_ae, round(avg(abs(1240.0::DOUBLE / y_true - 1240.0::DOUBLE / y_pred)), 6) AS mae_ev FROM pred GROUP BY 1, 2""", PRED)
def mae_rmse_r2(spark: SparkSession, d: str) -> DataFrame:
    """Regression metrics, in nm and eV."""
    r, ev = metrics.regression(_y(), _p()), metrics.regression_ev(_y(), _p())
    return views.pred(spark, d).groupBy("target", "model").agg(_n().alias("n_rows"), *[R6(v).alias(k) for k, v in r.items()], R6(F.median(F.abs(_y() - _p()))).alias("median_ae"), R6(ev["mae_ev"]).alias("mae_ev"))


@query("classification_counts", """
, c AS (SELECT model, count(*) FILTER (y_true > 550 AND y_pred > 550) AS tp, count(*) FILTER (y_true <= 550 AND y_pred > 550) AS fp, count(*) FILTER (y_true > 550 AND y_pred <= 550) AS fn, count(*) FILTER (y_true <= 550 AND y_pred <= 550) AS tn FROM pred GROUP BY 1)
SELECT model, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""", PRED)
def classification_counts(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts and rates of a bright class."""
    c = metrics.confusion(_y() > 550, _p() > 550)
    out = metrics.classification(views.pred(spark, d).groupBy("model").agg(*[v.alias(k) for k, v in c.items()]))
    return out.select("model", "tp", "fp", "fn", "tn", *[R6(x).alias(x) for x in ("accuracy", "precision", "recall", "f1", "balanced_accuracy")])


@query("roc_auc_rank", """
, r AS (SELECT model, y_true > 550 AS a, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2 AS rk FROM pred)
SELECT model, round((sum(rk) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2) / (count(*) FILTER (a) * count(*) FILTER (NOT a)), 6) AS roc_auc FROM r GROUP BY 1""", PRED)
def roc_auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve by rank sums."""
    return metrics.roc_auc(views.pred(spark, d), ["model"], _y() > 550, "y_pred").select("model", R6("roc_auc").alias("roc_auc"))


@query("spearman_rank", """
, r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2 AS a, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2 AS b FROM pred)
SELECT model, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""", PRED)
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with averaged ties."""
    return metrics.spearman(views.pred(spark, d), ["model"], "y_true", "y_pred").select("model", R6("spearman").alias("spearman"))


@query("ols_fit", """
SELECT model, target, round(corr(y_true, y_pred), 6) AS pearson_r, round(regr_slope(y_pred, y_true), 6) AS slope, round(regr_intercept(y_pred, y_true), 6) AS intercept FROM pred GROUP BY 1, 2""", PRED)
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and line of predictions over actual values."""
    return views.pred(spark, d).groupBy("model", "target").agg(*[R6(v).alias(k) for k, v in metrics.line_fit(_y(), _p()).items()])


@query("known_value_error", """
SELECT target, round(avg(y_pred - y_true), 6) AS mean_residual, round(avg(abs(y_pred - y_true)), 6) AS mean_abs, count(*) FILTER (y_pred < y_true) AS n_under FROM pred GROUP BY 1""", PRED)
def known_value_error(spark: SparkSession, d: str) -> DataFrame:
    """Predicted less known value (the sign opposite to residuals elsewhere)."""
    return views.pred(spark, d).groupBy("target").agg(R6(F.avg(_p() - _y())).alias("mean_residual"), R6(F.avg(F.abs(_p() - _y()))).alias("mean_abs"), F.count_if(_p() < _y()).alias("n_under"))


@query("ensemble_mean_std", """
SELECT molecule, count(*) AS n, round(avg(y_pred), 6) AS mean, round(stddev_pop(y_pred), 6) AS std, coalesce(stddev_pop(y_pred) >= 50, false) AS caution FROM pred WHERE target = 'emission_nm' GROUP BY 1""", PRED)
def ensemble_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Ensemble mean, population deviation and caution."""
    std = F.stddev_pop(_p())
    return views.pred(spark, d).filter("target = 'emission_nm'").groupBy("molecule").agg(_n().alias("n"), R6(F.avg(_p())).alias("mean"), R6(std).alias("std"), scalars.uncertainty_caution(std, F.lit(None).cast("double")).alias("caution"))


def _weights_sql(first: int, rounds: int = 500, seed: int = 0) -> str:
    """Tables down to ``w``, the weight of each model, pair of values and round."""
    prime = metrics.PRIME

    def unit(salt: int) -> str:
        salt += 7_919 * seed
        h = f"((((((ky % {prime}) + {prime}) % {prime}) * 48271 + (((kp % {prime}) + {prime}) % {prime}) * 69621 + r * 40692 + {salt}) % {prime})"
        return h

    steps = " ".join(f"WHEN {n} THEN " + " + ".join(f"(u1 >= {t!r}::DOUBLE)::INT" for t in metrics.poisson_steps(n)) for n in range(1, metrics.SMALL_COUNT + 1))
    stages = ", ".join(f"""
h{k}a AS (SELECT *, {unit(salt)}) AS h{k} FROM {'x' if k == 1 else 'h1d'}),
h{k}b AS (SELECT * REPLACE ((h{k} * h{k} + 16807) % {prime} AS h{k}) FROM h{k}a), h{k}c AS (SELECT * REPLACE ((h{k} * 630360016 + 12345) % {prime} AS h{k}) FROM h{k}b),
h{k}d AS (SELECT *, ((h{k} * h{k} + {salt + 7_919 * seed}) % {prime} + 0.5::DOUBLE) / {prime} AS u{k} FROM h{k}c)""" for k, salt in ((1, 101), (2, 202)))
    return f"""
, g AS (SELECT model, y_true AS y, y_pred AS p, count(*) AS c FROM pred WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT *, CAST(round(y * {metrics.SCALE}) AS BIGINT) AS ky, CAST(round(p * {metrics.SCALE}) AS BIGINT) AS kp, unnest(range({first}, {rounds})) AS r FROM g), {stages},
w AS (SELECT *, CASE WHEN r < 0 THEN c ELSE CASE c {steps} ELSE greatest(0, floor(c + sqrt(c::DOUBLE) * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) + 0.5)) END END::DOUBLE AS w FROM h2d)"""


def _bootstrap_sql() -> str:
    return f"""{_weights_sql(0)},
s AS (SELECT model, r, sum(w) AS n, sum(w * y) AS sy, sum(w * y * y) AS syy, sum(w * abs(y - p)) AS sa, sum(w * (y - p) * (y - p)) AS se FROM w WHERE w > 0 GROUP BY 1, 2),
m AS (SELECT model, sa / n AS mae, sqrt(se / n) AS rmse, CASE WHEN syy - sy * sy / n > 0 THEN 1 - se / (syy - sy * sy / n) END AS r2 FROM s)
SELECT model, """ + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{n}" for m in ("mae", "rmse", "r2") for q, n in ((0.025, "low"), (0.975, "high"))) + " FROM m GROUP BY 1"


@query("bootstrap_ci", _bootstrap_sql(), PRED)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of each model's metrics."""
    b = metrics.bootstrap(views.pred(spark, d), ["model"], "y_true", "y_pred")
    return b.select("model", *[R6(c).alias(c) for c in b.columns[1:]])


BOOTSTRAP_METRICS = _weights_sql(-1) + """,
e AS (SELECT *, abs(y - p) AS e, 1240.0::DOUBLE / y - 1240.0::DOUBLE / p AS v FROM w WHERE w > 0),
s AS (SELECT model, r, sum(w) AS n, sum(w * y) AS sy, sum(w * y * y) AS syy, sum(w * e) AS sa, sum(w * e * e) AS se, sum(w * abs(v)) AS sv, sum(w * v * v) AS svv, bool_and(y > 0 AND p > 0) AS good FROM e GROUP BY 1, 2),
o AS (SELECT model, r, e, sum(w) OVER (PARTITION BY model, r) AS n, sum(w) OVER (PARTITION BY model, r ORDER BY e, y, p ROWS UNBOUNDED PRECEDING) AS upto FROM e),
d AS (SELECT model, r, (min(e) FILTER (upto > floor((n - 1) / 2)) + min(e) FILTER (upto > ceil((n - 1) / 2))) / 2 AS value FROM o GROUP BY 1, 2),
l AS (SELECT model, r, 'mae' AS metric, sa / n AS value FROM s UNION ALL SELECT model, r, 'rmse', sqrt(se / n) FROM s UNION ALL SELECT model, r, 'r2', CASE WHEN n > 1 AND syy - sy * sy / n > 0 THEN 1 - se / (syy - sy * sy / n) END FROM s
  UNION ALL SELECT model, r, 'mae_ev', CASE WHEN good THEN sv / n END FROM s UNION ALL SELECT model, r, 'rmse_ev', CASE WHEN good THEN sqrt(svv / n) END FROM s UNION ALL SELECT model, r, 'median_absolute_error', value FROM d)
SELECT model, metric, round(max(value) FILTER (r < 0), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (r >= 0), 6) AS ci_lower, round(quantile_cont(value, 0.975) FILTER (r >= 0), 6) AS ci_upper, count(value) FILTER (r >= 0) AS usable FROM l GROUP BY 1, 2"""


@query("bootstrap_metrics", BOOTSTRAP_METRICS, PRED)
def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Estimates and bootstrap intervals of six metrics of each model."""
    b = metrics.bootstrap_metrics(views.pred(spark, d), ["model"], "y_true", "y_pred")
    return b.select("model", "metric", *[R6(c).alias(c) for c in ("estimate", "ci_lower", "ci_upper")], "usable")


@query("greedy_scaffold_split", """
, g AS (SELECT scaffold, count(*) AS n FROM mol GROUP BY 1), s AS (SELECT scaffold, n, coalesce(sum(n) OVER (ORDER BY n DESC, scaffold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
SELECT m.molecule_id, m.scaffold, CASE WHEN before < round(total * 0.2) THEN 'test' ELSE 'train' END AS split FROM mol m JOIN s ON m.scaffold IS NOT DISTINCT FROM s.scaffold""", MOL)
def greedy_scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    """Largest scaffolds to test until the share is met."""
    return splits.greedy_group_split(views.mol(spark, d), "scaffold").select("molecule_id", "scaffold", "split")


@query("anti_leakage", """
, a AS (SELECT DISTINCT molecule FROM pred WHERE split = 'random'), b AS (SELECT DISTINCT molecule FROM pred WHERE split = 'scaffold')
SELECT (SELECT count(*) FROM a) AS train_groups, (SELECT count(*) FROM b) AS test_groups, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared_groups""", PRED)
def anti_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Groups on each side of a split and on both."""
    side = F.when(F.col("split") == "random", "train").when(F.col("split") == "scaffold", "test")
    return joins.leakage(views.pred(spark, d).withColumn("split", side), "molecule")


def _group_split_sql(test: str, seed: int, groups: str) -> str:
    return f"SELECT scaffold, row_number() OVER (ORDER BY md5(coalesce(scaffold, '') || '|{seed}'), scaffold) - 1 < ceil(count(*) OVER () * {test}) AS picked FROM (SELECT DISTINCT scaffold FROM {groups})"


@query("group_hash_split", f"""
, s AS ({_group_split_sql("0.2::DOUBLE", 42, "mol")})
SELECT m.molecule_id, m.scaffold, CASE WHEN picked THEN 'test' ELSE 'train' END AS split FROM mol m JOIN s ON m.scaffold IS NOT DISTINCT FROM s.scaffold""", MOL)
def group_hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Groups ordered by hash; the first fifth of them is the test side."""
    return splits.group_split(views.mol(spark, d), "scaffold").select("molecule_id", "scaffold", "split")


@query("split_dataset_counts", f"""
, s AS ({_group_split_sql("0.2::DOUBLE", 42, "mol")}), a AS (SELECT m.*, picked FROM mol m JOIN s ON m.scaffold IS NOT DISTINCT FROM s.scaffold), r AS (SELECT * FROM a WHERE NOT picked),
v AS ({_group_split_sql(f"{min(0.5, max(0.05, 0.1 / 0.8))!r}::DOUBLE", 43, "r")}),
t AS (SELECT 'test' AS split, molecule_id, scaffold FROM a WHERE picked UNION ALL SELECT CASE WHEN v.picked THEN 'val' ELSE 'train' END, r.molecule_id, r.scaffold FROM r JOIN v ON r.scaffold IS NOT DISTINCT FROM v.scaffold)
SELECT split, count(*) AS n_rows, count(DISTINCT molecule_id) AS n_molecules, count(DISTINCT scaffold) AS n_scaffolds FROM t GROUP BY 1""", MOL)
def split_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, molecules and scaffolds of a three-way split by group."""
    return splits.split_counts(splits.group_split_three(views.mol(spark, d), "scaffold"), "molecule_id", "scaffold")


TRAIN = """tr AS (SELECT *, CASE WHEN molecule_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM mol)"""


@query("train_median_impute", """
, m AS (SELECT median(log_extinction) a, median(similarity) b FROM tr WHERE split = 'train')
SELECT molecule_id, round(coalesce(log_extinction, a, 0), 6) AS log_extinction_imputed, round(coalesce(similarity, b, 0), 6) AS similarity_imputed FROM tr, m""", MOL, TRAIN)
def train_median_impute(spark: SparkSession, d: str) -> DataFrame:
    """Missing descriptors from medians of the training side only."""
    m = views.mol(spark, d).withColumn("split", F.when(F.col("molecule_id") % 5 == 0, "test").otherwise("train"))
    out = splits.impute(m, ["log_extinction", "similarity"])
    return out.select("molecule_id", R6("log_extinction_imputed").alias("log_extinction_imputed"), R6("similarity_imputed").alias("similarity_imputed"))


@query("standard_scaling", """
, m AS (SELECT avg(size) a, stddev_pop(size) s, avg(predicted_qy) b, stddev_pop(predicted_qy) t FROM tr WHERE split = 'train')
SELECT molecule_id, round((size - a) / s, 6) AS size_scaled, round((predicted_qy - b) / t, 6) AS predicted_qy_scaled FROM tr, m""", MOL, TRAIN)
def standard_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Scaling by population statistics of the training side."""
    m = views.mol(spark, d).withColumn("split", F.when(F.col("molecule_id") % 5 == 0, "test").otherwise("train"))
    return splits.standardize(m, ["size", "predicted_qy"]).select("molecule_id", R6("size_scaled").alias("size_scaled"), R6("predicted_qy_scaled").alias("predicted_qy_scaled"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Source-preferred deduplication, then errors of a constant shift by region, in order."""
    kept = dedup.keep_source_preferred(views.meas(spark, d), views.KEY, [F.col("ord"), F.col("line")])
    p = kept.select(F.col("emission_nm").alias("y_true"), (F.col("absorption_nm") + 60).alias("y_pred")).na.drop()
    e = profile.grouped_errors(p, bins.MANUSCRIPT.label(_y()), "region")
    return e.withColumn("region_rank", bins.MANUSCRIPT.rank(F.col("region"))).orderBy("region_rank")
