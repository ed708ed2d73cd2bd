"""Queries over reports, stored predictions, documents, graphs and small learners."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, attribution, diagnose, experiments, forest, graph, learners, metrics, models, reports
from ..sources import readers
from . import predictions, views
from .catalog import query
from .molecules import EDGES, ORDER_IDS
from .predictions import BENCH, LADDER, MET
from .views import MEAS, PRED

R6 = lambda c: F.round(c, 6)


@query("emission_paper_table", """
SELECT split, model, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2, CASE split WHEN 'random' THEN 'Rows are split at random, so molecules may be on both sides: interpolation.'
  WHEN 'molecule' THEN 'Molecules are held out whole: transfer to new molecules.' ELSE 'Scaffolds are held out whole: the strongest test of extrapolation.' END AS comment FROM met WHERE target = 'emission_nm' GROUP BY 1, 2""", PRED, MET)
def emission_paper_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean errors of the emission models by split."""
    t = reports.emission_table(predictions._met(spark, d))
    return t.select("split", "model", *[R6(c).alias(c) for c in ("mae", "rmse", "r2")], "comment")


@query("yield_paper_table", """
, cl AS (SELECT split, model, seed, count(*) FILTER ((y_true > 550) = (y_pred > 550)) / count(*) AS accuracy, 2.0::DOUBLE * count(*) FILTER (y_true > 550 AND y_pred > 550) / nullif(count(*) FILTER (y_true > 550) + count(*) FILTER (y_pred > 550), 0) AS f1
  FROM pred WHERE target = 'emission_nm' AND model <> 'F0' GROUP BY 1, 2, 3), c AS (SELECT split, model, avg(accuracy) AS a, avg(f1) AS f FROM cl GROUP BY 1, 2), q AS (SELECT split, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM met WHERE target = 'quantum_yield' GROUP BY 1, 2)
SELECT split, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(a, 6) AS bright_accuracy, round(f, 6) AS bright_f1 FROM q LEFT JOIN c USING (split, model)""", PRED, MET)
def yield_paper_table(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the yield models joined with their classifiers' means; a model without a classifier stays."""
    p = views.pred(spark, d).filter("target = 'emission_nm' AND model <> 'F0'")
    c = metrics.confusion(F.col("y_true") > 550, F.col("y_pred") > 550)
    cl = p.groupBy("split", "model", "seed").agg(*[v.alias(k) for k, v in c.items()])
    cl = cl.select("split", "model", "seed", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    t = reports.yield_table(predictions._met(spark, d), cl)
    return t.select("split", "model", *[R6(x).alias(x) for x in ("mae", "rmse", "r2", "bright_accuracy", "bright_f1")])


@query("graph_paper_table", """
SELECT model, count(DISTINCT seed) FILTER (target = 'emission_nm') AS seeds, round(avg(mae) FILTER (target = 'emission_nm'), 6) AS emission_mae_mean, round(stddev_samp(mae) FILTER (target = 'emission_nm'), 6) AS emission_mae_std,
  round(min(mae) FILTER (target = 'emission_nm'), 6) AS best_seed_mae, round(avg(mae) FILTER (target = 'quantum_yield'), 6) AS yield_mae FROM met GROUP BY 1""", PRED, MET)
def graph_paper_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a model over targets and seeds."""
    t = reports.graph_table(predictions._met(spark, d))
    return t.select("model", "seeds", *[R6(c).alias(c) for c in t.columns[2:]])


SUBSETS = """tab AS (SELECT molecule, CASE WHEN family = 'F' THEN 'tree' ELSE 'graph_neural' END AS model_family, CASE WHEN family = 'F' THEN model WHEN model = 'O0' THEN 'Graph_GIN_0' ELSE 'graph_gcn_' || model END AS model,
  CASE WHEN target = 'emission_nm' THEN y_pred END AS e, CASE WHEN target = 'quantum_yield' THEN similarity END AS q FROM pred),
cells AS (SELECT 'all_emission' AS subset, e AS v FROM tab UNION ALL SELECT 'tree_neural_emission', e FROM tab WHERE model_family IN ('tree', 'neural') UNION ALL SELECT 'graph_emission', e FROM tab WHERE model_family = 'graph_neural'
  UNION ALL SELECT 'graph_gin_emission', e FROM tab WHERE model_family = 'graph_neural' AND lower(model) LIKE '%graph_gin%' UNION ALL SELECT 'graph_gcn_emission', e FROM tab WHERE model_family = 'graph_neural' AND lower(model) LIKE '%graph_gcn%'
  UNION ALL SELECT 'all_quantum_yield', q FROM tab UNION ALL SELECT 'graph_quantum_yield', q FROM tab WHERE model_family = 'graph_neural')"""


@query("disagreement_subsets", """
SELECT subset, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(max(v) - min(v), 6) AS range,
  CASE WHEN max(v) IS NULL THEN 'unknown' WHEN subset LIKE '%emission' THEN CASE WHEN max(v) - min(v) < 20 THEN 'low' WHEN max(v) - min(v) < 60 THEN 'moderate' ELSE 'high' END
  ELSE CASE WHEN max(v) - min(v) < 0.10 THEN 'low' WHEN max(v) - min(v) < 0.25 THEN 'moderate' ELSE 'high' END END AS level FROM cells GROUP BY 1""", PRED, SUBSETS)
def disagreement_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Disagreement of the models in seven subsets, for emission and quantum yield."""
    f = F.col("family") == "F"
    t = views.pred(spark, d).select(
        F.when(f, "tree").otherwise("graph_neural").alias("model_family"), F.when(f, F.col("model")).when(F.col("model") == "O0", "Graph_GIN_0").otherwise(F.concat(F.lit("graph_gcn_"), "model")).alias("model"),
        F.when(F.col("target") == "emission_nm", F.col("y_pred")).alias("predicted_emission_nm"), F.when(F.col("target") == "quantum_yield", F.col("similarity")).alias("predicted_quantum_yield"),
    )
    out = artifacts.disagreement(t)
    return out.select("subset", "n", *[R6(c).alias(c) for c in ("mean", "median", "std")], "min", "max", R6("range").alias("range"), "level")


@query("attach_confidence", """
SELECT b.molecule, b.solvent, count(*) AS n, count(f.molecule) AS n_diagnosed, bool_or(f.pair_seen) AS pair_seen, round(max(f.predicted_mean), 6) AS predicted_mean FROM bench b LEFT JOIN (SELECT * FROM f WHERE molecule <> 'M7') f ON b.molecule = f.molecule AND b.solvent = f.solvent GROUP BY 1, 2""", PRED, BENCH, MEAS, LADDER)
def attach_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the diagnosis of their pair; those without one (here, of one molecule) stay."""
    cases = predictions._cases(spark, d).filter("molecule <> 'M7'")
    out = diagnose.attach_confidence(predictions._bench(spark, d), cases, ["molecule", "solvent"])
    return out.groupBy("molecule", "solvent").agg(F.count(F.lit(1)).alias("n"), F.count("confidence_label").alias("n_diagnosed"), F.bool_or("pair_seen").alias("pair_seen"), R6(F.max("predicted_mean")).alias("predicted_mean"))


@query("row_ordinal", "SELECT p_partkey, row_number() OVER () - 1 AS row_index FROM part")
def row_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Rows numbered as they are read."""
    return readers.with_ordinal(views._t(spark, d, "part")).select("p_partkey", "row_index")


@query("metric_rows", """
SELECT 'split' || (event_id % 7) AS split, 'task' AS task, m AS metric, CAST(CASE m WHEN 'mae' THEN event_id * 0.5 ELSE event_id END AS DOUBLE) AS value FROM events, (SELECT unnest(['mae', 'rows']) AS m)""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metrics documents as rows; texts among the metrics are left out."""
    e = views._t(spark, d, "events").select("event_id")
    inner = F.create_map(F.lit("mae"), (F.col("event_id") * 0.5).cast("string"), F.lit("rows"), F.col("event_id").cast("string"), F.lit("model"), F.lit("rf"))
    doc = F.to_json(F.create_map(F.concat(F.lit("split"), (F.col("event_id") % 7).cast("string")), F.create_map(F.lit("task"), inner), F.lit("dataset"), F.create_map(F.lit("task"), inner)))
    return reports.metric_rows(e.select(doc.alias("doc")), "doc")


@query("prediction_flatten", """
SELECT 'M' || event_id AS molecule, CAST(event_id AS DOUBLE) AS emission_nm, event_id + 2.5::DOUBLE AS known_emission_nm, 2.5::DOUBLE AS error_emission_nm, -2.5::DOUBLE AS residual_emission_nm, event_id % 3 AS exact_reference_match_count FROM events""")
def prediction_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Prediction documents as one row each."""
    i = F.col("event_id").cast("string")
    doc = F.concat(F.lit('{"molecule": "M'), i, F.lit('", "predictions": {"emission_nm": '), i, F.lit('}, "known_values": {"emission_nm": '), (F.col("event_id") + 2.5).cast("string"), F.lit('}, "errors": {"emission_nm": {"absolute_error": 2.5, "residual": -2.5}}, "exact_reference_matches": {"count": '), (F.col("event_id") % 3).cast("string"), F.lit("}}"))
    out = reports.flatten_prediction(views._t(spark, d, "events").select(doc.alias("doc")), "doc", ["emission_nm"])
    return out.select("molecule", "emission_nm", "known_emission_nm", "error_emission_nm", "residual_emission_nm", "exact_reference_match_count")


VECTORS = """x AS (SELECT n AS node, (n % 7) * 1.0::DOUBLE AS a, (n % 5) * -0.5::DOUBLE AS b FROM (SELECT DISTINCT src AS n FROM edges UNION SELECT dst FROM edges)), e2 AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = views._t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDER_IDS).alias("dst")).distinct()
    n = F.col("node")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("h", F.array((n % 7) * 1.0, (n % 5) * -0.5))
    return nodes, graph.both_ways(e)


@query("gin_layer", """
, s AS (SELECT x.node, 1.5 * x.a + coalesce(sum(y.a), 0) AS a, 1.5 * x.b + coalesce(sum(y.b), 0) AS b FROM x LEFT JOIN e2 ON e2.dst = x.node LEFT JOIN x y ON y.node = e2.src GROUP BY x.node, x.a, x.b)
SELECT node, round(greatest(0.5 * a - 1.0 * b + 0.1, 0), 6) AS h0, round(greatest(-0.25 * a + 2.0 * b, 0), 6) AS h1 FROM s""", EDGES, VECTORS)
def gin_layer(spark: SparkSession, d: str) -> DataFrame:
    """Graph isomorphism step over the whole graph of customers and orders."""
    nodes, edges = _vectors(spark, d)
    out = graph.gin_layer(nodes, edges, "h", [[0.5, -1.0], [-0.25, 2.0]], [0.1, 0.0], epsilon=0.5)
    return out.select("node", R6(F.col("h")[0]).alias("h0"), R6(F.col("h")[1]).alias("h1"))


@query("gcn_layer", """
, g AS (SELECT node, 1.0::DOUBLE + count(e2.src) AS deg, any_value(a) AS a, any_value(b) AS b FROM x LEFT JOIN e2 ON e2.dst = x.node GROUP BY node),
s AS (SELECT t.node, t.a / t.deg + coalesce(sum(y.a / sqrt(y.deg * t.deg)), 0) AS a, t.b / t.deg + coalesce(sum(y.b / sqrt(y.deg * t.deg)), 0) AS b FROM g t LEFT JOIN e2 ON e2.dst = t.node LEFT JOIN g y ON y.node = e2.src GROUP BY t.node, t.a, t.b, t.deg)
SELECT node, round(greatest(0.5 * a - 1.0 * b, 0), 6) AS h0, round(greatest(1.0 * a + 1.0 * b, 0), 6) AS h1 FROM s""", EDGES, VECTORS)
def gcn_layer(spark: SparkSession, d: str) -> DataFrame:
    """Graph convolution over the whole graph of customers and orders."""
    nodes, edges = _vectors(spark, d)
    out = graph.gcn_layer(nodes, edges, "h", [[0.5, -1.0], [1.0, 1.0]])
    return out.select("node", R6(F.col("h")[0]).alias("h0"), R6(F.col("h")[1]).alias("h1"))


@query("mpnn_layer", """
, s AS (SELECT x.node, x.a AS xa, x.b AS xb, coalesce(avg(y.a), 0) AS a, coalesce(avg(y.b), 0) AS b FROM x LEFT JOIN e2 ON e2.dst = x.node LEFT JOIN x y ON y.node = e2.src GROUP BY x.node, x.a, x.b)
SELECT CASE WHEN node >= 10000000000 THEN 'order' ELSE 'customer' END AS graph, count(*) AS n, round(avg(greatest(xa - xb + 0.5 * a, 0)), 6) AS mean_pool, round(max(greatest(xa - xb + 0.5 * a, 0)), 6) AS max_pool FROM s GROUP BY 1""", EDGES, VECTORS)
def mpnn_layer(spark: SparkSession, d: str) -> DataFrame:
    """A message passing step, then mean and maximum over the nodes of each side."""
    nodes, edges = _vectors(spark, d)
    out = graph.mpnn_layer(nodes, edges, "h", [[1.0, -1.0]], [[0.5, 0.0]]).withColumn("graph", F.when(F.col("node") >= ORDER_IDS, "order").otherwise("customer"))
    n = out.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    p = graph.pool_vectors(out, "h", ["graph"], 1)
    return n.join(p, "graph").select("graph", "n", R6(F.col("pooled")[0]).alias("mean_pool"), R6(F.col("pooled")[1]).alias("max_pool"))


@query("region_histogram", """
SELECT floor(y_true / 25) * 25 AS bin_start, count(*) AS n FROM pred GROUP BY 1""", PRED)
def region_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The data behind a histogram."""
    return reports.histogram(views.pred(spark, d), "y_true", 25.0)


@query("density_grid", """
SELECT floor(y_true / 50) * 50 AS y_true, floor(y_pred / 50) * 50 AS y_pred, count(*) AS n FROM pred GROUP BY 1, 2""", PRED)
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    """The data behind a scatter chart of any number of points."""
    return reports.scatter_density(views.pred(spark, d), "y_true", "y_pred", 50.0)


@query("extra_trees")
def extra_trees(spark: SparkSession, d: str) -> DataFrame:
    """Extra trees grown on all rows, and their metrics over all rows."""
    names = ["y_pred", "similarity", "seed"]
    p = views.pred(spark, d)
    fitted = forest.fit_extra_trees(p, names, "y_true", trees=8, max_depth=8)
    r = metrics.regression(F.col("y_true"), F.col("prediction"))
    return learners.predict(p, names, fitted).agg(F.count("prediction").alias("n"), *[v.alias(k) for k, v in r.items()])


STUMPS = 9


@query("forest_stumps", f"""
, x AS (SELECT y_true AS y, v, f FROM pred, LATERAL (VALUES (0, y_pred::DOUBLE), (1, similarity::DOUBLE), (2, seed::DOUBLE)) AS u(f, v) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND similarity IS NOT NULL AND seed IS NOT NULL),
r AS (SELECT f, min(v) AS low, max(v) AS high FROM x GROUP BY 1), c AS (SELECT tree, f, low + (high - low) * ((tree + 1)::DOUBLE / {STUMPS + 1}) AS cut FROM r, (SELECT unnest(range({STUMPS})) AS tree)),
s AS (SELECT tree, f, cut, count(*) FILTER (v < cut) AS nl, sum(y) FILTER (v < cut) AS sl, count(*) AS n, sum(y) AS s FROM c JOIN x USING (f) GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f) AS k FROM s WHERE nl >= 2 AND n - nl >= 2)
SELECT tree, f AS feature, round(cut, 6) AS cut, round(sl / nl, 6) AS value_left, round((s - sl) / (n - nl), 6) AS value_right FROM g WHERE k = 1""", PRED)
def forest_stumps(spark: SparkSession, d: str) -> DataFrame:
    """A forest of depth one with fixed cuts: each tree's best feature, and the values on both sides."""
    fixed = lambda tree, nodes, features, attempt: np.full((len(nodes), features), (tree + 1) / (STUMPS + 1))
    trees = forest.fit_extra_trees(views.pred(spark, d), ["y_pred", "similarity", "seed"], "y_true", trees=STUMPS, max_depth=1, draw=fixed)
    rows = spark.createDataFrame(forest.node_table(trees), "tree int, node int, feature int, cut double, value_left double, value_right double")
    return rows.select("tree", "feature", *[F.round(c, 6).alias(c) for c in ("cut", "value_left", "value_right")])


#: A fixed tree: the paths' values, and their tests (feature, threshold, goes left, share of rows).
FIXED_TREE = ((450.0, ((0, 500.0, True, 0.4), (1, 0.5, True, 0.25))), (480.0, ((0, 500.0, True, 0.4), (1, 0.5, False, 0.75))), (600.0, ((0, 500.0, False, 0.6),)))


@query("tree_attribution", """
, r AS (SELECT y_pred::DOUBLE AS a, similarity::DOUBLE AS b, a <= 500 AS left_a, b <= 0.5 AS left_b FROM pred WHERE y_pred IS NOT NULL AND similarity IS NOT NULL),
w AS (SELECT a, b, 0.4::DOUBLE * (0.25::DOUBLE * 450 + 0.75::DOUBLE * 480) + 0.6::DOUBLE * 600 AS none, CASE WHEN left_a THEN 0.25::DOUBLE * 450 + 0.75::DOUBLE * 480 ELSE 600 END AS know_a,
  0.4::DOUBLE * CASE WHEN left_b THEN 450 ELSE 480 END + 0.6::DOUBLE * 600 AS know_b, CASE WHEN NOT left_a THEN 600 WHEN left_b THEN 450 ELSE 480 END::DOUBLE AS know FROM r),
c AS (SELECT 'y_pred' AS feature, a AS v, (know_a - none + know - know_b) / 2 AS c FROM w UNION ALL SELECT 'similarity', b, (know_b - none + know - know_a) / 2 FROM w)
SELECT feature, round(avg(abs(c)), 6) AS mean_abs, round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(max(c), 6) AS max, round(corr(v, c), 6) AS direction FROM c GROUP BY 1""", PRED)
def tree_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of a fixed tree over all predictions: the summary by feature."""
    paths = [attribution.path_of(value, list(tests)) for value, tests in FIXED_TREE]
    rows = attribution.attribute(views.pred(spark, d), "ord", ["y_pred", "similarity"], paths)
    return attribution.summary(rows).select("feature", *[F.round(c, 6).alias(c) for c in ("mean_abs", "mean", "min", "max", "direction")])


@query("stacked_models")
def stacked_models(spark: SparkSession, d: str) -> DataFrame:
    """A line over out-of-fold predictions of two base models."""
    p = views.pred(spark, d).filter("target = 'emission_nm'").select("molecule", "y_true", "y_pred", "similarity")
    base, line = models.stack(p, ["y_pred", "similarity"], "y_true", "molecule", ("rf", "linear"), 2, {"rf": {"numTrees": 3, "maxDepth": 4, "seed": 1}})
    r = metrics.regression(F.col("y_true"), F.col("prediction"))
    return models.predict_stack(base, line, p).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in r.items()])


@query("experiment_matrix")
def experiment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Two models, two splits, one seed: saved predictions and the metrics recomputed from them."""
    import uuid

    from ..streaming.jobs import shared_folder

    p = views.pred(spark, d).filter("target = 'emission_nm'").withColumn("row_key", F.concat_ws("|", "ord", "line", "price"))
    fits = {"linear": experiments.mllib("linear"), "rf": experiments.mllib("rf", numTrees=3, maxDepth=4)}
    p = p.drop("target", "model", "split", "seed").withColumn("emission_nm", F.col("y_true"))
    return experiments.run_matrix(p, ["y_pred", "similarity"], ["emission_nm"], fits, ["random", "molecule"], [0], "row_key", {"molecule": "molecule"}, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")[0]
