"""Queries over molecules, fingerprints, jobs and texts: neighbours, screening, scalars, JSON, graphs, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins, scalars
from ..operators import graph, joins, neighbours, ordering, screening
from ..streaming import jobs as job_queue
from . import views
from .catalog import query
from .views import JOBS, MOL

R6 = lambda c: F.round(c, 6)


def _n() -> Column:
    return F.count(F.lit(1))


KNN = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, label FROM embeddings),
pairs AS (SELECT q.vec_id AS candidate_id, r.vec_id AS reference_id, r.label AS reference_label, list_sum(list_transform(list_zip(q.b, r.b), lambda x: x[1] & x[2]))::DOUBLE / list_sum(list_transform(list_zip(q.b, r.b), lambda x: x[1] | x[2])) AS similarity
  FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(similarity, 0) DESC, reference_id) AS rank FROM pairs)"""


def _top(spark: SparkSession, d: str, k: int) -> DataFrame:
    f = views.fp(spark, d)
    queries = f.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("candidate_id"), "fp")
    refs = f.select(F.col("vec_id").alias("reference_id"), "fp")
    return neighbours.top_k(queries, refs, k, exclude_self=True)


@query("knn_top1", "SELECT candidate_id, reference_id, round(coalesce(similarity, 0), 6) AS similarity FROM top WHERE rank = 1", KNN)
def knn_top1(spark: SparkSession, d: str) -> DataFrame:
    """Nearest other fingerprint of each query."""
    return _top(spark, d, 1).select("candidate_id", "reference_id", R6("similarity").alias("similarity"))


@query("knn_topk_payload", """
SELECT candidate_id, round(avg(coalesce(similarity, 0)), 6) AS mean_similarity, round(max(coalesce(similarity, 0)), 6) AS max_similarity, string_agg(reference_id, ',' ORDER BY rank) AS neighbours FROM top WHERE rank <= 5 GROUP BY 1""", KNN)
def knn_topk_payload(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest neighbours of each query, and their mean similarity."""
    s = neighbours.neighbour_summary(_top(spark, d, 5))
    return s.select("candidate_id", R6("mean_similarity").alias("mean_similarity"), R6("max_similarity").alias("max_similarity"), "neighbours")


SETS = """b AS (SELECT DISTINCT conv_id * 1000 + turn AS id, CAST('0x' || substr(md5(unnest(regexp_extract_all(text, '[^ .,]+'))), 1, 8) AS BIGINT) % 2048 AS bit FROM conversations),
i AS (SELECT DISTINCT conv_id * 1000 + turn AS id FROM conversations), n AS (SELECT id, count(bit) AS n FROM i LEFT JOIN b USING (id) GROUP BY 1),
o AS (SELECT q.id AS candidate_id, r.id AS reference_id, count(*) AS shared FROM b q JOIN b r ON q.bit = r.bit AND q.id <> r.id WHERE q.id // 1000 % 50 = 0 GROUP BY 1, 2),
p AS (SELECT q.id AS candidate_id, r.id AS reference_id, coalesce(coalesce(shared, 0)::DOUBLE / nullif(q.n + r.n - coalesce(shared, 0), 0), 0) AS similarity
  FROM n q JOIN n r ON q.id <> r.id LEFT JOIN o ON o.candidate_id = q.id AND o.reference_id = r.id WHERE q.id // 1000 % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY similarity DESC, reference_id) AS rank FROM p)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as fingerprints of 2,048 bits: each word sets the bit of its hash."""
    bits = F.transform(F.regexp_extract_all("text", F.lit("[^ .,]+"), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 2048)
    return views._t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_distinct(bits).alias("bits"))


@query("knn_sets_top1", "SELECT candidate_id, reference_id, round(similarity, 6) AS similarity FROM top WHERE rank = 1", SETS)
def knn_sets_top1(spark: SparkSession, d: str) -> DataFrame:
    """Nearest other fingerprint of 2,048 bits."""
    turns = _turns(spark, d)
    asked = turns.filter(F.floor(F.col("id") / 1000) % 50 == 0)
    top = neighbours.top_k_sets(asked.withColumnRenamed("id", "candidate_id"), turns.withColumnRenamed("id", "reference_id"), 1, exclude_self=True)
    return top.select("candidate_id", "reference_id", R6("similarity").alias("similarity"))


#: The same with every turn as a candidate.
WHOLE_SETS = SETS.replace(" WHERE q.id // 1000 % 50 = 0", "")


@query("knn_sets_payload", """
SELECT candidate_id, round(avg(similarity), 6) AS mean_similarity, round(max(similarity), 6) AS max_similarity, string_agg(reference_id, ',' ORDER BY rank) AS neighbours FROM top WHERE rank <= 5 GROUP BY 1""", WHOLE_SETS)
def knn_sets_payload(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest fingerprints of 2,048 bits of every turn, and their mean similarity."""
    s = neighbours.neighbour_summary(neighbours.top_k_sets(_turns(spark, d).withColumnRenamed("id", "candidate_id"), None, 5, exclude_self=True))
    return s.select("candidate_id", R6("mean_similarity").alias("mean_similarity"), R6("max_similarity").alias("max_similarity"), "neighbours")


@query("knn_confidence", """
SELECT CASE WHEN similarity >= 0.7 THEN 'high' WHEN similarity >= 0.5 THEN 'medium' WHEN similarity >= 0.35 THEN 'low-medium' WHEN similarity IS NULL THEN 'unknown' ELSE 'low' END AS confidence, count(*) AS n FROM top WHERE rank = 1 GROUP BY 1""", KNN)
def knn_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of the queries by their nearest neighbour."""
    return _top(spark, d, 1).groupBy(bins.CONFIDENCE.label(F.col("similarity")).alias("confidence")).agg(_n().alias("n"))


@query("domain_flag", """
SELECT molecule_id, similarity IS NULL OR similarity < 0.30 AS outside_screening, similarity IS NULL OR similarity < 0.50 AS outside_prediction,
  CASE WHEN similarity IS NULL THEN 'unknown' WHEN similarity >= 0.7 THEN 'high' WHEN similarity >= 0.5 THEN 'medium' WHEN similarity >= 0.35 THEN 'low-medium' ELSE 'low' END AS confidence FROM mol""", MOL)
def domain_flag(spark: SparkSession, d: str) -> DataFrame:
    """Domain flags at both thresholds, and the confidence label."""
    s = F.col("similarity")
    return views.mol(spark, d).select("molecule_id", scalars.out_of_domain(s, 0.30).alias("outside_screening"), scalars.out_of_domain(s, 0.50).alias("outside_prediction"), bins.CONFIDENCE.label(s).alias("confidence"))


@query("domain_assessment", """
, x AS (SELECT molecule_id, similarity, size % 2 = 0 AS sc, size % 3 <> 0 AS so, size % 7 = 0 AS im, size % 13 = 0 AS ca FROM mol WHERE similarity IS NOT NULL),
l AS (SELECT *, (CASE WHEN sc AND similarity >= 0.6 AND so AND NOT im THEN 2 WHEN similarity >= 0.4 AND so AND NOT im THEN 1 ELSE 0 END) - ca::INT AS lv FROM x)
SELECT molecule_id, CASE WHEN lv >= 2 THEN 'High' WHEN lv = 1 THEN 'Medium' ELSE 'Low' END AS level, round(least(greatest(0.6::DOUBLE * similarity + 0.25::DOUBLE * sc::INT + 0.15::DOUBLE * so::INT, 0), 1), 6) AS domain_score,
  concat_ws(', ', CASE WHEN similarity < 0.4 THEN 'low similarity' END, CASE WHEN NOT sc THEN 'new scaffold' END, CASE WHEN NOT so THEN 'unknown solvent' END, CASE WHEN im THEN 'imputed descriptors' END) AS reasons FROM l""", MOL)
def domain_assessment(spark: SparkSession, d: str) -> DataFrame:
    """High, medium or low confidence with a downgrade for caution, and the reasons."""
    size, sim = F.col("size"), F.col("similarity")
    sc, so, im, ca = size % 2 == 0, size % 3 != 0, size % 7 == 0, size % 13 == 0
    m = views.mol(spark, d).filter("similarity IS NOT NULL")
    return m.select("molecule_id", scalars.confidence_level(sim, sc, so, im, ca).alias("level"), R6(scalars.domain_score(sim, sc, so)).alias("domain_score"), scalars.low_reasons(sim, sc, so, im).alias("reasons"))


@query("cross_enumerate", """
, t AS (SELECT scaffold, scaffold || '({sub})' AS template FROM (SELECT DISTINCT scaffold FROM mol)), s AS (SELECT DISTINCT substituent, substr(substituent, 1, 5) AS fragment FROM mol)
SELECT scaffold, substituent, smiles FROM (SELECT scaffold, substituent, replace(template, '{sub}', fragment) AS smiles, row_number() OVER (PARTITION BY replace(template, '{sub}', fragment) ORDER BY scaffold, substituent) AS rn FROM t, s) WHERE rn = 1""", MOL)
def cross_enumerate(spark: SparkSession, d: str) -> DataFrame:
    """Every template with every substituent, equal results once."""
    m = views.mol(spark, d)
    t = m.select("scaffold").distinct().withColumn("template", F.concat("scaffold", F.lit("({sub})")))
    s = m.select("substituent").distinct().withColumn("fragment", F.substring("substituent", 1, 5))
    return joins.enumerate_templates(t, s)


@query("screen_score", """
SELECT molecule_id, round(-abs(predicted_emission_nm - 520) + 200 * predicted_qy, 6) AS score, round(predicted_qy * pow(10, log_extinction), 4) AS brightness, similarity IS NULL OR similarity < 0.3 AS outside_domain FROM mol""", MOL)
def screen_score(spark: SparkSession, d: str) -> DataFrame:
    """Score, brightness and domain flag of each candidate."""
    s = screening.score_candidates(views.mol(spark, d), 520.0)
    return s.select("molecule_id", R6("score").alias("score"), F.round("brightness", 4).alias("brightness"), "outside_domain")


@query("screen_rank_per_target", """
, x AS (SELECT m.*, t AS target_nm, -abs(predicted_emission_nm - t) + 200 * predicted_qy AS score FROM mol m, (SELECT unnest([450.0::DOUBLE, 520.0, 600.0, 700.0]) AS t))
SELECT target_nm, molecule_id, rank, round(score, 6) AS score, CASE WHEN abs(target_nm - 450) <= 25 THEN 'blue' WHEN abs(target_nm - 520) <= 25 THEN 'green' WHEN abs(target_nm - 600) <= 25 THEN 'orange/red' END AS target_note
FROM (SELECT *, row_number() OVER (PARTITION BY target_nm ORDER BY score DESC NULLS LAST, molecule_id) AS rank FROM x) WHERE rank <= 10""", MOL)
def screen_rank_per_target(spark: SparkSession, d: str) -> DataFrame:
    """The ten best candidates of each target wavelength (a report of the top k)."""
    r = screening.rank_per_target(views.mol(spark, d), [450, 520, 600, 700], 10, "molecule_id")
    return r.select("target_nm", "molecule_id", "rank", R6("score").alias("score"), "target_note")


@query("scaffold_dominance", """
, x AS (SELECT m.*, t AS target_nm, -abs(predicted_emission_nm - t) + 200 * predicted_qy AS score FROM mol m, (SELECT unnest([450.0::DOUBLE, 520.0, 600.0]) AS t)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_nm ORDER BY score DESC NULLS LAST, molecule_id) AS rank FROM x) WHERE rank <= 20), c AS (SELECT target_nm, substituent, count(*) AS n FROM r GROUP BY 1, 2)
SELECT target_nm, substituent, n, 2 * n >= total AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY target_nm ORDER BY n DESC, substituent) AS rn, sum(n) OVER (PARTITION BY target_nm) AS total FROM c) WHERE rn = 1""", MOL)
def scaffold_dominance(spark: SparkSession, d: str) -> DataFrame:
    """Whether one substituent holds at least half of a target's best candidates."""
    return screening.dominance(screening.rank_per_target(views.mol(spark, d), [450, 520, 600], 20, "molecule_id"), "substituent")


@query("scalar_math", """
SELECT molecule_id, round(CASE WHEN size - 5 > 0 THEN log10(size - 5) END, 6) AS log_size, round(1240.0::DOUBLE / predicted_emission_nm, 6) AS ev, round(ln(least(greatest(predicted_qy, 1e-5), 1 - 1e-5) / (1 - least(greatest(predicted_qy, 1e-5), 1 - 1e-5))), 6) AS logit_qy,
  round(CASE WHEN similarity IS NULL THEN 0.5::DOUBLE WHEN similarity <= 0.2 THEN 1 WHEN similarity >= 0.8 THEN 0 ELSE 1 - (similarity - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE) END, 6) AS score, round(least(greatest(predicted_qy * 2 - 0.5, 0), 1), 6) AS clipped FROM mol""", MOL)
def scalar_math(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms, unit conversion, log odds, threshold score and clipping."""
    m = views.mol(spark, d)
    return m.select(
        "molecule_id", R6(scalars.log10_positive(F.col("size") - 5)).alias("log_size"), R6(scalars.nm_to_ev(F.col("predicted_emission_nm"))).alias("ev"), R6(scalars.logit(F.col("predicted_qy"))).alias("logit_qy"),
        R6(scalars.threshold_score(F.col("similarity"), 0.2, 0.8)).alias("score"), R6(scalars.clip(F.col("predicted_qy") * 2 - 0.5)).alias("clipped"),
    )


@query("numeric_extract", """
SELECT event_id, TRY_CAST(nullif(regexp_extract('~ about ' || props || ' nm', '[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?', 0), '') AS DOUBLE) AS number FROM events""")
def numeric_extract(spark: SparkSession, d: str) -> DataFrame:
    """First number in a text."""
    t = F.concat(F.lit("~ about "), F.col("props"), F.lit(" nm"))
    return views._t(spark, d, "events").select("event_id", scalars.first_number(t).alias("number"))


@query("solvent_normalize", """
SELECT key, count(*) AS n, count(DISTINCT alnum) AS n_alnum FROM (SELECT lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS key, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS alnum FROM (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_type) || ' ' WHEN p_partkey % 3 = 1 THEN replace(p_type, ' ', '   ') ELSE p_type END AS t FROM part)) GROUP BY 1""")
def solvent_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Text keys: blanks, case, letters and digits only."""
    k, t = F.col("p_partkey"), F.col("p_type")
    text = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper(t), F.lit(" "))).when(k % 3 == 1, F.replace(t, F.lit(" "), F.lit("   "))).otherwise(t)
    p = views._t(spark, d, "part").select(scalars.solvent_key(text).alias("key"), scalars.alnum_key(text).alias("alnum"))
    return p.groupBy("key").agg(_n().alias("n"), F.countDistinct("alnum").alias("n_alnum"))


@query("onehot_unknown", """
SELECT molecule_id, (size = 1)::INT AS h0, (size = 7)::INT AS h1, (size = 30)::INT AS h2, (size NOT IN (1, 7, 30))::INT AS h_unknown FROM mol""", MOL)
def onehot_unknown(spark: SparkSession, d: str) -> DataFrame:
    """One-hot encoding with a place for unknown values."""
    m = views.mol(spark, d).withColumn("h", scalars.one_hot(F.col("size").cast("string"), ["1", "7", "30"]))
    return m.select("molecule_id", *[F.col("h")[k].alias(n) for k, n in enumerate(("h0", "h1", "h2", "h_unknown"))])


@query("text_labels", """
SELECT p_partkey, replace(regexp_extract('out/run_' || p_partkey || '_a.csv', '([^/]+?)(?:\\.[^./]*)?$', 1), '_', ' ') AS label, nullif(regexp_extract('Submitted batch job ' || p_partkey, 'Submitted batch job (\\S+)', 1), '') AS job,
  replace(CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END, '|', '\\|') AS short, contains(lower(p_type), 'brass') AS is_brass FROM part""")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels from file names, job numbers, shortened texts, substring tests."""
    k = F.col("p_partkey").cast("string")
    return views._t(spark, d, "part").select(
        "p_partkey", scalars.file_label(F.concat(F.lit("out/run_"), k, F.lit("_a.csv"))).alias("label"), scalars.job_id(F.concat(F.lit("Submitted batch job "), k)).alias("job"),
        scalars.shorten(F.col("p_name"), 8).alias("short"), scalars.contains_ci(F.col("p_type"), "BRASS").alias("is_brass"),
    )


@query("job_queue_next", "SELECT id, user_id, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 5", JOBS)
def job_queue_next(spark: SparkSession, d: str) -> DataFrame:
    """The next five queued jobs."""
    return job_queue.next_jobs(views.jobs(spark, d), 5).select("id", "user_id", "created_at")


@query("job_status_counts", """
SELECT status, count(*) AS n, count(DISTINCT user_id) AS n_users, status IN ('queued', 'running') AS is_open FROM jobs GROUP BY 1""", JOBS)
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status."""
    return views.jobs(spark, d).groupBy("status").agg(_n().alias("n"), F.countDistinct("user_id").alias("n_users"), F.first(F.col("status").isin("queued", "running")).alias("is_open"))


@query("job_validation", """
SELECT code, count(*) AS n FROM (SELECT CASE WHEN m IS NULL OR m = '' OR s IS NULL OR s = '' THEN 'INVALID_INPUT' WHEN c NOT IN ('all', 'best', 'gnn', 'traditional') THEN 'INVALID_MODEL_CHOICE' END AS code FROM (
  SELECT CASE id % 4 WHEN 0 THEN NULL ELSE 'C' END AS m, CASE id % 7 WHEN 0 THEN '' ELSE 'O' END AS s, CASE id % 3 WHEN 0 THEN 'other' ELSE 'all' END AS c FROM jobs)) GROUP BY 1""", JOBS)
def job_validation(spark: SparkSession, d: str) -> DataFrame:
    """Error codes of requests; valid ones have none."""
    i = F.col("id")
    r = views.jobs(spark, d).select(F.when(i % 4 != 0, "C").alias("molecule_smiles"), F.when(i % 7 == 0, "").otherwise("O").alias("solvent_smiles"), F.when(i % 3 == 0, "other").otherwise("all").alias("model_choice"))
    return r.select(job_queue.error_code(["molecule_smiles", "solvent_smiles"], "model_choice", ["all", "best", "gnn", "traditional"]).alias("code")).groupBy("code").agg(_n().alias("n"))


@query("json_explode_results", """
SELECT k, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, unnest([0, 1]) AS pos FROM jobs) GROUP BY 1""", JOBS)
def json_explode_results(spark: SparkSession, d: str) -> DataFrame:
    """JSON results turned into rows, through a response document and back."""
    j = views.jobs(spark, d).withColumn("k", F.from_json("props", "k long")["k"])
    doc = F.to_json(F.struct("id", F.array(*[F.struct(F.lit(p).alias("pos"), F.col("k")) for p in (0, 1)]).alias("predictions")))
    rows = j.select(F.from_json(doc, "id long, predictions array<struct<pos:int,k:long>>").alias("r")).select(F.inline("r.predictions"))
    return rows.groupBy("k").agg(_n().alias("n"), F.sum("pos").alias("sum_pos"))


#: Customers and orders are nodes; orders' ids come after all customers'.
ORDER_IDS = 10_000_000_000
EDGES = f"""edges AS (SELECT DISTINCT o_custkey AS src, o_orderkey + {ORDER_IDS} AS dst FROM orders)"""


@query("graph_message_pass", """
, x AS (SELECT n AS node, (n % 1000) * 0.5::DOUBLE AS v FROM (SELECT DISTINCT src AS n FROM edges UNION SELECT dst FROM edges)), e2 AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)
SELECT x.node, round(coalesce(sum(y.v), 0), 6) AS sum_in, round(coalesce(avg(y.v), 0), 6) AS mean_in FROM x LEFT JOIN e2 ON e2.dst = x.node LEFT JOIN x y ON y.node = e2.src GROUP BY 1""", EDGES)
def graph_message_pass(spark: SparkSession, d: str) -> DataFrame:
    """One step of message passing: sums and means over incoming edges."""
    o = views._t(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDER_IDS).alias("dst")).distinct()
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("v", (F.col("node") % 1000) * 0.5)
    return graph.message_pass(nodes, graph.both_ways(e), "v").select("node", R6("sum_in").alias("sum_in"), R6("mean_in").alias("mean_in"))


@query("preferred_metadata", """
SELECT lang, count(*) AS n, count(quality) AS n_labelled, round(avg(coalesce(quality, 0)), 6) AS mean_quality FROM (SELECT DISTINCT d.doc_id, lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def preferred_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Left join of labels with a default where they are missing."""
    j = views._t(spark, d, "documents").select("doc_id", "lang").join(views._t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").distinct()
    return j.groupBy("lang").agg(_n().alias("n"), F.count("quality").alias("n_labelled"), R6(F.avg(F.coalesce("quality", F.lit(0)))).alias("mean_quality"))


@query("exact_match_payload", """
SELECT (SELECT count(*) FROM mol WHERE scaffold = 'Brand#11') AS n_matches, string_agg(molecule_id, ',' ORDER BY molecule_id) AS first_ids FROM (SELECT molecule_id FROM mol WHERE scaffold = 'Brand#11' ORDER BY molecule_id LIMIT 20)""", MOL)
def exact_match_payload(spark: SparkSession, d: str) -> DataFrame:
    """Number of matches and the first twenty of them (a preview)."""
    hits = views.mol(spark, d).filter("scaffold = 'Brand#11'").select("molecule_id")
    first = hits.orderBy("molecule_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("molecule_id")), ",").alias("first_ids"))
    return hits.agg(_n().alias("n_matches")).crossJoin(first).withColumn("first_ids", F.when(F.col("first_ids") != "", F.col("first_ids")))


def ranked(mol: DataFrame, one_task_rows: int = ordering.ONE_TASK_ROWS) -> DataFrame:
    """All molecules with their place in the custom order."""
    order = [F.when(F.col("substituent") == "PROMO", 0).otherwise(1), F.col("similarity").desc_nulls_last(), F.col("molecule_id")]
    return ordering.place(mol, order, one_task_rows=one_task_rows)


@query("rank_in_order", """
SELECT molecule_id, scaffold, row_number() OVER (ORDER BY CASE substituent WHEN 'PROMO' THEN 0 ELSE 1 END, similarity DESC NULLS LAST, molecule_id) AS place FROM mol""", MOL)
def rank_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Custom rank first, then mixed directions with missing values last."""
    return ranked(views.mol(spark, d)).select("molecule_id", "scaffold", "place")


@query("stream_available_now", "SELECT CASE WHEN value IS NULL THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, count(DISTINCT event_id) AS n_jobs FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_available_now(spark: SparkSession, d: str) -> DataFrame:
    """The job queue as a stream: every event file read once, jobs completed idempotently."""
    return job_queue.drain(spark, d)


@query("mllib_forest")
def mllib_forest(spark: SparkSession, d: str) -> DataFrame:
    """Random forest of MLlib on a group split: metrics by side."""
    from ..operators import models

    return models.forest_metrics(views.pred(spark, d))


@query("smiles_canonical")
def smiles_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form, fingerprint bits, scaffold and descriptors of enumerated molecules."""
    from ..operators import chemistry

    return chemistry.describe(spark.createDataFrame(chemistry.enumerate_library(), "scaffold string, substituent string, smiles string"), "smiles")
