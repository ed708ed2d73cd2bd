"""Queries over measurements: standardization, deduplication, overlap, profiles, noise, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dedup, joins, profile
from . import views
from .catalog import query
from .views import MEAS, SOLV

R6 = lambda c: F.round(c, 6)


@query("standardize_union", """
SELECT DISTINCT molecule, solvent, source_dataset, absorption_nm, emission_nm, lifetime_ns, log_extinction FROM (
  SELECT molecule, solvent, source_dataset, absorption_nm, emission_nm, lifetime_ns, CAST(NULL AS DOUBLE) AS log_extinction FROM meas WHERE source_dataset = 'literature'
  UNION ALL SELECT molecule, solvent, source_dataset, absorption_nm, emission_nm, NULL, NULL FROM meas WHERE source_dataset = 'handbook'
  UNION ALL SELECT molecule, solvent, source_dataset, NULL, emission_nm, lifetime_ns, log_extinction FROM meas WHERE source_dataset = 'Aggregate')
WHERE molecule IS NOT NULL AND solvent IS NOT NULL
  AND NOT (absorption_nm IS NULL AND emission_nm IS NULL AND lifetime_ns IS NULL AND log_extinction IS NULL)""", MEAS)
def standardize_union(spark: SparkSession, d: str) -> DataFrame:
    """Union by name of sources with different columns, filters, distinct."""
    m = views.meas(spark, d)
    parts = [m.filter(F.col("source_dataset") == s).drop(*gone) for s, gone in (("Aggregate", ("absorption_nm",)), ("literature", ("log_extinction",)), ("handbook", ("lifetime_ns", "log_extinction")))]
    targets = ["absorption_nm", "emission_nm", "lifetime_ns", "log_extinction"]
    return dedup.union_sources(parts, ["molecule", "solvent", "source_dataset", *targets], targets, ["molecule", "solvent"])


@query("coerce_numeric", """
SELECT event_id, CASE WHEN isnan(TRY_CAST(t AS DOUBLE)) THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS x FROM (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'abc' WHEN 2 THEN event_id || '.5' WHEN 3 THEN NULL ELSE '-' || event_id END AS t FROM events)""")
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Safe numeric cast: text, NaN and missing values are null."""
    k = F.col("event_id")
    t = F.when(k % 5 == 0, "nan").when(k % 5 == 1, "abc").when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".5"))).when(k % 5 == 4, F.concat(F.lit("-"), k.cast("string")))
    return views._t(spark, d, "events").select("event_id", scalars.safe_double(t).alias("x"))


@query("dedup_source_pref", """
SELECT molecule, solvent, absorption_nm, emission_nm, quantum_yield, log_extinction, source_dataset FROM (
  SELECT *, row_number() OVER (PARTITION BY molecule, solvent, absorption_nm, emission_nm, quantum_yield, log_extinction
    ORDER BY CASE lower(source_dataset) WHEN 'handbook' THEN 0 WHEN 'literature' THEN 1 WHEN 'aggregate' THEN 2 ELSE 3 END, ord, line) AS rn FROM meas) WHERE rn = 1""", MEAS)
def dedup_source_pref(spark: SparkSession, d: str) -> DataFrame:
    """Source-preferred, keep-first deduplication on the measurement key."""
    kept = dedup.keep_source_preferred(views.meas(spark, d), views.KEY, [F.col("ord"), F.col("line")])
    return kept.select(*views.KEY, "source_dataset")


@query("duplicate_flags", """
SELECT is_duplicate, count(*) AS n_rows FROM (
  SELECT count(*) OVER (PARTITION BY molecule, solvent, absorption_nm, emission_nm, quantum_yield, log_extinction) > 1 AS is_duplicate FROM meas) GROUP BY 1""", MEAS)
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rows that share their measurement key."""
    return dedup.duplicate_counts(views.meas(spark, d), views.KEY)


@query("overlap_summary", """
SELECT sources, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT array_to_string(list_sort(list(DISTINCT source_dataset)), '+') AS sources, count(*) AS n FROM meas
  GROUP BY molecule, solvent, absorption_nm, emission_nm, quantum_yield, log_extinction) GROUP BY 1""", MEAS)
def overlap_summary(spark: SparkSession, d: str) -> DataFrame:
    """Keys by the combination of sources that hold them."""
    return dedup.overlap_by_sources(views.meas(spark, d), views.KEY)


@query("key_intersections", """
, per AS (SELECT bool_or(source_dataset = 'handbook') a, bool_or(source_dataset = 'literature') b, bool_or(source_dataset = 'Aggregate') c
  FROM meas GROUP BY molecule, solvent, absorption_nm, emission_nm, quantum_yield, log_extinction)
SELECT 'handbook' AS source_a, 'literature' AS source_b, count(*) FILTER (a AND b) AS n_shared FROM per
UNION ALL SELECT 'handbook', 'Aggregate', count(*) FILTER (a AND c) FROM per
UNION ALL SELECT 'literature', 'Aggregate', count(*) FILTER (b AND c) FROM per""", MEAS)
def key_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Keys that each pair of sources shares."""
    return dedup.key_intersections(views.meas(spark, d), views.KEY, ["handbook", "literature", "Aggregate"])


@query("replicates", """
SELECT molecule, solvent, count(*) AS n_rows, count(DISTINCT (absorption_nm, emission_nm, quantum_yield, log_extinction)) AS n_distinct,
  array_to_string(list_sort(list(DISTINCT source_dataset)), ',') AS sources, min(emission_nm) AS min_emission_nm, max(emission_nm) AS max_emission_nm,
  min(quantum_yield) AS min_quantum_yield, max(quantum_yield) AS max_quantum_yield FROM meas WHERE solvent IS NOT NULL
GROUP BY molecule, solvent HAVING count(*) > 1 AND count(DISTINCT (absorption_nm, emission_nm, quantum_yield, log_extinction)) > 1""", MEAS)
def replicates(spark: SparkSession, d: str) -> DataFrame:
    """Molecule-solvent pairs with several different measurements."""
    m = views.meas(spark, d).filter("solvent IS NOT NULL")
    key = F.struct("absorption_nm", "emission_nm", "quantum_yield", "log_extinction")
    return dedup.replicates(m, ["molecule", "solvent"], key, ["emission_nm", "quantum_yield"])


@query("average_duplicates", """
SELECT molecule, solvent, count(*) AS n_rows, round(avg(emission_nm), 6) AS emission_nm, round(avg(quantum_yield), 6) AS quantum_yield
FROM meas WHERE solvent IS NOT NULL GROUP BY molecule, solvent""", MEAS)
def average_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One averaged row for each molecule and solvent; rows without a solvent are dropped."""
    g = views.meas(spark, d).na.drop(subset=["molecule", "solvent"]).groupBy("molecule", "solvent")
    return g.agg(F.count(F.lit(1)).alias("n_rows"), R6(F.avg("emission_nm")).alias("emission_nm"), R6(F.avg("quantum_yield")).alias("quantum_yield"))


@query("red_coverage_rollup", """
SELECT coalesce(source_dataset, 'ALL') AS source_dataset, count(*) AS n_rows, count(*) FILTER (emission_nm >= 550) AS ge_550, count(*) FILTER (emission_nm >= 580) AS ge_580,
  count(*) FILTER (emission_nm >= 600) AS ge_600, count(*) FILTER (emission_nm >= 650) AS ge_650, count(*) FILTER (emission_nm >= 700) AS ge_700, count(*) FILTER (emission_nm >= 750) AS ge_750
FROM meas GROUP BY ROLLUP (source_dataset)""", MEAS)
def red_coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rows at or above emission thresholds, by source and in all."""
    return dedup.coverage_rollup(views.meas(spark, d), "emission_nm", [550, 580, 600, 650, 700, 750])


@query("missing_profile", """
, s AS (SELECT count(*) n, count(*) - count(solvent) a, count(*) - count(absorption_nm) b, count(*) - count(emission_nm) c FROM meas)
SELECT 'solvent' AS column_name, a AS n_missing, round(100.0::DOUBLE * a / n, 6) AS pct_missing FROM s UNION ALL SELECT 'absorption_nm', b, round(100.0::DOUBLE * b / n, 6) FROM s
UNION ALL SELECT 'emission_nm', c, round(100.0::DOUBLE * c / n, 6) FROM s""", MEAS)
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of each column."""
    return profile.missing_profile(views.meas(spark, d), ["solvent", "absorption_nm", "emission_nm"])


@query("numeric_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM meas""" for c in ("emission_nm", "quantum_yield", "log_extinction")), MEAS)
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact description of the numeric columns."""
    p = profile.numeric_profile(views.meas(spark, d), ["emission_nm", "quantum_yield", "log_extinction"])
    return p.withColumns({c: R6(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


@query("value_counts_missing", """
SELECT CASE WHEN solvent IS NULL THEN '<missing>' WHEN trim(solvent) = '' THEN '<blank>' ELSE solvent END AS value, count(*) AS n FROM (
  SELECT CASE WHEN line = 3 THEN '  ' ELSE solvent END AS solvent FROM meas) GROUP BY 1""", MEAS)
def value_counts_missing(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies with names for missing and blank values."""
    m = views.meas(spark, d).withColumn("solvent", F.when(F.col("line") == 3, "  ").otherwise(F.col("solvent")))
    return profile.value_counts(m, "solvent")


@query("dataset_audit", """
SELECT 'rows' AS section, source_dataset, 'n_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM meas GROUP BY 2
UNION ALL SELECT 'rows', source_dataset, 'n_molecules', CAST(count(DISTINCT molecule) AS VARCHAR) FROM meas GROUP BY 2
UNION ALL SELECT 'targets', source_dataset, 'n_emission', CAST(count(emission_nm) AS VARCHAR) FROM meas GROUP BY 2
UNION ALL SELECT 'targets', source_dataset, 'n_emission_600', CAST(count(*) FILTER (emission_nm >= 600) AS VARCHAR) FROM meas GROUP BY 2
UNION ALL SELECT 'pairs', source_dataset, 'n_pairs', CAST(count(DISTINCT (molecule, solvent)) AS VARCHAR) FROM meas WHERE solvent IS NOT NULL GROUP BY 2""", MEAS)
def dataset_audit(spark: SparkSession, d: str) -> DataFrame:
    """Long table of audit figures by source, from one aggregation."""
    m = views.meas(spark, d)
    a = m.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("molecule").alias("n_molecules"), F.count("emission_nm").alias("n_emission"),
        F.count_if(F.col("emission_nm") >= 600).alias("n_emission_600"), F.countDistinct("molecule", "solvent").alias("n_pairs"),
    )
    rows = [("rows", "n_rows"), ("rows", "n_molecules"), ("targets", "n_emission"), ("targets", "n_emission_600"), ("pairs", "n_pairs")]
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for s, c in rows])
    return a.select("source_dataset", F.inline(cells))


@query("noise_stats_iqr", """
SELECT molecule, solvent, count(*) AS n, count(DISTINCT quantum_yield) AS n_distinct, round(avg(quantum_yield), 6) AS mean, round(median(quantum_yield), 6) AS median,
  round(stddev_samp(quantum_yield), 6) AS std, round(max(quantum_yield) - min(quantum_yield), 6) AS range,
  CASE WHEN count(*) >= 4 THEN round(quantile_cont(quantum_yield, 0.75) - quantile_cont(quantum_yield, 0.25), 6) END AS iqr,
  array_to_string(list_sort(list(DISTINCT source_dataset)), '; ') AS sources
FROM meas WHERE quantum_yield BETWEEN 0 AND 1 GROUP BY molecule, solvent HAVING count(*) >= 2""", MEAS)
def noise_stats_iqr(spark: SparkSession, d: str) -> DataFrame:
    """Spread of repeated quantum yields."""
    s = profile.noise_statistics(views.meas(spark, d), ["molecule", "solvent"], "quantum_yield", "source_dataset")
    return s.select("molecule", "solvent", "n", "n_distinct", *[R6(c).alias(c) for c in ("mean", "median", "std", "range", "iqr")], "sources")


@query("noise_report_pct", """
SELECT count(*) AS n_groups, round(median(r), 6) AS median_range, round(100 * avg(CASE WHEN r > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_over_005,
  round(100 * avg(CASE WHEN r > 0.10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_over_010 FROM (
  SELECT max(quantum_yield) - min(quantum_yield) AS r FROM meas WHERE quantum_yield BETWEEN 0 AND 1 GROUP BY molecule, solvent, source_dataset, line HAVING count(*) >= 2)""", MEAS)
def noise_report_pct(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated groups with a wide range."""
    r = profile.noise_report(profile.noise_statistics(views.meas(spark, d), ["molecule", "solvent", "source_dataset", "line"], "quantum_yield", "source_dataset"))
    return r.select("n_groups", *[R6(c).alias(c) for c in ("median_range", "pct_over_005", "pct_over_010")])


@query("range_filter_complement", """
SELECT CASE WHEN quantum_yield BETWEEN 0.1 AND 0.9 THEN 'kept' WHEN quantum_yield IS NULL THEN 'missing' ELSE 'excluded' END AS part, count(*) AS n_rows,
  count(*) FILTER (quantum_yield > 0.25) AS n_bright FROM meas GROUP BY 1""", MEAS)
def range_filter_complement(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive range filter, with the excluded rows kept apart, and the strict bright class."""
    q = F.col("quantum_yield")
    part = F.when(q.between(0.1, 0.9), "kept").when(q.isNull(), "missing").otherwise("excluded")
    return views.meas(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(q > 0.25).alias("n_bright"))


@query("target_diagnostics", """
SELECT source_dataset, count(emission_nm) AS n_labelled, count(*) FILTER (emission_nm >= 580) AS ge_580, count(*) FILTER (emission_nm >= 650) AS ge_650,
  count(*) FILTER (emission_nm IS NULL AND absorption_nm IS NULL) AS n_unlabelled FROM meas GROUP BY 1""", MEAS)
def target_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows by source."""
    e, a = F.col("emission_nm"), F.col("absorption_nm")
    return views.meas(spark, d).groupBy("source_dataset").agg(F.count(e).alias("n_labelled"), F.count_if(e >= 580).alias("ge_580"), F.count_if(e >= 650).alias("ge_650"), F.count_if(e.isNull() & a.isNull()).alias("n_unlabelled"))


SOLV_FIRST = """, a AS (SELECT solvent_key, dielectric, polarity FROM (SELECT *, row_number() OVER (PARTITION BY solvent_key ORDER BY s_suppkey) rn FROM solv WHERE solvent_key IS NOT NULL) WHERE rn = 1),
b AS (SELECT lab, dielectric, polarity FROM (SELECT *, lower(trim(label)) lab, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY s_suppkey) rn FROM solv) WHERE rn = 1)"""


@query("desc_join_canonical", SOLV_FIRST + """
SELECT m.solvent, count(*) AS n_rows, round(max(a.dielectric), 6) AS dielectric, count(a.solvent_key) AS n_matched FROM meas m LEFT JOIN a ON m.solvent = a.solvent_key GROUP BY 1""", MEAS, SOLV)
def desc_join_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Left join of solvent descriptors on the canonical key."""
    dim = joins.unique_dimension(views.solv(spark, d), "solvent_key", [F.col("s_suppkey")]).select("solvent_key", "dielectric")
    j = views.meas(spark, d).join(joins.checked_broadcast(dim), F.col("solvent") == F.col("solvent_key"), "left")
    return j.groupBy("solvent").agg(F.count(F.lit(1)).alias("n_rows"), R6(F.max("dielectric")).alias("dielectric"), F.count("solvent_key").alias("n_matched"))


@query("desc_join_fallback", SOLV_FIRST + """
SELECT solvent, descriptor_match, count(*) AS n_rows, round(max(dielectric), 6) AS dielectric, round(max(polarity), 6) AS polarity FROM (
  SELECT m.solvent, CASE WHEN a.dielectric IS NOT NULL OR a.polarity IS NOT NULL THEN 'canonical' WHEN b.dielectric IS NOT NULL OR b.polarity IS NOT NULL THEN 'label' ELSE 'none' END AS descriptor_match,
    CASE WHEN a.dielectric IS NULL AND a.polarity IS NULL THEN b.dielectric ELSE a.dielectric END AS dielectric,
    CASE WHEN a.dielectric IS NULL AND a.polarity IS NULL THEN b.polarity ELSE a.polarity END AS polarity
  FROM meas m LEFT JOIN a ON m.solvent = a.solvent_key LEFT JOIN b ON lower(trim(m.solvent)) = b.lab) GROUP BY 1, 2""", MEAS, SOLV)
def desc_join_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors by canonical key, or by label where those are all missing."""
    j = joins.two_step_join(views.meas(spark, d), views.solv(spark, d), "solvent", F.col("solvent"), "solvent_key", "label", ["dielectric", "polarity"], [F.col("s_suppkey")])
    return j.groupBy("solvent", "descriptor_match").agg(F.count(F.lit(1)).alias("n_rows"), R6(F.max("dielectric")).alias("dielectric"), R6(F.max("polarity")).alias("polarity"))


@query("alias_map_join", """
SELECT alias_target, count(*) AS n_rows FROM (SELECT CASE lower(trim(solvent)) WHEN 's1' THEN 'CCO' WHEN 's2' THEN 'O' WHEN 's3' THEN 'CS(C)=O' END AS alias_target FROM meas) GROUP BY 1""", MEAS)
def alias_map_join(spark: SparkSession, d: str) -> DataFrame:
    """Aliases resolved by a dictionary."""
    return joins.alias_join(views.meas(spark, d), "solvent", {"s1": "CCO", "s2": "O", "s3": "CS(C)=O"}, "alias_target").groupBy("alias_target").agg(F.count(F.lit(1)).alias("n_rows"))


@query("point_lookup_priority", """
SELECT solvent_key, label, round(dielectric, 6) AS dielectric FROM (
  SELECT *, CASE WHEN solvent_key = 'S4' THEN 0 WHEN lower(trim(label)) = 's11' THEN 1 END AS r FROM solv) WHERE r IS NOT NULL ORDER BY r, s_suppkey LIMIT 1""", SOLV)
def point_lookup_priority(spark: SparkSession, d: str) -> DataFrame:
    """One row by canonical key, or else by label."""
    hit = joins.point_lookup(views.solv(spark, d), "S4", "S11", "solvent_key", "label", [F.col("s_suppkey")])
    return hit.select("solvent_key", "label", R6("dielectric").alias("dielectric"))


@query("membership_pair_flag", """
SELECT source_dataset, coalesce(lower(trim(regexp_replace(solvent, '\\s+', ' ', 'g'))) = 's3', false) AS solvent_match, count(*) AS n_rows FROM meas WHERE molecule = 'M7' GROUP BY 1, 2""", MEAS)
def membership_pair_flag(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a molecule, with a solvent match without regard to case and blanks."""
    return joins.membership(views.meas(spark, d), "molecule", F.col("solvent"), "M7", "  S3 ").groupBy("source_dataset", "solvent_match").agg(F.count(F.lit(1)).alias("n_rows"))


@query("semi_seen_flags", """
, t AS (SELECT * FROM meas WHERE source_dataset = 'handbook' AND emission_nm > 780), q AS (SELECT DISTINCT molecule, solvent FROM meas WHERE source_dataset = 'Aggregate')
SELECT molecule, solvent, EXISTS (SELECT 1 FROM t WHERE t.molecule = q.molecule) AS molecule_seen, EXISTS (SELECT 1 FROM t WHERE t.solvent = q.solvent) AS solvent_seen,
  EXISTS (SELECT 1 FROM t WHERE t.molecule = q.molecule AND t.solvent = q.solvent) AS pair_seen FROM q""", MEAS)
def semi_seen_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether molecule, solvent and pair are in the training rows: here, those that emit beyond 780 nm."""
    m = views.meas(spark, d)
    train = m.filter((F.col("source_dataset") == "handbook") & (F.col("emission_nm") > 780)).select("molecule", "solvent")
    bench = m.filter(F.col("source_dataset") == "Aggregate").select("molecule", "solvent").distinct()
    return joins.seen_flags(bench, train, "molecule", "solvent")


@query("set_operations", """
, a AS (SELECT DISTINCT molecule FROM meas WHERE source_dataset = 'handbook' AND emission_nm > 780), b AS (SELECT DISTINCT molecule FROM meas WHERE source_dataset = 'literature' AND quantum_yield > 0.95)
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""", MEAS)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, union and difference of key sets: far-red emitters of one source, bright molecules of another."""
    m = views.meas(spark, d)
    a = m.filter((F.col("source_dataset") == "handbook") & (F.col("emission_nm") > 780)).select("molecule").distinct()
    b = m.filter((F.col("source_dataset") == "literature") & (F.col("quantum_yield") > 0.95)).select("molecule").distinct()
    n = lambda op, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("intersect", a.intersect(b)).unionByName(n("union", a.union(b).distinct())).unionByName(n("difference", a.subtract(b)))


@query("weighted_valid_counts", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN v THEN n ELSE 0 END) AS BIGINT) AS n_valid, count(*) AS n_values FROM (
  SELECT solvent, count(*) n, CAST(substr(solvent, 2) AS INT) % 2 = 0 AS v FROM meas WHERE solvent IS NOT NULL GROUP BY 1)""", MEAS)
def weighted_valid_counts(spark: SparkSession, d: str) -> DataFrame:
    """Validity tested once a distinct value and weighted by its count."""
    per = views.meas(spark, d).filter("solvent IS NOT NULL").groupBy("solvent").agg(F.count(F.lit(1)).alias("n"))
    valid = F.substring("solvent", 2, 9).cast("int") % 2 == 0
    return per.agg(F.sum("n").alias("n_rows"), F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("n_valid"), F.count(F.lit(1)).alias("n_values"))
