"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, filter_audit, license_scan, mixing, near_dedup, quality_crf, quality_rules, secret_scan, spelling, token_counts, token_output, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    label = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    start = lambda ms: F.transform(ms, lambda m: m["start_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start(base)).alias("first_word"),
        F.array_max(start(base)).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token sequences, written in training order and read back."""
    return token_output.materialise(table(spark, sf_dir, "documents"), common.scratch_path(spark, "tokens"))


#: Host, path and verdict of the rules that the pages are judged by.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(list(URL_RULES), url_filter.RULE_SCHEMA)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and verdict of every document."""
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and how many look live or copied."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in secret_scan.BASE_KINDS]))
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = common.scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, with its near words' number, its form and its root."""
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter keeps and removes, by source, order and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator of this subpackage."""
    return {
        "op1_license_scan": op1_license_scan,
        "op2_url_filter": op2_url_filter,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_near_dedup": op5_near_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_decontamination": op7_decontamination,
        "op8_mixing": op8_mixing,
        "op9_warc": op9_warc,
        "op10_token_output": op10_token_output,
        "op11_token_counts": op11_token_counts,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_filter_audit": op13_filter_audit,
    }
