"""From raw documents to training-order token shards: five of the operators, one after the other.

Each stage works on all rows that the one before it kept, and is written as Parquet and
read again. Documents that the quality classifier rejects go; of each group of near
copies the one with the smallest id stays; documents that hold a test item go; sources
are mixed to their target weights; what is left is tokenized and written in training
order. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiquery.llm import common, decontaminate, mixing, near_dedup, quality_crf, token_output

#: Similarity in percent from which documents are near copies in the corpus; 85 is the contract of op5_near_dedup alone.
NEAR_PERCENT = 80

#: Training rows are drawn by hash and tokens permuted by key, which SQL can't express.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """The id, and the whole row as one column, so that no column of the input can clash and the text goes along once."""
    return docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier takes for good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality_crf.train(docs, labels)
    with common.few_rows_a_batch(spark):
        scored = common.pin(quality_crf.score_documents(_with_row(docs), field, "_row", text="_row.text"))
    return scored.filter("score >= 0.5").select("_row.*")


def _text_key(docs: DataFrame) -> Column:
    """One key for each pair of an id and a text, in the order of the ids; null without an id.

    Where no id repeats, the id tells its text, and is a key that sketches and pairs carry for less.
    """
    own = F.col("doc_id")
    if not docs.filter(own.isNotNull()).groupBy("doc_id").count().filter("count > 1").take(1):
        return own
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        own = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(own.cast("string"), F.lit("/"), F.md5(F.coalesce("text", F.lit(""))))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies.

    Documents are told apart by id and text: of rows that agree in both one stays, rows
    that share an id but differ in their texts are documents of their own. Rows without
    an id can't be named as copies, and all stay.
    """
    key = _text_key(docs)
    found = near_dedup.near_duplicates(docs.select(key.alias("_key"), "text"), "_key", NEAR_PERCENT)
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    gone = common.cut(found.filter("not kept").select("_key").distinct())
    kept = rows.join(common.lookup(gone), "_key", "left_anti")
    again = common.cut(found.filter("kept AND _key IS NOT NULL").groupBy("_key").count().filter("count > 1").select("_key"))
    if not again.take(1):
        return kept.select("_row.*")
    once = kept.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.join(again, "_key", "left_anti").unionByName(once).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with common.few_rows_a_batch(spark):
        matched = common.pin(decontaminate.match_documents(_with_row(docs), items, ("_row",), text="_row.text"))
    return matched.filter(F.size("matches") == 0).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that the sources meet their targets."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token shards; the result has one row for each record of theirs."""
    return token_output.materialise(docs, common.scratch_path(spark, "tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a table in the shared folder until the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = common.scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)  # it writes its shards at once
    common.remove_path(spark, before)
    return out
