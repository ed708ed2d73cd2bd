"""Job contracts and the streaming worker.

The only unbounded computation of the reference engine is a polled job queue. Here it is
a Structured Streaming query over job files: each batch is checked, ordered, answered and
upserted by job id, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..sources import files

#: States of a job in order; later ones win when a job is seen again.
STATES = ("queued", "running", "completed", "failed")

REQUEST = "job_id string, user_id string, molecule_smiles string, solvent_smiles string, model_choice string, requested_at string"


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The first n queued jobs by time of creation."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(n)


def error_code(required: list[str], choice: str, choices: list[str]) -> Column:
    """Code of the first rule that a request breaks, null for a valid one."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(c) == "")
    return F.when(missing, "INVALID_INPUT").when(F.col(choice).isNull() | ~F.col(choice).isin(choices), "INVALID_MODEL_CHOICE")


def response(job_id: Column, code: Column, predictions: Column) -> Column:
    """Response document: completed with predictions, or failed with a code."""
    good = F.to_json(F.struct(job_id.alias("job_id"), F.lit("completed").alias("status"), predictions.alias("predictions")))
    bad = F.to_json(F.struct(job_id.alias("job_id"), F.lit("failed").alias("status"), F.struct(code.alias("code")).alias("error")))
    return F.when(code.isNull(), good).otherwise(bad)


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Requests of JSON lines; a line that can't be read keeps its text and gets INVALID_INPUT."""
    parsed = lines.withColumn("r", F.from_json(value, REQUEST))
    return parsed.select("r.*", F.col(value).alias("raw"), F.when(F.col("r").isNull() | F.col("r.job_id").isNull(), F.lit("INVALID_INPUT")).alias("parse_error"))


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch of a stream whose repeated keys its state has dropped: a replay is overwritten by itself, and no history is read."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


#: Key buckets of a table that is upserted, and bits of the filter that a bucket has for each batch (one row of the built-in bitmaps).
BUCKETS, FILTER_BITS = 16, 32_768
#: Folders that are opened by name; beyond them the reader prunes nothing.
OPENED = 10_000


def _places(key: str) -> list[Column]:
    """A key's two places in a filter."""
    return [F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(FILTER_BITS)) for salt in (1, 2)]


def _may_hold(fresh: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    """Buckets and batches whose filter has both places of some key of the batch."""
    asked = fresh.select("bucket", *[p.alias(f"_p{k}") for k, p in enumerate(_places(key))]).distinct()
    byte = lambda p: F.conv(F.hex(F.substring("bits", (F.floor(F.col(p) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = lambda p: F.floor(byte(p) / F.pow(F.lit(2), F.col(p) % 8)).cast("long") % 2 == 1
    return asked.join(filters, "bucket").filter(bit("_p0") & bit("_p1")).select("bucket", "batch").distinct()


def opened_keys(spark: SparkSession, batch: DataFrame, path: str, batch_id: int, key: str = "id") -> DataFrame | None:
    """Keys of the earlier batches that may hold some of these: only folders whose filter says so are opened."""
    filters = f"{path}/_filters"
    if not files.exists(spark, filters):
        return None
    earlier = spark.read.parquet(filters).filter(F.col("batch") != batch_id)
    # a batch counts if its filters are there, since they are written last
    may = _may_hold(batch, earlier, key).limit(OPENED + 1).collect()
    if len(may) > OPENED:
        return spark.read.parquet(path).join(earlier.select("batch").distinct(), "batch", "left_semi").select(key)
    folders = [f"{path}/batch={r['batch']}/bucket={r['bucket']}" for r in may]
    return spark.read.option("basePath", path).parquet(*folders).select(key) if folders else None


def upsert(spark: SparkSession, batch: DataFrame, path: str, batch_id: int, key: str = "id") -> None:
    """Add the batch's rows whose key isn't there yet, for batches outside a stream.

    Rows lie in folders by batch and bucket of their key, each with a Bloom filter of its
    keys. A batch opens only folders whose filter may hold one of its keys, so the keys
    that are read grow with the batch. A replay overwrites its own folders.
    """
    # of rows with one key the first by their content, so a replay keeps the same
    fresh = keep_first(batch, [key], [F.xxhash64(*[F.col(c) for c in batch.columns if c != key])])
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    done = opened_keys(spark, fresh, path, batch_id, key)
    fresh = fresh.join(done, key, "left_anti") if done is not None else fresh
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
    written = spark.read.parquet(f"{path}/batch={batch_id}") if files.names(spark, f"{path}/batch={batch_id}") != ["_SUCCESS"] else fresh.limit(0)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_place") + 1))
    places = written.select("bucket", F.explode(F.array(*_places(key))).alias("_place"))
    places.groupBy("bucket").agg(bits.alias("bits")).write.mode("overwrite").parquet(f"{path}/_filters/batch={batch_id}")


def shared_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and results; a session without one must be local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (where or "file:///tmp/checkpoints").rstrip("/")


def drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read all event files as a stream of jobs, answer the queued ones once, and count the outcomes."""
    import uuid

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")

    def answer(batch: DataFrame, batch_id: int) -> None:
        queued = batch.filter("event_type IN ('click', 'view')").select(F.col("event_id").alias("id"), "user_id", "value")
        code = F.when(F.col("value").isNull(), "INVALID_INPUT")
        done = queued.withColumn("status", F.when(code.isNull(), "completed").otherwise("failed"))
        upsert(spark, done.withColumn("document", response(F.col("id").cast("string"), code, F.array(F.col("value")))), f"{base}/out", batch_id)

    # jobs that were seen before are found by the filters of the batches, so the stream holds no state
    query = stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_jobs"))


def state_machine(updates: DataFrame, key: str = "id", status: str = "status", order: str = "updated_at") -> DataFrame:
    """Last state of each job; of equal times the later state of the machine wins."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(status))
    return updates.groupBy(key).agg(F.max_by(status, F.struct(order, rank)).alias(status), F.max(order).alias(order), F.count(F.lit(1)).alias("n_updates"))
