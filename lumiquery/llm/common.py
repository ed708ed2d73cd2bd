"""Shared pieces of the training-data operators: checkpoints, prefix sums, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII lower-casing only; other letters keep their case.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

#: White space of the word rules: space, tab, LF, VT, FF, CR.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"

#: Largest number of rows that is broadcast as a lookup table.
BROADCAST_ROWS = 100_000

#: Texts that are Python objects at a time.
TEXTS_PER_SLICE = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster
    without it is an error, since a machine-local folder would lose data there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (written once, at once)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Short pieces of Arrow batches, so that few texts are Python objects at a time.

    Spark bounds a batch by bytes on its own; no setting of the session is touched.
    """
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(first, rows)


def field_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or a field of a struct in it (``struct.field``)."""
    first, _, rest = name.partition(".")
    column = batch.column(first)
    return pc.struct_field(column, rest) if rest else column


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = TEXTS_PER_SLICE) -> Iterator[None]:
    """While steps run here, Spark puts at most so many rows into an Arrow batch; then the session is as it was.

    It bounds what the JVM and Arrow hold of texts in a task; frames that are evaluated later go by the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if 0 < before <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark takes a column back."""
    return to_arrow_type(kind)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reaches is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names in a folder that begin so, in order."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(n for n in (f.getPath().getName() for f in found) if n.startswith(prefix))


def bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of the data files in a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sum(f.getLen() for f in found if not f.getPath().getName().startswith(("_", ".")))


def lookup(df: DataFrame) -> DataFrame:
    """Mark a checkpointed table for broadcast if it is small, else leave the join to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z, and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_order_prefix(rows: DataFrame, groups: list[str], size: str, h32: str, order: list[str], group_rows: str) -> DataFrame:
    """Add ``before``: the sum of ``size`` over the rows of the same group that come earlier.

    The order is by the uniform 32-bit hash ``h32`` and then ``order``. Because the
    hash is uniform, equal intervals of it are the range partitions of a sort, with no
    sampling pass: each group is cut into about sqrt(its rows) intervals (256 rows each
    at least), each interval is summed alone, and the interval totals are prefix-summed.
    So no task ever holds a hot group, and the two window passes meet about
    sqrt(rows) entries each.
    """
    per = F.greatest(F.lit(256.0), F.sqrt(F.col(group_rows)))
    parts = F.ceil(F.col(group_rows) / per)
    rows = rows.withColumn("_part", F.floor(F.col(h32) * parts / F.lit(4294967296.0)).cast("long"))
    totals = rows.groupBy(*groups, "_part").agg(F.sum(size).alias("_total"))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*groups, "_part").orderBy(h32, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    t = totals.select(*[F.col(g).alias(f"_t_{g}") for g in groups], F.col("_part").alias("_t_part"), "_ahead")
    same = F.col("_part") == F.col("_t_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
    out = rows.join(t, same, "left").withColumn("before", F.col("_inside") + F.col("_ahead"))
    return out.drop("_part", "_inside", "_ahead", "_t_part", *[f"_t_{g}" for g in groups])


def pin(df: DataFrame) -> DataFrame:
    """The same rows as one physical RDD, so that several passes see the same partitions.

    Planning a frame twice may split its files differently (splits depend on the cores
    that are registered at that moment). Nothing is computed or stored here.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)
