"""Token-ID output in training order.

Documents are tokenized and cut into sequences of a fixed length. Each sequence has an
ordinal (offset of its partition, plus its place there); a keyed Feistel permutation of
the smallest power of four that is large enough, with cycle-walking, maps the ordinals
0..N-1 onto the slots 0..N-1. Slots are range-partitioned: shard k is the range of slots
from ``k * per_shard`` on, one task writes it, sorted by slot, as one file of records of a
fixed stride. So the record of slot s is at byte ``(s % per_shard) * stride`` of shard
``s // per_shard``, and a reader that stops at a slot resumes at that byte
(``stream_records``, ``read_tokens``). Shards grow with the square root of the data, so neither
their number nor a task's bytes runs away.

Two passes read the documents: the first only counts sequences (one row a partition
reaches the driver), so token ids are shuffled once and stored once. Both passes run on
one physical RDD, so they see the same partitions; the second checks that its texts, in
their order, and its counts are those of the first, so a partition that comes back
otherwise after a loss is an error and never a doubled or missing slot. Files are written
by Spark's own text writer, raw bytes and all, and commit with their tasks; the layout is
written last, so a directory without it is not complete.

A record is: slot, document id (int64 each), sequence number in the document, number of
tokens (int32 each), ``length`` token ids (uint16, filled up with the end token), and a
line feed; all little-endian. The sequence number of a row without an id is its complement
(below zero). An id that is no integer is written as its 64-bit hash, and a table beside
the shards, ``_ids``, gives it back.

Edge cases: a null or empty text is one sequence that holds the end token alone; a null
id is read back as null; repeated rows each have sequences of their own; other columns
are ignored; an empty table writes no shard and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
#: Fixed value: how the vocabulary's texts are cut before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LENGTH = 256
KEY = 0x5EED_0F_0DD5
ROUNDS = 6
#: A shard's slots: about so many times the square root of all, a power of two within these limits (0.5 MB to 1.1 GB a shard).
SHARD_GROWTH, MIN_PER_SHARD, MAX_PER_SHARD = 8, 1_024, 2_097_152
HEADER = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4")])
#: Records that are read from a shard at once.
READ_RECORDS = 4_096
RECORD = "slot long, shard long, offset long, doc_id long, seq_no int, n_tokens int, crc32 long, tokens binary"


class Tokenizer:
    """Token ids as uint16 bytes."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def count(self, text: str | None) -> int:
        """Number of ids, the end token included."""
        return len(self.encoding.encode_ordinary(text or "")) + 1

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, and the end token."""
        ids = array("H", self.encoding.encode_ordinary(text or ""))
        ids.append(END)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; end tokens are left out."""
        return self.encoding.decode([int(i) for i in ids if i != END])


_made: dict[bytes, Tokenizer] = {}


def tokenizer_of(ranks: bytes) -> Tokenizer:
    """The tokenizer of a vocabulary, made once a Python worker."""
    digest = hashlib.sha256(ranks).digest()
    if digest not in _made:
        _made.clear()
        _made[digest] = Tokenizer(ranks)
    return _made[digest]


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..n-1: Feistel rounds on an even number of bits, cycle-walking until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64(2**half - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 2**64, ROUNDS, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> bits, v & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << bits) | right

    out = once(np.asarray(x).astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def per_shard(n: int) -> int:
    """Slots of a shard for n sequences: a power of two."""
    want = max(1, math.isqrt(max(0, n - 1)) * SHARD_GROWTH)
    return min(MAX_PER_SHARD, max(MIN_PER_SHARD, 1 << (want - 1).bit_length()))


def stride(length: int = LENGTH) -> int:
    """Bytes of a record."""
    return HEADER.itemsize + 2 * length + 1


def _vocabulary(spark: SparkSession, path: str):  # noqa: ANN202
    """The vocabulary file, read once on the driver: its size is that of a vocabulary."""
    rows = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first() if "://" in path else None
    data = bytes(rows[0]) if rows else open(path, "rb").read()  # noqa: SIM115
    return spark.sparkContext.broadcast(data)


def _plain_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _write_ids(docs: DataFrame, path: str, id_col: str) -> None:
    """The table from hash to id; two ids with one hash are an error."""
    ids = docs.select(F.xxhash64(id_col).alias("hash"), F.col(id_col).alias("id")).filter("id IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("_other"))
    clash = F.when(F.col("id") == F.col("_other"), F.col("id")).otherwise(F.raise_error(F.lit("two ids have the same hash")).cast(docs.schema[id_col].dataType))
    ids.select("hash", clash.alias("id")).write.mode("overwrite").parquet(f"{path}/_ids")


def _marked(mark: int, hashes: pa.Array) -> int:
    """A running mark of the rows and their order, from their hashes."""
    return zlib.crc32(hashes.to_numpy(zero_copy_only=False).tobytes(), mark)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", vocabulary: str = VOCABULARY, length: int = LENGTH, key: int = KEY) -> int:
    """Write all shards below ``path``; returns the number of sequences."""
    if docs.isEmpty():
        return 0
    with common.few_rows_a_batch(docs.sparkSession):  # both passes run here
        return _write_tokens(docs, path, id_col, vocabulary, length, key)


def _write_tokens(docs: DataFrame, path: str, id_col: str, vocabulary: str, length: int, key: int) -> int:
    spark = docs.sparkSession
    ranks = _vocabulary(spark, vocabulary)
    row_id = F.col(id_col).cast("long") if _plain_ids(docs, id_col) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = common.pin(docs.select(row_id.alias("id"), "text", F.xxhash64(row_id, "text").alias("mark")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, n, mark = tokenizer_of(ranks.value), 0, 0
        for batch in common.slices(batches):
            for text in batch.column(1).to_pylist():
                n += -(-tokenizer.count(text) // length)
            mark = _marked(mark, batch.column(2))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "mark": pa.array([mark], pa.int64())})

    counts = {r["part"]: (r["n"], r["mark"]) for r in rows.mapInArrow(count, "part int, n long, mark long").collect()}
    total = sum(n for n, _ in counts.values())
    if not total:
        return 0
    offsets, at = {}, 0
    for part in sorted(counts):
        offsets[part], at = at, at + counts[part][0]
    slots, wide = per_shard(total), 2 * length
    fill = np.full(length, END, "<u2").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, mark = tokenizer_of(ranks.value), TaskContext.get().partitionId(), 0
        at = offsets[part]
        heads: list[tuple[int, int, int, int]] = []
        bodies: list[bytes] = []

        def emit() -> pa.RecordBatch:
            head = np.array(heads, HEADER)
            head["slot"] = feistel(np.arange(at, at + len(heads)), total, key)
            raw = head.tobytes()
            size = HEADER.itemsize
            records = [raw[k * size : (k + 1) * size] + b for k, b in enumerate(bodies)]
            return pa.RecordBatch.from_arrays([pa.array((head["slot"] // slots).astype(np.int32)), pa.array(head["slot"]), pa.array(records, pa.binary())], names=["shard", "slot", "record"])

        for batch in common.slices(batches):
            mark = _marked(mark, batch.column(2))
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text)
                for k in range(0, len(ids), wide):
                    body = ids[k : k + wide]
                    heads.append((0, doc or 0, ~(k // wide) if doc is None else k // wide, len(body) // 2))
                    bodies.append(body + fill[len(body) :])
                if len(heads) >= 8_192:
                    yield emit()
                    at += len(heads)
                    heads, bodies = [], []
        if heads:
            yield emit()
            at += len(heads)
        if (at - offsets[part], mark) != counts[part]:
            raise RuntimeError(f"partition {part} changed between the passes")

    sequences = rows.mapInArrow(cut, "shard int, slot long, record binary")
    # one partition a shard; the writer ends each row with a line feed, the record's last byte
    dealt = sequences.repartitionById(-(-total // slots), "shard").sortWithinPartitions("shard", "slot")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)
    if not _plain_ids(docs, id_col):
        _write_ids(docs, path, id_col)
    layout = {"sequences": total, "per_shard": slots, "length": length, "stride": stride(length), "key": key}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    return total


def read_layout(spark: SparkSession, path: str) -> dict[str, int]:
    """What the shards below ``path`` hold; an error if they are not complete."""
    return json.loads(spark.read.text(f"{path}/_layout").first()["value"])


def _records(spark: SparkSession, path: str, wide: int, first: int) -> DataFrame:
    """The records of all shards from one on, in one binary column. Spark's own reader seeks to ranges of whole records, so no task holds a shard."""
    shards = [n for n in common.list_names(spark, path, "shard=") if int(n.partition("=")[2]) >= first]
    if not shards:
        return spark.createDataFrame([], "record binary")
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    # more names than fit on a line are given as the folder of all; records before the start are left out later
    named = ",".join(f"{path}/{n}" for n in shards) if len(shards) <= 1_000 else f"{path}/shard=*"
    raw = sc._jsc.binaryRecords(named, wide).rdd()
    rows = spark._jsparkSession.createDataset(raw, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    return DataFrame(rows, spark).withColumnRenamed("value", "record")


def read_tokens(spark: SparkSession, path: str, start: int = 0, tokens: bool = True) -> DataFrame:
    """One row for each record from slot ``start`` on: where it is, what it holds, its ids (unless not wanted) and their CRC-32.

    Shards before that slot are not opened. A shard is read in ranges by several tasks,
    some thousand records at a time. A shard that is cut off, or holds other than its
    slots, is an error.
    """
    layout = read_layout(spark, path)
    wide, slots, length = layout["stride"], layout["per_shard"], layout["length"]
    record = np.dtype([*HEADER.descr, ("tokens", "<u2", (length,)), ("end", "u1")])
    for name in common.list_names(spark, path, "shard="):
        k = int(name.partition("=")[2])
        if k >= start // slots and common.bytes_below(spark, f"{path}/{name}") != wide * (min(layout["sequences"], (k + 1) * slots) - k * slots):
            raise ValueError(f"shard {k} is cut off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, READ_RECORDS):
            if not batch.num_rows:
                continue
            data = memoryview(b"".join(batch.column(0).to_pylist()))
            r = np.frombuffer(data, record)
            if (r["end"] != 10).any() or (r["slot"] < 0).any() or (r["slot"] >= layout["sequences"]).any():
                raise ValueError("a shard has a broken record")
            keep = np.flatnonzero(r["slot"] >= start)
            r, n, none = r[keep], len(keep), r["seq_no"][keep] < 0
            ids = [data[k : k + 2 * m] for k, m in zip((keep * wide + HEADER.itemsize).tolist(), r["n_tokens"].tolist(), strict=True)]
            more = [pa.array([bytes(t) for t in ids], pa.binary())] if tokens else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["slot"].copy()), pa.array(r["slot"] // slots), pa.array(r["slot"] % slots * wide), pa.array(r["doc_id"].copy(), mask=none), pa.array(np.where(none, ~r["seq_no"], r["seq_no"])), pa.array(r["n_tokens"].copy()), pa.array([zlib.crc32(t) for t in ids], pa.int64()), *more],
                names=["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "crc32", *(["tokens"] if tokens else [])],
            )

    out = _records(spark, path, wide, start // slots).mapInArrow(run, RECORD if tokens else RECORD.removesuffix(", tokens binary"))
    if not common.path_exists(spark, f"{path}/_ids"):
        return out
    ids = spark.read.parquet(f"{path}/_ids")
    return out.join(ids, out["doc_id"] == ids["hash"], "left").drop("hash", "doc_id").withColumnRenamed("id", "doc_id")


def stream_records(spark: SparkSession, path: str, start: int = 0) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, id, sequence number, token ids) one after the other from slot ``start`` on, as a trainer reads them.

    The file system is asked for the bytes from that slot's record on, some thousand records at a time.
    """
    layout = read_layout(spark, path)
    wide, slots = layout["stride"], layout["per_shard"]
    record = np.dtype([*HEADER.descr, ("tokens", "<u2", (layout["length"],)), ("end", "u1")])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while start < layout["sequences"]:
        shard = start // slots
        names = [str(f.getPath()) for f in fs.listStatus(hadoop(f"{path}/shard={shard}")) if f.getPath().getName().startswith("part-")]
        stream = fs.open(hadoop(names[0]))
        try:
            stream.seek((start % slots) * wide)
            while data := bytes(stream.readNBytes(READ_RECORDS * wide)):
                for r in np.frombuffer(data, record):
                    none = r["seq_no"] < 0
                    yield int(r["slot"]), None if none else int(r["doc_id"]), int(~r["seq_no"] if none else r["seq_no"]), r["tokens"][: r["n_tokens"]]
        finally:
            stream.close()
        start = (shard + 1) * slots


def materialise(docs: DataFrame, path: str, **options) -> DataFrame:  # noqa: ANN003
    """Write the shards below ``path`` and give their records, without the ids."""
    spark = docs.sparkSession
    if not write_tokens(docs, path, **options):
        return spark.createDataFrame([], RECORD).drop("tokens")
    return read_tokens(spark, path, tokens=False)
