"""Records of delimited text files whose quoted fields may hold line breaks, read by many tasks.

Files are read as lines, split at any line break. At the begin of a line a reader is either
between records or within a quoted field, so what a range of lines does is a function of
two states. Tasks work out that function for their ranges, one small row a range; composed
in order for each file they give the state in which each range begins. A second pass over the
same ranges puts lines together to records. What is cut by a range's end leaves as a piece,
and the few pieces are joined in order. The first line of each file is its header.

Rules are those of Python's ``csv``: a quote opens a field only at the field's begin, two
quotes within one are a quote, and what follows a closing quote belongs to the field. An
open quote at a file's end closes there. Lines are bytes up to the end, so the encoding is
found from all of them (``encoding_of``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that cp1252 has no characters for.
UNDEFINED = "[\\x81\\x8D\\x8F\\x90\\x9D]"
#: What a range's end cuts: the rest of a record from before, and the begin of one that goes on.
REST, WHOLE, BEGIN = 0, 1, 2


def state_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line that begins so ends within a quoted field."""
    if b'"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            # the closing quote is the first that isn't doubled
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != b'"':
                    break
                at += 2
            inside = False
        # to the begin of the next field
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1
        inside = line[at : at + 1] == b'"'
        if inside:
            at += 1
        elif at >= n:
            return False


def after_line(line: bytes, inside: bool, sep: bytes) -> bool:
    """The same for a line that may begin with a field."""
    if not inside and line[:1] == b'"':
        return state_after(line[1:], True, sep)
    return state_after(line, inside, sep)


def pinned(df: DataFrame) -> DataFrame:
    """The same rows as one physical plan, so that both passes see the same ranges."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the first byte of the range that they were read in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return pinned(lines.select(*where, F.col("value").cast("binary").alias("line")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """Lines of a task in parts of one file and range each, in order."""
    for batch in batches:
        files, starts, lines = (batch.column(k).to_pylist() for k in range(3))
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (files[k], starts[k]) != (files[first], starts[first]):
                yield files[first], starts[first], lines[first:k]
                first = k


def range_functions(lines: DataFrame, sep: str) -> DataFrame:
    """For each file and range the state at its end, from both states at its begin."""
    own = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        ends = [False, True]
        for file, start, some in _runs(batches):
            if (file, start) != now:
                if now:
                    yield pa.record_batch([pa.array([x]) for x in (*now, *ends)], ["file", "start", "from_out", "from_in"])
                now, ends = (file, start), [False, True]
            for line in some:
                if b'"' in line:
                    ends = [after_line(line, e, own) for e in ends]
        if now:
            yield pa.record_batch([pa.array([x]) for x in (*now, *ends)], ["file", "start", "from_out", "from_in"])

    return lines.mapInArrow(run, "file string, start long, from_out boolean, from_in boolean")


def begins_inside(functions: DataFrame) -> list[tuple[str, int]]:
    """Files and ranges that begin within a quoted field: as many at most as records are cut by a range's end."""

    def compose(frame):  # noqa: ANN001, ANN202
        inside, out = False, []
        for r in frame.sort_values("start").itertuples():
            out.append(inside)
            inside = r.from_in if inside else r.from_out
        return frame.sort_values("start")[["file", "start"]].assign(inside=out)

    if not functions.filter("from_out").take(1):
        return []  # no range ends within a field
    found = functions.groupBy("file").applyInPandas(compose, "file string, start long, inside boolean")
    return [(r["file"], r["start"]) for r in found.filter("inside").collect()]


def _pieces(lines: DataFrame, sep: str, inside: list[tuple[str, int]]) -> DataFrame:
    """Records and cut pieces of each range; the first record of a file is its header."""
    own, begin = sep.encode(), lines.sparkSession.sparkContext.broadcast(set(inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, rest, header = None, False, [], False, False
        out: list[tuple] = []

        def close(kind: int) -> None:
            if held:
                out.append((*now, kind, header and kind != REST, b"\n".join(held)))
                held.clear()

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            made = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["file", "start", "kind", "header", "record"])
            out.clear()
            return made

        for file, start, some in _runs(batches):
            if (file, start) != now:
                close(REST if rest else BEGIN)
                now, state = (file, start), (file, start) in begin.value
                rest, header = state, start == 0
            for line in some:
                held.append(line)
                state = after_line(line, state, own)
                if not state:
                    close(REST if rest else WHOLE)
                    header = header and rest
                    rest = False
            if out:
                yield flush()
        close(REST if rest else BEGIN)
        if out:
            yield flush()

    return lines.mapInArrow(run, "file string, start long, kind int, header boolean, record binary")


def records(lines: DataFrame, sep: str = ",") -> DataFrame:
    """``record`` (bytes, without the line break at its end) and whether it is a ``header``, one row for each record."""
    inside = begins_inside(range_functions(lines, sep))
    pieces = _pieces(lines, sep, inside)
    whole = pieces.filter(F.col("kind") == WHOLE).select("header", "record")
    cut = pieces.filter(F.col("kind") != WHOLE)
    if not inside:
        # what is open at a file's end has no rest
        return whole.unionByName(cut.select("header", "record"))
    from pyspark.sql import Window

    # a rest belongs to the last begin before it
    number = F.sum((F.col("kind") == BEGIN).cast("long")).over(Window.partitionBy("file").orderBy("start", "kind"))
    joined = cut.withColumn("n", number).groupBy("file", "n").agg(F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "kind", F.base64("record").alias("b")))).alias("parts"))
    text = F.aggregate(F.transform("parts", lambda p: F.unbase64(p["b"])), F.lit(None).cast("binary"), lambda a, p: F.when(a.isNull(), p).otherwise(F.concat(a, F.lit(b"\n"), p)))
    return whole.unionByName(joined.select("header", text.alias("record")))


def encoding_of(lines: DataFrame) -> str:
    """The first encoding that fits every byte of every file: UTF-8, else cp1252, else Latin-1."""
    text = F.col("line").cast("string")
    odd = lines.filter(~F.is_valid_utf8(text)).agg(F.count(F.lit(1)), F.max(F.decode("line", "ISO-8859-1").rlike(UNDEFINED))).first()
    return "utf-8" if not odd[0] else "latin1" if odd[1] else "cp1252"
