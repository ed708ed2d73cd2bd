"""Text sources: encodings, delimiters, ragged rows, optional files and file discovery."""

from __future__ import annotations

import csv
import io
import re
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from . import records as delimited

#: Encodings in the order in which they are tried, and what Spark calls them.
ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin1": "ISO-8859-1"}
HEAD_BYTES = 1 << 20


#: Spark reads cp1252 as Latin-1; these are the characters at which the two differ.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _head(spark: SparkSession, path: str) -> bytes:
    """First bytes of a file of any file system that Spark reaches; FileNotFoundError without it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        names = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        return _head(spark, names[0]) if names else b""
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def detect_delimiter(head: str) -> str:
    """Delimiter by sniffing, a comma if that fails."""
    try:
        return csv.Sniffer().sniff(head[:20_000], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _text(value: Column, encoding: str) -> Column:
    """Bytes as text; what isn't UTF-8 or Latin-1 by Spark's names goes by a character map."""
    if ENCODINGS.get(encoding, encoding) == "UTF-8":
        return value.cast("string")
    found = F.decode(value, ENCODINGS.get(encoding, encoding))
    return F.translate(found, _LATIN, _CP1252) if encoding == "cp1252" else found


def _header(head: bytes, encoding: str, sep: str) -> list[str]:
    """Names of the first record; an empty one is named by its place, a repeated one gets it as a suffix."""
    first = next(csv.reader(io.StringIO(head.decode(encoding, "ignore").lstrip("\ufeff"), newline=""), delimiter=sep), [])
    lower = [n.lower() for n in first]
    return [f"_c{k}" if not n else f"{n}{k}" if lower.count(n.lower()) > 1 else n for k, n in enumerate(first)]


def _body(spark: SparkSession, path: str, sniff: bool, encoding: str | None) -> tuple[DataFrame, list[str], str]:
    """Records of all files but their headers, as text; the names in the first header; the delimiter."""
    head = _head(spark, path)
    lines = delimited.lines_of(spark, path)
    name = encoding or delimited.encoding_of(lines)
    sep = detect_delimiter(head.decode(name, "ignore")) if sniff else ","
    rows = delimited.records(lines, sep).filter(~F.col("header"))
    value = F.regexp_replace(_text(F.col("record"), name), "\r$", "")
    return rows.select(value.alias("value")).filter(F.trim("value") != ""), _header(head, name, sep), sep


def read_csv(spark: SparkSession, path: str, sniff: bool = False, encoding: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file, or a folder of them, as text columns.

    The encoding is found from all bytes, the delimiter from the first. A file is read by
    many tasks, also where quoted fields hold line breaks.
    """
    rows, names, sep = _body(spark, path, sniff, encoding)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    df = rows.select(F.from_csv("value", F.lit(ddl), {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}).alias("_row")).select("_row.*")
    return df.select(*columns) if columns else df


def read_csv_ragged(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose rows may be too long or short: surplus cells are joined into the last column, missing ones are null."""
    rows, names, _ = _body(spark, path, False, None)
    n = len(names)
    if not n:
        return spark.createDataFrame([], T.StructType([]))

    def parse(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            found = []
            for record in b["value"]:
                cells = next(csv.reader(io.StringIO(record, newline="")), [])
                row = [*cells[: n - 1], ",".join(cells[n - 1 :])] if len(cells) >= n else [*cells, *[None] * (n - len(cells))]
                found.append([x if x != "" else None for x in row])
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(parse, T.StructType([T.StructField(c, T.StringType()) for c in names]))


def read_csv_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file, or an empty frame of the schema if it is missing or empty; missing columns are null."""
    try:
        head = _head(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    if not head.strip():
        return spark.createDataFrame([], schema)
    return fit_schema(read_csv(spark, path), schema)


def discover(folder: str, pattern: str, exclude: tuple[str, ...] = (), spark: SparkSession | None = None) -> list[str]:
    """Files below a folder by pattern, in order, without those excluded; an error if there are none.

    With a session, of any file system that it reaches; without, of the driver's disk.
    """
    if spark is not None:
        found = files.find(spark, folder, pattern, exclude)
    else:
        found = sorted(str(p) for p in Path(folder).rglob(pattern) if not any(fnmatch(p.name, x) for x in exclude))
    if not found:
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return found


def read_labelled(spark: SparkSession, paths: list[str], name: str = "run_label") -> DataFrame:
    """Several CSV files as one table, with the label of the file each row came from."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    file = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))  # Spark gives the name as in a URI: blanks and other letters are encoded
    label = F.replace(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    return df.withColumn(name, label)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents that may span lines; unreadable ones are kept in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def first_existing(*paths: str | None, spark: SparkSession | None = None) -> str:
    """The first path that exists, of any file system with a session."""
    for p in paths:
        if p and (files.exists(spark, p) if spark is not None else Path(p).exists()):
            return p
    raise FileNotFoundError(", ".join(p for p in paths if p))


def resolve_column(columns: list[str], candidates: list[str], mode: str = "exact", override: str | None = None, keyword: str | tuple[str, ...] | None = None, required: bool = False) -> str | None:
    """Find a column by priority: exactly, without regard to case, by letters and digits, or else by a keyword in its name."""
    keys = {"exact": lambda x: x, "casefold": str.casefold, "alnum": lambda x: re.sub(r"[^a-z0-9]", "", x.lower())}
    key = keys[mode]
    if override:
        if override in columns:
            return override
        raise KeyError(f"{override} is not among {', '.join(columns)}")
    by_key: dict[str, str] = {}
    for c in columns:
        by_key.setdefault(key(c), c)
    for c in candidates:
        if key(c) in by_key:
            return by_key[key(c)]
    for k in (keyword,) if isinstance(keyword, str) else keyword or ():
        for c in columns:
            if k.lower() in c.lower():
                return c
    if required:
        raise KeyError(f"none of {', '.join(candidates)} is among {', '.join(columns)}")
    return None


def fit_schema(df: DataFrame, schema: T.StructType, fill: Column | None = None) -> DataFrame:
    """Exactly the schema's columns in order; absent ones are null or the fill value, others are dropped."""
    empty = F.lit(None) if fill is None else fill
    return df.select(*[(F.col(f.name) if f.name in df.columns else empty).cast(f.dataType).alias(f.name) for f in schema.fields])


def align(df: DataFrame, schema: T.StructType, fill: Column | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """``fit_schema``, with the columns that were added (filled) and those that were dropped, in order."""
    names = [f.name for f in schema.fields]
    return fit_schema(df, schema, fill), [n for n in names if n not in df.columns], [c for c in df.columns if c not in names]


def sanitize_names(columns: list[str]) -> list[str]:
    """Names of letters, digits and underscores; a number is added where two would be equal."""
    out: list[str] = []
    for c in columns:
        base = re.sub(r"\W+", "_", c).strip("_") or "column"
        name, k = base, 1
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def split_list(text: str | None) -> list[str]:
    """Entries of a comma-separated argument, without blanks."""
    return [x for x in (p.strip() for p in (text or "").split(",")) if x]


def strip_affixes(name: str, prefix: str = "", suffix: str = "") -> str:
    """A name without its prefix and suffix, where it has them."""
    return name.removeprefix(prefix).removesuffix(suffix)


def target_of(c: Column, prefix: str, suffix: str) -> Column:
    """The same for a column."""
    return F.regexp_replace(F.regexp_replace(c, "^" + re.escape(prefix), ""), re.escape(suffix) + "$", "")


def reorder(columns: list[str], preferred: list[str], core: list[str], internal: tuple[str, ...] = ()) -> list[str]:
    """Preferred columns, then the others, then the core ones; internal ones and those with a leading underscore go."""
    rest = [c for c in columns if c not in preferred and c not in core and c not in internal and not c.startswith("_")]
    return list(dict.fromkeys([*(c for c in preferred if c in columns), *rest, *(c for c in core if c in columns)]))


def insert_first(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns put before all others (one of the same name is replaced)."""
    return df.select(*[c.alias(n) for n, c in columns.items()], *[F.col(f"`{c}`") for c in df.columns if c not in columns])


#: Terms by which a column shows a property.
PROPERTY_TERMS = ("absorption", "emission", "quantum", "yield", "plqy", "lifetime", "extinction", "reference", "source")


def property_columns(columns: list[str], first: tuple[str, ...] = (), terms: tuple[str, ...] = PROPERTY_TERMS) -> list[str]:
    """The columns that come first, and then those whose name has one of the terms."""
    return list(dict.fromkeys([*(c for c in first if c in columns), *(c for c in columns if any(t in c.casefold() for t in terms))]))


def with_ordinal(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number the rows from 0 in the order in which they are read.

    Spark numbers the rows of each partition; the partitions' counts, one row each, are summed in order and joined.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    out = rows.join(F.broadcast(starts), part == F.col("_part"))  # one row a partition
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")
