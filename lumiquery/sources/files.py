"""Small files and folders of any file system that Spark reaches."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def resolved(spark: SparkSession, path: str) -> str:
    """The full form of a path, so that one folder has one name."""
    fs, p = _fs(spark, path)
    return fs.resolvePath(p).toString().replace("file:/", "/", 1) if fs.getScheme() == "file" else fs.resolvePath(p).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def folders_below(spark: SparkSession, path: str) -> list[str]:
    """All folders below a folder, in order."""
    fs, p = _fs(spark, path)
    out = []
    for s in sorted(fs.listStatus(p), key=lambda s: str(s.getPath())):
        if s.isDirectory():
            out += [str(s.getPath()), *folders_below(spark, str(s.getPath()))]
    return out


def find(spark: SparkSession, folder: str, pattern: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Files below a folder by pattern, in order, without those excluded."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    todo, out = fs.listFiles(p, True), []
    while todo.hasNext():
        f = todo.next().getPath()
        if fnmatch(f.getName(), pattern) and not any(fnmatch(f.getName(), x) for x in exclude):
            out.append(str(f.toString()))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file: under another name first, so that it is there whole or not at all."""
    fs, p = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path} can't be written")
