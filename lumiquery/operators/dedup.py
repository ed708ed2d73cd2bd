"""Deduplication, overlap and replicate analysis of measurement tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources from most to least preferred, a parameter of whoever names the sources; unknown ones come last.
SOURCE_PREFERENCE = ("handbook", "literature", "aggregate")


def source_rank(source: Column, preference: tuple[str, ...] = SOURCE_PREFERENCE) -> Column:
    """Place of a source in the preference, without regard to case."""
    out = F.when(F.lit(False), F.lit(0))
    for k, name in enumerate(preference):
        out = out.when(F.lower(source) == name.lower(), F.lit(k))
    return out.otherwise(F.lit(len(preference)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order. ``dropDuplicates`` alone would keep any.

    Spark turns the filter into a group limit below the shuffle, so of a hot key each
    task sends on one row.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def keep_source_preferred(df: DataFrame, keys: list[str], order: list[Column], source: str = "source_dataset") -> DataFrame:
    """Of rows with an equal key, the one of the preferred source, then the earliest."""
    return keep_first(df, keys, [source_rank(F.col(source)), *order])


def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the number of rows that share the key, and whether there are several.

    Keys are counted and joined back, so a hot key is summed in parts and its rows can be split.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")).filter("group_rows > 1")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "group_rows")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = df.join(counts, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.withColumn("group_rows", F.coalesce("group_rows", F.lit(1))).withColumn("is_duplicate", F.col("group_rows") > 1)


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is shared, and rows whose key is not, without touching the rows again."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy((F.col("_n") > 1).alias("is_duplicate")).agg(F.sum("_n").alias("n_rows"))


def replicates(df: DataFrame, pair: list[str], measurement: Column, values: list[str], source: str = "source_dataset") -> DataFrame:
    """Pairs that were measured several times with different results."""
    marks, merged, names = source_marks(df, source)
    bounds = [f(c).alias(f"{n}_{v}") for v in values for n, f, c in (("min", F.min, v), ("max", F.max, v))]
    per = df.groupBy(*pair, measurement.alias("_m")).agg(F.count(F.lit(1)).alias("_n"), merged(marks).alias("_s"), *bounds)
    again = [f(c).alias(c) for v in values for f, c in ((F.min, f"min_{v}"), (F.max, f"max_{v}"))]
    # a measurement without any value is a row, but no distinct measurement
    out = per.groupBy(*pair).agg(F.sum("_n").alias("n_rows"), F.count("_m").alias("n_distinct"), merged(F.col("_s")).alias("_s"), *again)
    out = out.filter("n_rows > 1 AND n_distinct > 1").withColumn("sources", names("_s", ","))
    return out.select(*pair, "n_rows", "n_distinct", "sources", *[f"{n}_{v}" for v in values for n in ("min", "max")])


#: So many sources are bits of a long; more are sets of names.
MAX_SOURCES = 60


def source_marks(df: DataFrame, source: str) -> tuple[Column, Callable[[Column], Column], Callable[[str, str], Column]]:
    """A mark of each row's source, an aggregate that merges marks to sets, and the names of a set in order.

    Up to ``MAX_SOURCES`` sources are bits, so that sets are numbers of a hash aggregate.
    Beyond, a set is a sorted array of names: as long as the sources of one key.
    """
    found = sorted(r[0] for r in df.select(source).filter(F.col(source).isNotNull()).distinct().limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        name = F.col(source).cast("string")
        mark = F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))
        return mark, lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), lambda c, sep: F.array_join(c, sep)
    mark = F.lit(0).cast("long")
    for k, name in enumerate(found):
        mark = F.when(F.col(source) == name, F.lit(1 << k).cast("long")).otherwise(mark)
    # byte order, as sorting an array of texts has it
    in_order = sorted(range(len(found)), key=lambda k: found[k].encode())
    return mark, F.bit_or, lambda c, sep: F.concat_ws(sep, *[F.when(F.col(c).bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(found[k])) for k in in_order])


def overlap_by_sources(df: DataFrame, keys: list[str], source: str = "source_dataset") -> DataFrame:
    """Number of keys for each combination of sources that hold them."""
    marks, merged, names = source_marks(df, source)
    per = df.groupBy(*keys).agg(merged(marks).alias("_s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("_s").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows")).select(names("_s", "+").alias("sources"), "n_keys", "n_rows")


def key_intersections(df: DataFrame, keys: list[str], sources: list[str], source: str = "source_dataset") -> DataFrame:
    """Number of keys that each pair of sources shares: one pass with a flag for each source."""
    flags = [F.bool_or(F.col(source) == s).alias(f"_s{k}") for k, s in enumerate(sources)]
    per = df.groupBy(*keys).agg(*flags)
    pairs = list(combinations(range(len(sources)), 2))
    counts = per.agg(*[F.count_if(F.col(f"_s{a}") & F.col(f"_s{b}")).alias(f"_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(sources[a]).alias("source_a"), F.lit(sources[b]).alias("source_b"), F.col(f"_{a}_{b}").alias("n_shared")) for a, b in pairs])
    return counts.select(F.inline(rows))


def coverage_rollup(df: DataFrame, value: str, thresholds: list[int], source: str = "source_dataset") -> DataFrame:
    """Rows at or above each threshold, by source and in all."""
    counts = [F.count_if(F.col(value) >= t).alias(f"ge_{t}") for t in thresholds]
    out = df.rollup(source).agg(F.grouping(source).alias("_g"), F.count(F.lit(1)).alias("n_rows"), *counts)
    return out.withColumn(source, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(source))).drop("_g")


def union_sources(frames: list[DataFrame], columns: list[str], targets: list[str], keys: list[str]) -> DataFrame:
    """All sources by column name, rows without a key or without any target dropped, equal rows once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*columns).na.drop(subset=keys).na.drop(how="all", subset=targets).distinct()
