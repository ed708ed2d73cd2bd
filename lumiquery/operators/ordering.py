"""Running sums, ranks and exact quantiles in a total order without one task for all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this many rows one window does; beyond, rows are range-partitioned.
ONE_TASK_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    from ..streaming.jobs import shared_folder

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str = "before", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add the sum of ``value`` over the rows that come earlier in the order.

    Many rows are range-partitioned by the order (and checkpointed, so the partitions
    stay as they are), summed in each part, and the parts' totals, one a partition, are
    prefix-summed and broadcast.
    """
    rows = df.withColumn("_value", value)
    ahead = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if rows.limit(one_task_rows + 1).count() <= one_task_rows:
        return rows.withColumn(out, ahead(Window.orderBy(*order))).drop("_value")
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_ahead"))
    inside = parts.withColumn("_inside", ahead(Window.partitionBy("_part").orderBy(*order)))
    joined = inside.join(F.broadcast(totals), "_part")  # one row a partition
    return joined.withColumn(out, F.col("_inside") + F.col("_ahead")).drop("_value", "_part", "_inside", "_ahead")


def place(df: DataFrame, order: list[Column], out: str = "place", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Number all rows from 1 in the order, which must be total."""
    return running_sum(df, order, F.lit(1), "_earlier", one_task_rows).withColumn(out, F.col("_earlier") + 1).drop("_earlier")


def same_keys(df: DataFrame, other: DataFrame, keys: list[str], prefix: str = "_k_") -> tuple[DataFrame, Column | None]:
    """The other frame with its keys renamed, and the null-safe condition that joins the two by them."""
    renamed = other.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[c for c in other.columns if c not in keys])
    tests = [df[k].eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    return renamed, reduce(lambda a, b: a & b, tests) if tests else None


def running_sum_by(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str = "before", total: str | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The same within each key, and the key's ``total`` if one is asked for.

    The rows are checkpointed once. Many of them are range-partitioned by key and order,
    so a key with a third of all rows is dealt over many tasks; what passes between
    tasks is one row for each key in each of them.
    """
    rows = df.withColumn("_value", value)
    sums = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_key = Window.partitionBy(*keys)
    held = cut(rows)
    if held.count() <= one_task_rows:
        held = held.withColumn(out, sums(by_key.orderBy(*order)))
        return (held.withColumn(total, F.sum("_value").over(by_key)) if total else held).drop("_value")
    parts = cut(held.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = cut(totals.withColumn("_total", F.sum("_sum").over(by_key)).drop("_sum"))
    inside = parts.withColumn("_inside", sums(Window.partitionBy("_part", *keys).orderBy(*order)))
    renamed, same = same_keys(inside, totals, [*keys, "_part"])
    from .joins import checked_broadcast

    joined = inside.join(checked_broadcast(renamed), same).withColumn(out, F.col("_inside") + F.col("_ahead"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_value", "_part", "_inside", "_ahead", "_total", *[f"_k_{k}" for k in (*keys, "_part")])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], names: tuple[str, ...], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact quantiles of each key, interpolated between neighbours: one row a key.

    Rows are counted by value, the counts are summed in order over many tasks, and the
    values at the wanted places are picked; no task holds all values of a key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum_by(counts, keys, [F.col("_v")], F.col("_n"), "_before", "_all", one_task_rows)
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_v")))
    picks = []
    for share, name in zip(shares, names, strict=True):
        place = F.lit(share) * (F.col("_all") - 1)
        picks += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in names])
