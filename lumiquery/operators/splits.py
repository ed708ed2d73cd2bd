"""Leakage-safe splits: reproducible by hash, disjoint by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles, running_sum


def hash_order(key: Column, seed: int) -> Column:
    """A key's place in an order that only it and the seed decide; SQL engines with MD5 give the same."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))


def hash_unit(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that only key and seed decide (``randomSplit`` depends on partitioning)."""
    return F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_split(df: DataFrame, key: Column, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Row split by hash."""
    return df.withColumn("split", F.when(hash_unit(key, seed) < test, "test").otherwise("train"))


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ceil(test * groups) groups to test: groups, not rows, are ranked by hash."""
    df = df.drop("split")
    groups = df.select(group).distinct()
    total = F.broadcast(groups.agg(F.count(F.lit(1)).alias("_total")))  # one row
    ranked = running_sum(groups, [hash_order(F.col(group), seed), F.col(group)], F.lit(1), "_before")
    side = ranked.crossJoin(total).select(group, F.when(F.col("_before") < F.ceil(F.col("_total") * test), "test").otherwise("train").alias("split"))
    return df.join(side, df[group].eqNullSafe(side[group])).drop(side[group])


def group_split_three(df: DataFrame, group: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Test groups first, then validation groups among the rest with the next seed."""
    share = min(0.5, max(0.05, val / (1 - test)))
    first = group_split(df, group, test, seed)
    rest = group_split(first.filter("split = 'train'").drop("split"), group, share, seed + 1)
    rest = rest.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return first.filter("split = 'test'").unionByName(rest)


def greedy_group_split(df: DataFrame, group: str, test: float = 0.2, tie: Column | None = None) -> DataFrame:
    """Largest groups go to test while the test rows before them are fewer than the share asked for."""
    df = df.drop("split")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(sizes.agg(F.sum("_n").alias("_total")))  # one row
    ranked = running_sum(sizes, [F.col("_n").desc(), tie if tie is not None else F.col(group)], F.col("_n"), "_before")
    side = ranked.crossJoin(total).select(group, F.when(F.col("_before") < F.round(F.col("_total") * test), "test").otherwise("train").alias("split"))
    return df.join(side, df[group].eqNullSafe(side[group])).drop(side[group])


def split_counts(df: DataFrame, molecule: str, scaffold: str) -> DataFrame:
    """Rows, distinct molecules and scaffolds of each side."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(molecule).alias("n_molecules"), F.countDistinct(scaffold).alias("n_scaffolds"))


def train_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians of the training rows, in one row; null for a column without values."""
    train = df.filter("split = 'train'").select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    found = quantiles(train, ["name"], "value", (0.5,), ("median",))
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the training median, or 0 without one; the medians are one broadcast row."""
    medians = train_medians(df, columns).select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))
    return out.withColumns({f"{c}_imputed": F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale by mean and population deviation of the training rows; constant columns are only centred."""
    stats = df.filter("split = 'train'").agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_a_{c}")) / scale(c) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in "as"])


def seeded_sample(df: DataFrame, key: list[Column], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the same for the same seed."""
    return df.orderBy(hash_order(F.concat_ws("|", *key), seed), *key).limit(n)
