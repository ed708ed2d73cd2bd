"""Profiles of tables: missing values, numbers, frequencies, noise and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, in number and percent: one aggregation, then one row a column."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing"), F.round(100.0 * F.col(c) / F.col("_n"), 6).alias("pct_missing")) for c in columns])
    return one.select(F.inline(rows))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation and exact quartiles of each column."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])))
    v = F.col("value")
    stats = cells.groupBy("column_name").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    quarters = ordering.quantiles(cells, ["column_name"], "value", (0.25, 0.5, 0.75), ("q25", "q50", "q75"))
    return stats.join(quarters, "column_name", "left").select("column_name", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequencies, missing and blank values by name."""
    label = F.when(F.col(column).isNull(), "<missing>").when(F.trim(column) == "", "<blank>").otherwise(F.col(column))
    return df.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def noise_statistics(df: DataFrame, keys: list[str], value: str, source: str, least: int = 2) -> DataFrame:
    """Spread of repeated measurements in range; the interquartile range needs four of them."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one map of values serves all three
    out = df.filter(F.col(value).between(0, 1)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("n_distinct"), F.avg(value).alias("mean"), q[1].alias("median"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"),
        F.when(F.count(F.lit(1)) >= 4, q[2] - q[0]).alias("iqr"), F.array_join(F.array_sort(F.collect_set(source)), "; ").alias("sources"),
    )
    return out.filter(F.col("n") >= least)


def noise_report(stats: DataFrame) -> DataFrame:
    """Share of groups whose range is over 0.05 and over 0.10."""
    share = lambda c: 100 * F.avg(c.cast("double"))
    return stats.agg(F.count(F.lit(1)).alias("n_groups"), F.median("range").alias("median_range"), share(F.col("range") > 0.05).alias("pct_over_005"), share(F.col("range") > 0.10).alias("pct_over_010"))


def grouped_errors(df: DataFrame, group: Column, name: str) -> DataFrame:
    """Rows, MAE, median absolute error, RMSE and mean residual of each category.

    Categories may be few and large, so medians come from ordered counts.
    """
    r = F.col("_r")
    rows = df.select(group.alias(name), (F.col("y_true") - F.col("y_pred")).alias("_r")).withColumn("_e", F.abs("_r"))
    means = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("_e").alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("mean_residual"))
    medians, same = ordering.same_keys(means, ordering.quantiles(rows, [name], "_e", (0.5,), ("median_ae",)), [name])
    return means.join(medians, same, "left").select(name, "n_rows", "mae", "median_ae", "rmse", "mean_residual")


def modal_value(df: DataFrame, keys: list[str], predicted: str, error: str) -> DataFrame:
    """Expected value that most rows agree on: each row votes for predicted plus and minus its error.

    Accepted with max(2, rows // 3) votes; of equal counts the smallest value wins.
    """
    n = df.filter(F.col(predicted).isNotNull() & F.col(error).isNotNull())
    votes = n.select(*keys, F.explode(F.array_distinct(F.array(F.round(F.col(predicted) - F.col(error), 6), F.round(F.col(predicted) + F.col(error), 6)))).alias("value"))
    counts = votes.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("votes"), "value")).alias("expected"), F.max("votes").alias("votes"))
    rows = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return best.join(rows, keys).filter(F.col("votes") >= F.greatest(F.lit(2), F.floor(F.col("n_rows") / 3)))
