"""Joins with fallbacks, lookups by priority, membership and enumeration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_first

#: Dimension tables up to this many rows are broadcast; larger ones are left to the planner.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side after counting that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unique_dimension(dim: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key that isn't null, the first in order."""
    return keep_first(dim.filter(F.col(key).isNotNull()), [key], order)


def two_step_join(df: DataFrame, dim: DataFrame, key: str, label: Column, dim_key: str, dim_label: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Left join on the canonical key; rows whose values are then all null take those found by label.

    The second step fires on all-null values, also of a key that matched.
    """
    values = lambda p: [F.col(c).alias(f"{p}{c}") for c in columns]
    first = unique_dimension(dim, dim_key, order).select(F.col(dim_key).alias("_key"), *values("_a_"))
    labelled = dim.withColumn("_label", F.lower(F.trim(dim_label)))
    second = unique_dimension(labelled, "_label", order).select("_label", *values("_b_"))
    out = df.join(checked_broadcast(first), df[key] == F.col("_key"), "left")
    out = out.join(checked_broadcast(second), F.lower(F.trim(label)) == F.col("_label"), "left")
    none = reduce(lambda a, b: a & b, [F.col(f"_a_{c}").isNull() for c in columns])
    found = {c: F.when(none, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")) for c in columns}
    step = F.when(~none, "canonical").when(reduce(lambda a, b: a | b, [F.col(f"_b_{c}").isNotNull() for c in columns]), "label").otherwise("none")
    out = out.withColumn("descriptor_match", step).withColumns(found)
    return out.drop("_key", "_label", *[f"_{p}_{c}" for p in "ab" for c in columns])


def point_lookup(dim: DataFrame, canonical: str, label: str, dim_key: str, dim_label: str, order: list[Column]) -> DataFrame:
    """The one row that matches the canonical key, or else the label."""
    hits = dim.withColumn("_rank", F.when(F.col(dim_key) == canonical, 0).when(F.lower(F.trim(dim_label)) == label.strip().lower(), 1)).filter("_rank IS NOT NULL")
    return hits.orderBy("_rank", *order).limit(1).drop("_rank")


def alias_join(df: DataFrame, label: str, aliases: dict[str, str], out: str) -> DataFrame:
    """Add the canonical form of a label from a dictionary of aliases."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return df.withColumn(out, F.element_at(table, F.lower(F.trim(F.col(label)))))


def first_alias(df: DataFrame, table: DataFrame, key: str, aliases: list[str], table_key: str, value: str) -> DataFrame:
    """Value of the first listed alias that the table holds; null without any. Of equal aliases the smallest value."""
    rank = F.element_at(F.create_map(*[x for k, a in enumerate(aliases) for x in (F.lit(a), F.lit(k))]), F.col(table_key))
    hit = table.filter(F.col(table_key).isin(aliases)).agg(F.min(F.struct(rank.alias("rank"), F.col(value).alias("value"))).alias("_hit"))  # one row, also without a hit
    return df.crossJoin(F.broadcast(hit)).withColumn(key, F.col("_hit.value")).drop("_hit")


def seen_flags(benchmark: DataFrame, training: DataFrame, molecule: str, solvent: str) -> DataFrame:
    """Whether training holds the row's molecule, its solvent and the pair of both; null-safe by semi-join counts."""
    m = training.select(F.col(molecule).alias("_m")).na.drop().distinct().withColumn("_has_m", F.lit(True))
    s = training.select(F.col(solvent).alias("_s")).na.drop().distinct().withColumn("_has_s", F.lit(True))
    p = training.select(F.col(molecule).alias("_pm"), F.col(solvent).alias("_ps")).na.drop().distinct().withColumn("_has_p", F.lit(True))
    out = benchmark.join(m, F.col(molecule) == F.col("_m"), "left").join(s, F.col(solvent) == F.col("_s"), "left")
    out = out.join(p, (F.col(molecule) == F.col("_pm")) & (F.col(solvent) == F.col("_ps")), "left")
    flag = lambda c, n: F.coalesce(F.col(c), F.lit(False)).alias(n)
    return out.select(*benchmark.columns, flag("_has_m", "molecule_seen"), flag("_has_s", "solvent_seen"), flag("_has_p", "pair_seen"))


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups on each side of a split, and on both (which must be none): one aggregation by group."""
    per = df.groupBy(group).agg(F.bool_or(F.col(split) == "train").alias("_a"), F.bool_or(F.col(split) == "test").alias("_b"))
    return per.agg(F.count_if("_a").alias("train_groups"), F.count_if("_b").alias("test_groups"), F.count_if(F.col("_a") & F.col("_b")).alias("shared_groups"))


def enumerate_templates(templates: DataFrame, substituents: DataFrame) -> DataFrame:
    """Each template with each substituent; equal results once, by the first names. Both tables are short lists."""
    both = templates.crossJoin(F.broadcast(substituents))
    made = both.withColumn("smiles", F.replace(F.col("template"), F.lit("{sub}"), F.col("fragment")))
    return keep_first(made, ["smiles"], [F.col("scaffold"), F.col("substituent")]).select("scaffold", "substituent", "smiles")


def membership(df: DataFrame, molecule: str, solvent: Column, wanted_molecule: str, wanted_solvent: str) -> DataFrame:
    """Rows of a molecule, and whether their solvent is the wanted one, without regard to case and blanks."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return df.filter(F.col(molecule) == wanted_molecule).withColumn("solvent_match", F.coalesce(norm(solvent) == F.lit(" ".join(wanted_solvent.lower().split())), F.lit(False)))


def best_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
