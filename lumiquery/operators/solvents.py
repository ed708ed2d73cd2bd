"""Solvent descriptors: computed for distinct solvents, joined with measured ones by label and then by canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import descriptors
from ..functions.scalars import solvent_key
from ..functions.smiles import ENVIRONMENTS
from ..sources.writers import write_csv
from .chemistry import canonicalize, on_distinct, text_udf
from .joins import checked_broadcast, unique_dimension

#: Measured properties of a solvent.
PHYSICAL = ("dielectric_constant", "refractive_index", "dipole_moment", "hbond_donor", "hbond_acceptor", "polarity_ET30")


def solvent_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each distinct solvent label that isn't blank."""
    label = F.trim(F.col(column))
    return df.filter(F.col(column).isNotNull() & (label != "")).groupBy(label.alias("solvent_original")).agg(F.count(F.lit(1)).alias("row_count"))


def describe_solvents(counts: DataFrame) -> DataFrame:
    """Canonical form, validity, environment flag and the fifteen descriptors of each distinct solvent."""
    environment = F.lower("solvent_original").isin(*sorted(ENVIRONMENTS))
    out = canonicalize(counts, "solvent_original", "canonical_solvent_smiles")
    out = on_distinct(out, "canonical_solvent_smiles", text_udf(descriptors.solvent_descriptors, "map<string,double>"), "_d")
    out = out.withColumns({"is_valid": F.col("canonical_solvent_smiles").isNotNull(), "is_environment_label": environment})
    return out.withColumns({c: F.element_at("_d", F.lit(c)) for c in descriptors.SOLVENT}).drop("_d")


def direct_then_canonical(left: DataFrame, dim: DataFrame, label: Column, canonical: str, dim_label: str, dim_canonical: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Left join by label without regard to case and blanks; rows whose label is unknown are joined by canonical form.

    ``existing_match`` says which step found a row. A row whose label is known takes that row's values, also where they are missing.
    """
    values = lambda p: [F.col(c).alias(f"{p}{c}") for c in columns]
    first = unique_dimension(dim.withColumn("_k", solvent_key(F.col(dim_label))), "_k", order).select("_k", F.lit(True).alias("_found"), *values("_a_"))
    second = unique_dimension(dim, dim_canonical, order).select(F.col(dim_canonical).alias("_c"), F.lit(True).alias("_again"), *values("_b_"))
    out = left.join(checked_broadcast(first), solvent_key(label) == F.col("_k"), "left").join(checked_broadcast(second), left[canonical] == F.col("_c"), "left")
    found = F.col("_found").isNotNull()
    out = out.withColumns({c: F.when(found, F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")) for c in columns})
    out = out.withColumn("existing_match", F.when(found, "label").when(F.col("_again").isNotNull(), "canonical").otherwise("none"))
    return out.drop("_k", "_c", "_found", "_again", *[f"_{p}_{c}" for p in "ab" for c in columns])


def build_table(measurements: DataFrame, column: str, existing: DataFrame, label: str = "solvent", columns: tuple[str, ...] = PHYSICAL) -> DataFrame:
    """The solvent table: distinct labels with counts, computed and measured descriptors, most frequent first."""
    described = describe_solvents(solvent_counts(measurements, column))
    present = [c for c in columns if c in existing.columns]
    measured = canonicalize(existing, label, "_smiles")
    joined = direct_then_canonical(described, measured, F.col("solvent_original"), "canonical_solvent_smiles", label, "_smiles", present, [F.col(label)])
    return joined.orderBy(F.col("row_count").desc(), "solvent_original")


def train_join(df: DataFrame, dim: DataFrame, key: str, columns: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Left join by stripped name, and the names that lack any value, with their rows."""
    named = unique_dimension(dim.withColumn("_k", F.trim(key)), "_k", order).select("_k", *columns)
    out = df.join(checked_broadcast(named), F.trim(df[key]) == F.col("_k"), "left").drop("_k")
    lacks = out.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).groupBy(F.trim(key).alias(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    return out, lacks


def inference_join(df: DataFrame, dim: DataFrame, key: str, columns: list[str], medians: dict[str, float], order: list[Column]) -> DataFrame:
    """The same for new rows: values missing there take the training median, and flags say whether name and values were known."""
    named = unique_dimension(dim.withColumn("_k", F.trim(key)), "_k", order).select("_k", *columns)
    out = df.join(checked_broadcast(named), F.trim(df[key]) == F.col("_k"), "left")
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    out = out.withColumns({"solvent_known": F.col("_k").isNotNull(), "values_imputed": missing})
    return out.withColumns({c: F.coalesce(c, F.lit(medians.get(c, 0.0))) for c in columns}).drop("_k")


def write_template(spark: SparkSession, df: DataFrame, column: str, path: str, columns: tuple[str, ...] = PHYSICAL) -> None:
    """A table of all distinct solvents with empty columns, to be filled in by hand."""
    names = df.select(F.trim(column).alias("solvent")).filter("solvent IS NOT NULL AND solvent <> ''").distinct().orderBy("solvent")
    write_csv(names.select("solvent", *[F.lit(None).cast("double").alias(c) for c in columns]), path)
