"""Feature matrices: fingerprint bits, descriptors and one-hot columns, fitted on training rows and aligned at inference."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import descriptors, smiles
from ..functions.scalars import finite, safe_double
from .chemistry import bits_udf, on_distinct, text_udf
from .splits import train_medians

#: Columns that name things and are never features.
IDENTITY = ("solvent", "solvent_original", "solvent_smiles", "canonical_solvent_smiles", "canonical_chromophore_smiles", "chromophore_smiles", "source_dataset", "label", "solvent_key")
#: More categories than this are no one-hot columns.
MAX_CATEGORIES = 1_000


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = IDENTITY) -> list[str]:
    """Columns that hold numbers and nothing else, at least one, in their order: one aggregate over all of them."""
    names = [c for c in df.columns if c not in exclude]
    one = df.agg(*[f(x).alias(f"{n}{k}") for k, c in enumerate(names) for n, f, x in (("v", F.count, safe_double(F.col(f"`{c}`").cast("string"))), ("a", F.count, F.col(f"`{c}`")))]).first()
    return [c for k, c in enumerate(names) if one[f"v{k}"] and one[f"v{k}"] == one[f"a{k}"]]


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a category in order."""
    found = sorted(r[0] for r in df.select(F.trim(F.col(column).cast("string")).alias("v")).filter("v IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect())
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return found


def one_hot_columns(column: str, known: list[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each value seen in training; an unseen value is 0 in all of them."""
    value = F.trim(F.col(column).cast("string"))
    return {f"{prefix}_{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in known}


@dataclass
class FeatureSpec:
    """What inference needs of training: bits, descriptor columns with their medians, and vocabularies."""

    n_bits: int = 2048
    radius: int = 2
    descriptor_columns: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Column names of the matrix, in order."""
        hot = [f"{c}_{v}" for c, known in self.vocabularies.items() for v in known]
        return [*(f"bit_{k}" for k in range(self.n_bits)), *self.descriptor_columns, *hot]

    def to_json(self) -> str:
        """As a document with sorted keys."""
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FeatureSpec:
        """Back from the document."""
        return cls(**json.loads(text))


def fit(train: DataFrame, descriptor_columns: list[str], categories: list[str] = (), n_bits: int = 2048, radius: int = 2) -> FeatureSpec:  # type: ignore[assignment]
    """Medians and vocabularies of the training rows."""
    clean = train.withColumns({c: finite(F.col(c).cast("double")) for c in descriptor_columns}) if descriptor_columns else train
    row = train_medians(clean.withColumn("split", F.lit("train")), descriptor_columns).first() if descriptor_columns else {}
    return FeatureSpec(n_bits, radius, list(descriptor_columns), {c: row[c] if row[c] is not None else 0.0 for c in descriptor_columns}, {c: vocabulary(train, c) for c in categories})


def align(df: DataFrame, columns: list[str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """Exactly the columns of training (absent ones null), and how many were added and dropped."""
    added = [c for c in columns if c not in df.columns]
    dropped = [c for c in df.columns if c not in columns and c not in extra]
    return df.select(*extra, *[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns]), len(added), len(dropped)


def values(spec: FeatureSpec) -> dict[str, Column]:
    """Imputed descriptors and one-hot columns by name."""
    out = {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(float(spec.medians.get(c) or 0.0))) for c in spec.descriptor_columns}
    for c, known in spec.vocabularies.items():
        out |= one_hot_columns(c, known, c)
    return out


def matrix(df: DataFrame, spec: FeatureSpec, molecule: str | None = None, out: str = "features") -> DataFrame:
    """Add the feature vector: bits of the molecule, then descriptors, then one-hot columns, in the order of training.

    Rows whose molecule can't be read are dropped. Absent descriptor columns take the medians.
    """
    df = df.withColumns({c: F.lit(None).cast("double") for c in spec.descriptor_columns if c not in df.columns}) if spec.descriptor_columns else df
    parts = [F.array(*[c.cast("double") for c in cols]) for cols in [list(values(spec).values())] if cols]
    if molecule and spec.n_bits:
        bits = text_udf(lambda s: smiles.morgan_bits(s, spec.radius, spec.n_bits), "array<int>")
        df = on_distinct(df, molecule, bits, "_bits").filter("_bits IS NOT NULL")
        parts.insert(0, F.transform(F.sequence(F.lit(0), F.lit(spec.n_bits - 1)), lambda k: F.array_contains("_bits", k).cast("double")))
    return df.withColumn(out, array_to_vector(F.concat(*parts))).drop("_bits")


def infer_spec(n_features: int, dimension: DataFrame | None) -> FeatureSpec:
    """A specification for a model that has none: descriptor columns of the dimension table, bits from the model's width."""
    columns = numeric_columns(dimension) if dimension is not None else []
    if len(columns) > n_features:
        columns = []
    return FeatureSpec(n_features - len(columns), 2, columns, fit(dimension, columns).medians if columns else {})


def describe_molecules(df: DataFrame, column: str) -> DataFrame:
    """Add the sixteen molecular descriptors, computed once a distinct molecule."""
    udf = text_udf(descriptors.molecule_descriptors, "map<string,double>")
    out = on_distinct(df, column, udf, "_d")
    return out.withColumns({c: F.element_at("_d", F.lit(c)) for c in descriptors.MOLECULE}).drop("_d")


def fingerprint_bits(df: DataFrame, column: str) -> DataFrame:
    """Add the on-bits of the circular fingerprint."""
    return on_distinct(df, column, bits_udf(), "bits")
