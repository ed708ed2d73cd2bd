"""Source tables of three vocabularies brought into one schema, combined and prepared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import log10_positive, safe_double, significant
from ..sources.readers import resolve_column
from . import chemistry, dedup

#: The standard schema, the provenance columns, and each source's names.
TARGETS = ("absorption_nm", "emission_nm", "lifetime_ns", "quantum_yield", "log_extinction")
STANDARD = ("chromophore_smiles", "solvent_original", "canonical_chromophore_smiles", "canonical_solvent_smiles", *TARGETS, "source_dataset")
PROVENANCE = ("provenance_source", "provenance_tag", "provenance_tag_name", "provenance_solvent_num", "provenance_split", "reference_doi")
LITERATURE = {
    "chromophore_smiles": ["Chromophore"], "solvent_original": ["Solvent"], "absorption_nm": ["Absorption max (nm)"], "emission_nm": ["Emission max (nm)"],
    "lifetime_ns": ["Lifetime (ns)"], "quantum_yield": ["Quantum yield"], "log_extinction": ["log(e/mol-1 dm3 cm-1)"],
}
HANDBOOK = {
    "chromophore_smiles": ["SMILES", "smiles", "chromophore_smiles", "Chromophore"], "solvent_original": ["solvent", "Solvent", "solvent_original"],
    "absorption_nm": ["Absorption/nm", "absorption_nm", "Absorption max (nm)"], "emission_nm": ["Emission/nm", "emission_nm", "Emission max (nm)"],
    "quantum_yield": ["PLQY", "Quantum yield", "quantum_yield"],
}
AGGREGATE = {
    "chromophore_smiles": ["smiles"], "solvent_original": ["solvent"], "absorption_nm": ["absorption/nm"], "emission_nm": ["emission/nm"], "quantum_yield": ["plqy"], "extinction": ["e/m-1cm-1"],
    "reference_doi": ["reference(doi)"], "provenance_source": ["source"], "provenance_tag": ["tag"], "provenance_tag_name": ["tag_name"], "provenance_solvent_num": ["solvent_num"], "provenance_split": ["split"],
}
#: Keywords by which a column is found when no listed name is there.
KEYWORDS = {"chromophore_smiles": ("smiles", "chromophore"), "solvent_original": ("solvent",), "absorption_nm": ("absorption",), "emission_nm": ("emission",), "quantum_yield": ("plqy", "quantum")}

SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in TARGETS else T.StringType()) for c in (*STANDARD, *PROVENANCE)])


def project(raw: DataFrame, names: dict[str, list[str]], infer: bool = False) -> DataFrame:
    """The columns that a vocabulary names; the molecule is required, others may be absent."""
    found = {out: resolve_column(raw.columns, options, keyword=KEYWORDS.get(out, ()) if infer else (), required=out == "chromophore_smiles") for out, options in names.items()}
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(out) for out, c in found.items()])


def standardize(raw: DataFrame, names: dict[str, list[str]], source: str, infer: bool = False) -> DataFrame:
    """Numbers coerced, molecules made canonical once a distinct text, invalid molecules and rows without any target dropped."""
    df = project(raw, names, infer)
    if "extinction" in df.columns:
        df = df.withColumn("log_extinction", log10_positive(safe_double(F.col("extinction"))))
    df = df.withColumns({c: safe_double(F.col(c)) if c in df.columns and c != "log_extinction" else F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in TARGETS})
    if "log_extinction" in names:
        df = df.withColumn("log_extinction", safe_double(F.col("log_extinction").cast("string")))
    df = chemistry.canonicalize(df, "chromophore_smiles", "canonical_chromophore_smiles")
    df = chemistry.canonicalize(df, "solvent_original", "canonical_solvent_smiles").withColumn("source_dataset", F.lit(source))
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields]
    return df.select(*columns).na.drop(subset=["canonical_chromophore_smiles"]).na.drop(how="all", subset=list(TARGETS))


def measurement_key(df: DataFrame) -> DataFrame:
    """Add the key of equal measurements: both molecules and four targets to six digits; lifetime is left out by definition."""
    parts = [F.coalesce(F.col(c), F.lit("<NA>")) for c in ("canonical_chromophore_smiles", "canonical_solvent_smiles")]
    parts += [F.coalesce(significant(F.col(c)).cast("string"), F.lit("<NA>")) for c in ("absorption_nm", "emission_nm", "quantum_yield", "log_extinction")]
    return df.withColumn("measurement_key", F.concat_ws("|", *parts))


def prepare(frames: list[DataFrame]) -> dict[str, DataFrame]:
    """Combined and deduplicated tables, and what the reports need of them."""
    union = dedup.union_sources(frames, [f.name for f in SCHEMA.fields], list(TARGETS), ["canonical_chromophore_smiles"])
    combined = measurement_key(union).cache()  # five consumers read it
    kept = dedup.keep_source_preferred(combined, ["measurement_key"], [F.col(c) for c in ("chromophore_smiles", "solvent_original", "lifetime_ns", "provenance_tag", "reference_doi")])
    thresholds = [550, 580, 600, 650, 700, 750]
    return {
        "combined": combined,
        "deduplicated": kept,
        "overlap": dedup.overlap_by_sources(combined, ["measurement_key"]),
        "replicates": dedup.replicates(kept, ["canonical_chromophore_smiles", "canonical_solvent_smiles"], F.col("measurement_key"), ["emission_nm", "quantum_yield"]),
        "coverage_before": dedup.coverage_rollup(combined, "emission_nm", thresholds),
        "coverage_after": dedup.coverage_rollup(kept, "emission_nm", thresholds),
    }
