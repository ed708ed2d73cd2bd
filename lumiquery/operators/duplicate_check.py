"""Duplicate-check job: is a submitted molecule and solvent already in a dataset?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import smiles
from ..functions.scalars import tanimoto
from .chemistry import bits_udf, on_distinct

MAX_MATCHES = 5
#: Values that a match shows; absorption and lifetime stay private.
PAYLOAD = ("emission_nm", "quantum_yield", "source_doi")


class JobError(ValueError):
    """A stable code beside the message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def check(job: dict, dataset: DataFrame | None, max_matches: int = MAX_MATCHES) -> dict:
    """Exact matches of the pair and the nearest molecules; ties go to the smallest record id."""
    if not isinstance(job, dict) or any(not isinstance(job.get(k), str) or not job[k].strip() for k in ("molecule_smiles", "solvent_smiles")):
        raise JobError("INVALID_INPUT", "molecule_smiles and solvent_smiles are required")
    molecule, solvent = smiles.canonical(job["molecule_smiles"]), smiles.canonical(job["solvent_smiles"])
    if not molecule or not solvent:
        raise JobError("INVALID_SMILES", "a molecule can't be read")
    if dataset is None:
        raise JobError("DATASET_NOT_CONFIGURED", "no dataset is configured")
    missing = {"record_id", "molecule_smiles", "solvent_smiles"} - set(dataset.columns)
    if missing:
        raise JobError("INVALID_DATASET", f"missing columns: {', '.join(sorted(missing))}")
    from .chemistry import canonicalize

    df = canonicalize(dataset, "molecule_smiles", "_m")
    df = canonicalize(df, "solvent_smiles", "_s")
    payload = [c for c in PAYLOAD if c in dataset.columns]
    exact = df.filter((F.col("_m") == molecule) & (F.col("_s") == solvent))
    hits = exact.select("record_id", *payload).orderBy("record_id").limit(max_matches).collect()
    bits = F.array(*[F.lit(b) for b in smiles.morgan_bits(molecule)])
    near = on_distinct(df.filter("_m IS NOT NULL"), "_m", bits_udf(), "_bits").withColumn("similarity", tanimoto(F.col("_bits"), bits))
    rows = near.orderBy(F.col("similarity").desc(), "record_id").select("record_id", "molecule_smiles", F.round("similarity", 6).alias("similarity")).limit(max_matches).collect()
    return {"status": "completed", "is_duplicate": bool(hits), "exact_matches": [r.asDict() for r in hits], "nearest": [r.asDict() for r in rows]}


def run(job: dict, dataset: DataFrame | None, max_matches: int = MAX_MATCHES) -> dict:
    """The response document: completed, or failed with a stable code."""
    try:
        return {"job_id": job.get("job_id") if isinstance(job, dict) else None} | check(job, dataset, max_matches)
    except JobError as e:
        return {"job_id": job.get("job_id") if isinstance(job, dict) else None, "status": "failed", "error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # the job fails, the worker goes on
        return {"job_id": job.get("job_id") if isinstance(job, dict) else None, "status": "failed", "error": {"code": "DUPLICATE_CHECK_FAILED", "message": str(e)[:300]}}
