"""Diagnosis of an external benchmark: summaries, training overlap, failure modes, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, threshold_score

#: Thresholds of the failure ladder.
EMISSION_ERROR, YIELD_ERROR, LABEL_MISMATCH, DISAGREEMENT, LOW_SIMILARITY = 25.0, 0.20, 25.0, 30.0, 0.65


def model_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Errors in emission and quantum yield of each model or family."""
    measures = [f(c).alias(f"{n}_{c}") for c in ("emission_abs_error", "qy_abs_error") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("molecule").alias("n_molecules"), *measures)


def molecule_summary(df: DataFrame) -> DataFrame:
    """One row a molecule: its best model, expected values and the spread of the predictions."""
    best = F.min_by("model", F.struct("emission_abs_error", "model"))
    # the first expected value that isn't missing, in the order of errors and models
    expected = F.min(F.when(F.col("expected_emission_nm").isNotNull(), F.struct("emission_abs_error", "model", "expected_emission_nm")))["expected_emission_nm"]
    return df.groupBy("molecule").agg(
        F.count(F.lit(1)).alias("n_predictions"), best.alias("best_model"), F.min("emission_abs_error").alias("best_error"),
        expected.alias("expected_emission_nm"), F.avg("predicted_emission_nm").alias("predicted_mean"), F.stddev_samp("predicted_emission_nm").alias("predicted_std"),
        F.min("predicted_emission_nm").alias("predicted_min"), F.max("predicted_emission_nm").alias("predicted_max"),
        F.avg("emission_abs_error").alias("mean_emission_error"), F.avg("qy_abs_error").alias("mean_qy_error"), F.max("nearest_similarity").alias("similarity"),
    )


def training_overlap(benchmark: DataFrame, training: DataFrame) -> DataFrame:
    """For each benchmark molecule and solvent: what training holds of it, and its labels there.

    Two grouped aggregates and two joins take the place of a scan of the training rows
    for each molecule.
    """
    stats = lambda suffix: [F.min("emission_nm").alias(f"min_{suffix}"), F.median("emission_nm").alias(f"median_{suffix}"), F.avg("emission_nm").alias(f"mean_{suffix}"), F.max("emission_nm").alias(f"max_{suffix}"), F.stddev_samp("emission_nm").alias(f"std_{suffix}")]
    t = training.filter("molecule IS NOT NULL")
    mol = t.groupBy("molecule").agg(F.count(F.lit(1)).alias("n_molecule"), *stats("molecule"))
    pair = t.filter("solvent IS NOT NULL").groupBy("molecule", "solvent").agg(F.count(F.lit(1)).alias("n_pair"), *stats("pair"))
    solvents = training.select("solvent").na.drop().distinct().withColumn("_solvent", F.lit(True))
    out = benchmark.join(mol, "molecule", "left").join(pair, ["molecule", "solvent"], "left").join(solvents, "solvent", "left")
    return out.withColumns({"molecule_seen": F.col("n_molecule").isNotNull(), "pair_seen": F.col("n_pair").isNotNull(), "solvent_seen": F.coalesce("_solvent", F.lit(False))}).drop("_solvent")


def failure_mode(df: DataFrame) -> DataFrame:
    """Add the training delta and the failure mode: the first branch that holds."""
    train = F.coalesce("median_pair", "median_molecule")
    delta = F.abs(F.col("expected_emission_nm") - train)
    yes = lambda c: F.coalesce(c, F.lit(False))
    high_e, high_q = yes(F.col("mean_emission_error") > EMISSION_ERROR), yes(F.col("mean_qy_error") > YIELD_ERROR)
    close, mismatch = yes(delta <= LABEL_MISMATCH), yes(delta > LABEL_MISMATCH)
    closer = yes(F.abs(F.col("predicted_mean") - train) < F.abs(F.col("predicted_mean") - F.col("expected_emission_nm")))
    disagree = yes(F.col("predicted_std") > DISAGREEMENT) | yes(F.col("predicted_max") - F.col("predicted_min") > 2 * DISAGREEMENT)
    mol, pair = F.col("molecule_seen"), F.col("pair_seen")
    mode = (
        F.when(~high_e & ~high_q, "reasonable_prediction")
        .when(pair & close & high_e, "model_failure_exact_pair")
        .when((pair | mol) & mismatch & closer, "benchmark_training_label_mismatch")
        .when(mol & ~pair & high_e, "solvent_or_condition_mismatch")
        .when(disagree, "high_model_disagreement")
        .when(high_q & ~high_e, "qy_condition_sensitive")
        .when(~mol & yes(F.col("similarity") < LOW_SIMILARITY), "structural_extrapolation")
        .otherwise("model_failure_exact_pair")
    )
    return df.withColumns({"training_delta": delta, "closer_to_training": closer, "failure_mode": mode})


def confidence(df: DataFrame) -> DataFrame:
    """Add the overall confidence score and its label; for the cut points it is rounded, so that sums of weights meet them exactly."""
    flag = lambda c: F.col(c).cast("double")
    sim = clip(F.coalesce("similarity", F.lit(0.0)))
    agree = threshold_score(F.col("predicted_std"), 10.0, DISAGREEMENT)
    label = threshold_score(F.coalesce("std_pair", "std_molecule"), 10.0, 60.0)
    score = 0.20 * flag("molecule_seen") + 0.15 * flag("solvent_seen") + 0.20 * flag("pair_seen") + 0.20 * sim + 0.15 * label + 0.10 * agree
    out = df.withColumns({"confidence_score": score, "_cut": F.round(score, 9), "_sim": sim, "_agree": agree})
    name = F.when(F.col("_cut") < 0.50, "low").when((F.col("_cut") >= 0.75) & (F.col("_sim") >= 0.85) & (F.col("_agree") >= 0.6), "high").otherwise("medium")
    return out.withColumn("confidence_label", name).drop("_cut", "_sim", "_agree")


#: What a molecule's diagnosis adds to its predictions.
ATTACHED = ("confidence_score", "confidence_label", "failure_mode", "training_delta", "molecule_seen", "solvent_seen", "pair_seen", "predicted_mean", "predicted_std", "similarity")


def attach_confidence(predictions: DataFrame, diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """Each prediction with the diagnosis of its molecule; predictions without one stay."""
    add = [c for c in ATTACHED if c in diagnosed.columns]
    right = diagnosed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_d_{c}") for c in add])
    same = reduce(lambda a, b: a & b, [predictions[k] == F.col(f"_k{i}") for i, k in enumerate(keys)])
    kept = [F.col(c) for c in predictions.columns if c not in add]
    return predictions.join(right, same, "left").select(*kept, *[F.col(f"_d_{c}").alias(c) for c in add])
