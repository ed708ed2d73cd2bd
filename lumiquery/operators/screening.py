"""Candidate screening: scores, domain flags and ranks for each target wavelength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.scalars import brightness, candidate_score, out_of_domain

#: Fixed value: similarity under which a screened candidate is out of domain.
SCREEN_THRESHOLD = 0.30


def score_candidates(df: DataFrame, target: float) -> DataFrame:
    """Add score, brightness and domain flag; needs predicted_emission_nm, predicted_qy, log_extinction, similarity."""
    return df.withColumns({
        "score": candidate_score(F.col("predicted_emission_nm"), target, F.col("predicted_qy")),
        "brightness": brightness(F.col("predicted_qy"), F.col("log_extinction")),
        "outside_domain": out_of_domain(F.col("similarity"), SCREEN_THRESHOLD),
    })


def rank_per_target(df: DataFrame, targets: list[float], n: int, id_col: str) -> DataFrame:
    """The n best candidates of each target, ranked from 1; the group limit runs below the shuffle."""
    each = df.withColumn("target_nm", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    scored = score_candidates(each, F.col("target_nm"))
    order = Window.partitionBy("target_nm").orderBy(F.col("score").desc_nulls_last(), F.col(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.withColumn("target_note", bins.target_note(F.col("target_nm")))


def dominance(ranked: DataFrame, category: str) -> DataFrame:
    """Most frequent category of each target, and whether it holds at least half of the ranks."""
    counts = ranked.groupBy("target_nm", category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").alias("total")
    best = counts.groupBy("target_nm").agg(F.min_by(F.struct(category, "n"), F.struct(-F.col("n"), category)).alias("b"), total)
    return best.select("target_nm", F.col(f"b.{category}").alias(category), F.col("b.n").alias("n"), (2 * F.col("b.n") >= F.col("total")).alias("dominant"))
