"""Metrics of predictions as aggregate expressions, so one shuffle of partial sums serves them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import checked_broadcast
from .ordering import cut, running_sum_by, same_keys


def regression(y: Column, p: Column) -> dict[str, Column]:
    """MAE, RMSE and R2; R2 of a single row, or of constant values, is null."""
    err = y - p
    spread = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "r2": F.when((F.count(y) > 1) & (spread > 0), 1 - F.sum(err * err) / spread),
    }


def regression_ev(y: Column, p: Column) -> dict[str, Column]:
    """Errors in eV, only if every prediction is finite and positive."""
    ok = F.bool_and((p > 0) & (p < float("inf")) & (y > 0))
    err = F.when((p > 0) & (y > 0), 1240.0 / y - 1240.0 / p)
    return {"mae_ev": F.when(ok, F.avg(F.abs(err))), "rmse_ev": F.when(ok, F.sqrt(F.avg(err * err)))}


def line_fit(y: Column, p: Column) -> dict[str, Column]:
    """Pearson r and least-squares line of predictions over actual values; null for constant input."""
    varies = (F.var_pop(y) > 0) & (F.var_pop(p) > 0)
    return {"pearson_r": F.when(varies, F.corr(y, p)), "slope": F.when(F.var_pop(y) > 0, F.regr_slope(p, y)), "intercept": F.when(F.var_pop(y) > 0, F.regr_intercept(p, y))}


def confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    """Counts of a binary classification."""
    return {"tp": F.count_if(actual & predicted), "fp": F.count_if(~actual & predicted), "fn": F.count_if(actual & ~predicted), "tn": F.count_if(~actual & ~predicted)}


def classification(df: DataFrame) -> DataFrame:
    """Add rates to confusion counts; division by zero gives 0."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumns({"accuracy": rate(tp + tn, tp + tn + fp + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": rate(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2})


def centred_ranks(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks within each key, ties averaged, less their mean: one row for each key and value of counts ``_n``."""
    single = counts.groupBy(*keys, value).agg(F.sum("_n").alias("_m"))
    ranked = running_sum_by(single, keys, [F.col(value)], F.col("_m"), "_before", "_all")
    return ranked.select(*keys, value, (F.col("_before") + (F.col("_m") - F.col("_all")) / 2).alias(out))


def spearman(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Rank correlation in each group; undefined is 0.

    Rows are counted by pair of values; ranks come from running sums over the values' counts.
    """
    counts = cut(df.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("_n")))
    joined = counts
    for value, out in ((y, "_ry"), (p, "_rp")):
        ranks, same = same_keys(joined, centred_ranks(counts, keys, value, out), [*keys, value], f"{out}_")
        joined = joined.join(checked_broadcast(cut(ranks)), same).drop(*[f"{out}_{k}" for k in (*keys, value)])
    n, ry, rp = F.col("_n"), F.col("_ry"), F.col("_rp")
    sums = joined.groupBy(*keys).agg(F.sum(n * ry * rp).alias("_yp"), F.sum(n * ry * ry).alias("_yy"), F.sum(n * rp * rp).alias("_pp"))
    return sums.select(*keys, F.coalesce(F.try_divide("_yp", F.sqrt(F.col("_yy")) * F.sqrt(F.col("_pp"))), F.lit(0.0)).alias("spearman"))


def roc_auc(df: DataFrame, keys: list[str], actual: Column, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, from counts by score; null with one class only."""
    counts = df.groupBy(*keys, score).agg(F.count_if(actual).alias("_p"), F.count_if(~actual).alias("_n"))
    counts = running_sum_by(counts, keys, [F.col(score)], F.col("_n"), "_below")
    wins = counts.withColumn("_w", F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return wins.groupBy(*keys).agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum("_n")).alias("roc_auc"))


#: The largest prime under 2**31: products of two residues fit into a long.
PRIME = 2_147_483_647
#: Counts up to this are drawn from their own Poisson distribution, larger ones from a rounded normal one.
SMALL_COUNT = 8
#: Values are told apart at so many digits after the point when rows are numbered.
SCALE = 1_000_000


def poisson_steps(mean: int) -> list[float]:
    """P(X <= k) for k = 0, 1, ... while it is under 1 - 1e-9: a uniform number's draw is how many of these it reaches."""
    steps, term, total, k = [], math.exp(-mean), 0.0, 0
    while total + term < 1 - 1e-9:
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    return steps


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read and don't repeat (the optimizer would merge plain projections)."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_uniforms(df: DataFrame, y: Column, p: Column, round_no: Column, salts: dict[str, int]) -> DataFrame:
    """Add numbers between 0 and 1 that only the row's values, the round and the salts decide."""
    first = {n: (F.pmod(y, F.lit(PRIME)) * 48_271 + F.pmod(p, F.lit(PRIME)) * 69_621 + round_no * 40_692 + salt) % PRIME for n, salt in salts.items()}
    out = computed(df, **first)
    out = computed(out, **{n: ((F.col(n) * F.col(n) + 16_807) % PRIME * 630_360_016 + 12_345) % PRIME for n in salts})
    return computed(out, **{n: ((F.col(n) * F.col(n) + salt) % PRIME + 0.5) / PRIME for n, salt in salts.items()})


def with_weights(each: DataFrame, seed: int) -> DataFrame:
    """Add ``_w``, what ``_c`` equal rows of values ``_y`` and ``_p`` count in a ``_round``; a round below 0 is the sample itself.

    A count has one Poisson weight of its sum's distribution (normal and rounded where it is
    large). A weight is a function of the row's values, the round and the seed: neither
    partitions nor batches change it.
    """
    c, r = F.col("_c"), F.col("_round")
    whole = lambda x: F.round(F.col(x) * SCALE, 0).cast("long")
    each = with_uniforms(each, whole("_y"), whole("_p"), r, {"_u1": 7_919 * seed + 101, "_u2": 7_919 * seed + 202})
    u1, u2 = F.col("_u1"), F.col("_u2")
    normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    weight = F.greatest(F.lit(0.0), F.floor(c + F.sqrt(c.cast("double")) * normal + 0.5).cast("double"))
    for n in range(1, SMALL_COUNT + 1):
        weight = F.when(c == n, sum(((u1 >= t).cast("double") for t in poisson_steps(n)), F.lit(0.0))).otherwise(weight)
    return computed(each, _w=F.when(r < 0, c.cast("double")).otherwise(weight)).filter("_w > 0")


def _distinct_pairs(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")).na.drop(subset=["_y", "_p"])
    return rows.groupBy(*keys, "_y", "_p").agg(F.count(F.lit(1)).alias("_c"))


def _in_rounds(rows: DataFrame, first: int, rounds: int) -> DataFrame:
    return rows.withColumn("_round", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(rounds - 1).cast("long"))))


def bootstrap(df: DataFrame, keys: list[str], y: str, p: str, rounds: int = 500, seed: int = 0) -> DataFrame:
    """95 % intervals of MAE, RMSE and R2 by resampling rows.

    Each row counts in each round by a Poisson weight. Equal rows are counted first, so
    rounds are sums that partitions add up.
    """
    each = with_weights(_in_rounds(_distinct_pairs(df, keys, y, p), 0, rounds), seed)
    w, yy, e = F.col("_w"), F.col("_y"), F.col("_y") - F.col("_p")
    sums = each.groupBy(*keys, "_round").agg(F.sum(w).alias("n"), F.sum(w * yy).alias("sy"), F.sum(w * yy * yy).alias("syy"), F.sum(w * F.abs(e)).alias("sa"), F.sum(w * e * e).alias("se"))
    n, spread = F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    one = sums.select(*keys, (F.col("sa") / n).alias("mae"), F.sqrt(F.col("se") / n).alias("rmse"), F.when(spread > 0, 1 - F.col("se") / spread).alias("r2"))
    # as many values a key as there are rounds
    bounds = [F.percentile(m, F.lit(q)).alias(f"{m}_{name}") for m in ("mae", "rmse", "r2") for q, name in ((0.025, "low"), (0.975, "high"))]
    return one.groupBy(*keys).agg(*bounds)


#: Parts that sorted errors are cut into, for the medians of all rounds: a quarter of the square root of the rows, within these.
LEAST_PARTS, MOST_PARTS = 16, 1_000
#: Product of energy in eV and wavelength in nm.
EV_NM = 1240.0


def bootstrap_metrics(df: DataFrame, keys: list[str], y: str, p: str, rounds: int = 500, seed: int = 0, wavelength: bool = True) -> DataFrame:
    """One row for each key and metric: ``estimate`` on the sample, ``ci_lower`` and ``ci_upper`` of 95 %, and ``usable`` rounds.

    Metrics are MAE, median absolute error, RMSE, R2, and for wavelengths MAE and RMSE in
    eV, which need positive, finite values in all rows of a round. Medians are weighted
    quantiles of 500 rounds at once: errors are cut into parts, rounds' weights are summed
    by part together with the other sums, prefix sums over the parts tell in which part a
    round's median lies, and only that part's rows are weighed again for that round. Where
    the parts are cut doesn't matter to the result. Rows with a null value are left out; a
    metric that no round gives has null bounds and 0 usable rounds.
    """
    yy, pp, w, r = F.col("_y"), F.col("_p"), F.col("_w"), F.col("_round")
    same = cut(_distinct_pairs(df, keys, y, p).withColumn("_e", F.abs(yy - pp)))
    parts = min(MOST_PARTS, max(LEAST_PARTS, math.isqrt(same.count()) // 4))
    edges = same.groupBy(*keys).agg(F.percentile_approx("_e", [k / parts for k in range(1, parts)], 20 * parts).alias("_edges"))
    edges, match = same_keys(same, edges, keys)
    same = same.join(checked_broadcast(cut(edges)), match) if keys else same.join(F.broadcast(edges), how="cross")  # without keys one row
    same = cut(same.withColumn("_part", F.size(F.filter("_edges", lambda x: x < F.col("_e")))).select(*keys, "_y", "_p", "_c", "_e", "_part"))

    good = (yy > 0) & (pp > 0) & (pp < float("inf")) & (yy < float("inf"))
    ev = F.when(good, EV_NM / yy - EV_NM / pp)
    each = with_weights(_in_rounds(same, -1, rounds), seed)
    add = lambda c, name: F.sum(w * c).alias(name)
    sums = cut(each.groupBy(*keys, "_round", "_part").agg(F.sum(w).alias("n"), add(yy, "sy"), add(yy * yy, "syy"), add(F.col("_e"), "sa"), add(F.col("_e") * F.col("_e"), "se"), add(F.abs(ev), "sv"), add(ev * ev, "svv"), F.sum(F.when(~good, w)).alias("bad")))
    whole = sums.groupBy(*keys, "_round").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "sa", "se", "sv", "svv", "bad")])
    n, spread = F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    in_ev = lambda c: F.when(F.col("bad").isNull(), c) if wavelength else F.lit(None).cast("double")
    values = {"mae": F.col("sa") / n, "rmse": F.sqrt(F.col("se") / n), "r2": F.when((n > 1) & (spread > 0), 1 - F.col("se") / spread), "mae_ev": in_ev(F.col("sv") / n), "rmse_ev": in_ev(F.sqrt(F.col("svv") / n))}

    by_round = Window.partitionBy(*keys, "_round")
    at = sums.select(*keys, "_round", "_part", "n", F.sum("n").over(by_round).alias("_all"), F.coalesce(F.sum("n").over(by_round.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    middle = [F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)]
    at = at.select("*", F.posexplode(F.array(*middle)).alias("_which", "_place")).filter("_before <= _place AND _place < _before + n")
    at, match = same_keys(same, at.select(*keys, "_part", "_round", "_which", (F.col("_place") - F.col("_before")).alias("_place")), [*keys, "_part"])
    near = with_weights(same.join(at, match).drop(*[f"_k_{k}" for k in (*keys, "_part")]), seed)
    upto = F.sum(w).over(Window.partitionBy(*keys, "_round", "_which").orderBy("_e", "_y", "_p").rowsBetween(Window.unboundedPreceding, 0))
    medians = near.withColumn("_upto", upto).filter((F.col("_upto") - w <= F.col("_place")) & (F.col("_place") < F.col("_upto"))).groupBy(*keys, "_round").agg(F.avg("_e").alias("_value"))

    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    listed = whole.select(*keys, "_round", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), finite(v).alias("_value")) for m, v in values.items()])))
    listed = listed.unionByName(medians.select(*keys, "_round", F.lit("median_absolute_error").alias("metric"), finite(F.col("_value")).alias("_value")))
    drawn = F.when(r >= 0, F.col("_value"))
    return listed.groupBy(*keys, "metric").agg(F.max(F.when(r < 0, F.col("_value"))).alias("estimate"), F.percentile(drawn, F.lit(0.025)).alias("ci_lower"), F.percentile(drawn, F.lit(0.975)).alias("ci_upper"), F.count(drawn).alias("usable"))
