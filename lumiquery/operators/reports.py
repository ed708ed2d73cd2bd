"""Report tables and the data behind charts: what papers and dashboards show of the other operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..sources.writers import report

#: What a split measures.
SPLIT_NOTES = {
    "random": "Rows are split at random, so molecules may be on both sides: interpolation.",
    "molecule": "Molecules are held out whole: transfer to new molecules.",
    "scaffold": "Scaffolds are held out whole: the strongest test of extrapolation.",
}


def audit_value(audit: DataFrame, section: str, metric: str) -> Column:
    """Aggregate: the value of one figure of a long audit table."""
    return F.max(F.when((F.col("section") == section) & (F.col("metric") == metric), F.col("value")))


def dataset_scale(audit: DataFrame, figures: dict[str, tuple[str, str]], workflow: str) -> DataFrame:
    """One row with figures of an audit table under their own names, ``not available`` where there is none."""
    cells = [F.coalesce(audit_value(audit, *at), F.lit("not available")).alias(name) for name, at in figures.items()]
    sources = F.array_join(F.array_sort(F.collect_set("source_dataset")), ", ").alias("dataset_sources")
    return audit.agg(F.lit(workflow).alias("workflow"), sources, *cells)


def mean_over_seeds(runs: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Means over seeds of each split and model of a target; rows without split or model are left out."""
    return runs.filter(F.col("target") == target).na.drop(subset=["split", "model"]).groupBy("split", "model").agg(*[F.avg(c).alias(c) for c in columns])


def emission_table(runs: DataFrame) -> DataFrame:
    """Errors of the emission models by split, with what the split measures."""
    note = F.element_at(F.create_map(*[F.lit(x) for kv in SPLIT_NOTES.items() for x in kv]), F.col("split"))
    return mean_over_seeds(runs, "emission_nm", ["mae", "rmse", "r2"]).withColumn("comment", F.coalesce(note, F.lit("")))


def yield_table(runs: DataFrame, classifiers: DataFrame) -> DataFrame:
    """Errors of the yield models with the mean accuracy and F1 of the classifier of the same split and model."""
    means = classifiers.na.drop(subset=["split", "model"]).groupBy("split", "model").agg(F.avg("accuracy").alias("bright_accuracy"), F.avg("f1").alias("bright_f1"))
    return mean_over_seeds(runs, "quantum_yield", ["mae", "rmse", "r2"]).join(means, ["split", "model"], "left")


def graph_table(runs: DataFrame) -> DataFrame:
    """One row a graph model, from rows a seed (``mae``) or rows already summarized (``mae_mean``, ``mae_std``, ``mae_min``, ``seeds``)."""
    e, q = F.col("target") == "emission_nm", F.col("target") == "quantum_yield"
    if "mae" in runs.columns:
        v = F.col("mae")
        return runs.groupBy("model").agg(F.countDistinct(F.when(e, F.col("seed"))).alias("seeds"), F.avg(F.when(e, v)).alias("emission_mae_mean"), F.stddev_samp(F.when(e, v)).alias("emission_mae_std"), F.min(F.when(e, v)).alias("best_seed_mae"), F.avg(F.when(q, v)).alias("yield_mae"))
    if "mae_mean" not in runs.columns:
        raise ValueError("neither mae nor mae_mean is among the columns")
    one = lambda c, test: F.max(F.when(test, F.col(c)))
    return runs.groupBy("model").agg(F.coalesce(one("seeds", e), F.lit(0)).cast("long").alias("seeds"), one("mae_mean", e).alias("emission_mae_mean"), one("mae_std", e).alias("emission_mae_std"), one("mae_min", e).alias("best_seed_mae"), one("mae_mean", q).alias("yield_mae"))


def claims(runs: DataFrame) -> list[str]:
    """Sentences that the figures bear out: the best model of each target and split, and whether extrapolation is harder."""
    best = runs.groupBy("target", "split", "model").agg(F.avg("mae").alias("mae")).groupBy("target", "split").agg(F.min(F.struct("mae", "model")).alias("b"))
    found = {(r["target"], r["split"]): (r["b"]["mae"], r["b"]["model"]) for r in best.filter("b.mae IS NOT NULL").collect()}  # one row a target and split
    out = [f"For {t} on the {s} split, {m} has the smallest mean error, {e:.4g}." for (t, s), (e, m) in sorted(found.items())]
    for t in sorted({t for t, _ in found}):
        if (t, "random") in found and (t, "scaffold") in found:
            harder = found[t, "scaffold"][0] > found[t, "random"][0]
            out.append(f"For {t}, held-out scaffolds are {'harder' if harder else 'not harder'} than random rows.")
    return out


def paper(runs: DataFrame, classifiers: DataFrame, audit: DataFrame | None = None, graph: DataFrame | None = None) -> str:
    """All tables and the claims as one Markdown report."""
    sections: list[tuple[str, str | DataFrame]] = []
    if audit is not None:
        sections.append(("Dataset", audit))
    sections += [("Emission models", emission_table(runs).orderBy("split", "mae", "model")), ("Quantum yield models", yield_table(runs, classifiers).orderBy("split", "mae", "model"))]
    if graph is not None:
        sections.append(("Graph models", graph_table(graph).orderBy("model")))
    return report("Results", [*sections, ("Findings", "\n".join(f"* {c}" for c in claims(runs)) or "None.")])


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Chart data: rows in bins of a width."""
    low = F.floor(F.col(value) / width) * width
    return df.filter(F.col(value).isNotNull()).groupBy(low.cast("double").alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Chart data: mean of a value for each pair of categories."""
    return df.groupBy(x, y).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def scatter_density(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Chart data of any number of points: their counts on a grid."""
    cell = lambda c: (F.floor(F.col(c) / step) * step).cast("double").alias(c)
    return df.na.drop(subset=[x, y]).groupBy(cell(x), cell(y)).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Chart data: counts of actual and predicted classes."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def region_bars(df: DataFrame, binner: bins.Binner = bins.MANUSCRIPT) -> DataFrame:
    """Chart data: mean error by region, in the order of the regions."""
    out = df.groupBy(binner.label(F.col("y_true")).alias("region")).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("place", binner.rank(F.col("region")))


def metric_rows(documents: DataFrame, column: str) -> DataFrame:
    """A metrics document (split, task, metric to number) as rows; what is no number is left out."""
    parsed = documents.select(F.from_json(column, "map<string,map<string,map<string,string>>>").alias("_m"))
    splits = parsed.select(F.explode("_m").alias("split", "_t")).filter("split <> 'dataset'")
    tasks = splits.select("split", F.explode("_t").alias("task", "_v"))
    cells = tasks.select("split", "task", F.explode("_v").alias("metric", "_x"))
    return cells.select("split", "task", "metric", F.col("_x").try_cast("double").alias("value")).filter("value IS NOT NULL")


def flatten_prediction(documents: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """A prediction document as one row: predictions, domain, known values and errors in prefixed columns."""
    number = "map<string,double>"
    error = "map<string,struct<absolute_error:double,residual:double>>"
    schema = f"molecule string, solvent string, predictions {number}, applicability_domain struct<similarity:double,outside:boolean>, known_values {number}, errors {error}, exact_reference_matches struct<count:long>"
    d = documents.select(F.from_json(column, schema).alias("d")).select("d.*")
    cells = [F.element_at("predictions", F.lit(t)).alias(t) for t in targets]
    cells += [F.element_at("known_values", F.lit(t)).alias(f"known_{t}") for t in targets]
    cells += [F.element_at("errors", F.lit(t))[f].alias(f"{p}_{t}") for t in targets for p, f in (("error", "absolute_error"), ("residual", "residual"))]
    return d.select("molecule", "solvent", *cells, F.col("applicability_domain.similarity").alias("similarity"), F.col("applicability_domain.outside").alias("outside_domain"), F.col("exact_reference_matches.count").alias("exact_reference_match_count"))
