"""Models of MLlib on leakage-safe splits, ensembles, searches, stacking and feature importance.

What MLlib lacks is in ``learners``: extra trees, support vector regression and a
multilayer perceptron, trained on a bounded sample of rows.
"""

from __future__ import annotations

import importlib.util
import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import fit_mlp  # noqa: F401  offered here too
from .metrics import regression
from .splits import group_split, hash_unit

#: Regressors by name. Tree counts and depths are the caller's choice: the reference's are sized for one machine.
REGRESSORS: dict[str, Callable[..., object]] = {
    "rf": lambda **k: RandomForestRegressor(minInstancesPerNode=2, **k),
    "histgb": lambda **k: GBTRegressor(stepSize=0.05, maxBins=128, **k),
    "gbdt": lambda **k: GBTRegressor(stepSize=0.05, maxDepth=3, **k),
    "linear": lambda **k: LinearRegression(**k),
}
CLASSIFIERS: dict[str, Callable[..., object]] = {"rf": lambda **k: RandomForestClassifier(minInstancesPerNode=2, **k), "gbdt": lambda **k: GBTClassifier(**k)}
MIN_ROWS, MIN_GROUPS = 100, 2


def build(features: list[str], label: str, model: str = "rf", categories: tuple[str, ...] = (), kinds: dict = REGRESSORS, **options) -> Pipeline:  # noqa: ANN003
    """One-hot categories by the training vocabulary (an unseen one is zero in all columns), assembly and model as one pipeline."""
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categories]
    if categories:
        stages.append(OneHotEncoder(inputCols=[f"_{c}" for c in categories], outputCols=[f"_hot_{c}" for c in categories], dropLast=True, handleInvalid="keep"))
    inputs = [*features, *[f"_hot_{c}" for c in categories]]
    est = kinds[model](featuresCol="_features", labelCol=label, **options)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="skip"), est])


def train_target(df: DataFrame, features: list[str], target: str, group: str, model: str = "rf", categories: tuple[str, ...] = (), **options) -> tuple[PipelineModel, DataFrame] | None:  # noqa: ANN003
    """Fit on the training groups and predict both sides; None with too few rows or groups."""
    rows = df.filter(F.col(target).isNotNull())
    n, g = rows.agg(F.count(F.lit(1)), F.countDistinct(group)).first()
    if n < MIN_ROWS or g < MIN_GROUPS:
        return None
    split = group_split(rows, group)
    fitted = build(features, target, model, categories, **options).fit(split.filter("split = 'train'"))
    out = fitted.transform(split).withColumn("residual", F.col(target) - F.col("prediction"))
    return fitted, out


def forest_metrics(pred: DataFrame) -> DataFrame:
    """Metrics by side of a small forest that predicts y_true of the prediction view."""
    done = train_target(pred, ["y_pred", "similarity"], "y_true", "molecule", "rf", ("solvent",), numTrees=10, maxDepth=5, seed=42)
    if done is None:
        return pred.sparkSession.createDataFrame([], "split string, n long, mae double, rmse double, r2 double")
    return done[1].groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in regression(F.col("y_true"), F.col("prediction")).items()])


def seed_ensemble(df: DataFrame, features: list[str], label: str, key: str, seeds: range = range(8), **options) -> DataFrame:  # noqa: ANN003
    """Mean and population deviation of one model over several seeds."""
    parts = [build(features, label, "rf", seed=s, **options).fit(df).transform(df).select(key, "prediction") for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.avg("prediction").alias("prediction"), F.stddev_pop("prediction").alias("prediction_std"))


def grid_search(df: DataFrame, features: list[str], label: str, depths: tuple[int, ...] = (3, 5), folds: int = 3) -> PipelineModel:
    """Best forest of a small grid by cross-validated MAE."""
    p = build(features, label, "rf", numTrees=10, seed=42)
    grid = ParamGridBuilder().addGrid(p.getStages()[-1].maxDepth, list(depths)).build()
    return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mae"), numFolds=folds, seed=42).fit(df).bestModel


def feature_importance(fitted: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(features, fitted.stages[-1].featureImportances.toArray().tolist(), strict=False), key=lambda x: (-x[1], x[0]))


def bright_probability(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability of class 1."""
    return fitted.transform(df).withColumn("bright_probability", vector_to_array("probability")[1])


def random_search(df: DataFrame, features: list[str], label: str, tries: int = 4, folds: int = 3, seed: int = 42) -> PipelineModel:
    """Best forest of randomly drawn settings by cross-validated MAE."""
    rnd = random.Random(seed)
    p = build(features, label, "rf", seed=seed)
    forest = p.getStages()[-1]
    drawn = {(rnd.choice((5, 10, 20)), rnd.choice((3, 5, 8)), rnd.choice((1, 2, 5))) for _ in range(tries)}
    grid = [{forest.numTrees: t, forest.maxDepth: d, forest.minInstancesPerNode: m} for t, d, m in sorted(drawn)]
    return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mae"), numFolds=folds, seed=seed).fit(df).bestModel


def perceptron_classifier(features: list[str], label: str, hidden: tuple[int, ...] = (32, 16), **options) -> Pipeline:  # noqa: ANN003
    """A scaled multilayer perceptron for two classes."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=[len(features), *hidden, 2], seed=42, **options),
    ])


def stack(df: DataFrame, features: list[str], label: str, key: str, models: tuple[str, ...] = ("rf", "gbdt"), folds: int = 3, options: dict[str, dict] | None = None) -> tuple[dict[str, PipelineModel], PipelineModel]:
    """Linear stacking: a line over out-of-fold predictions of the base models, which are then fitted on all rows.

    Folds are decided by the hash of a key, so rows of one group stay together.
    """
    folded = df.withColumn("_fold", F.floor(hash_unit(F.col(key), 7) * folds))
    out = None
    for k in range(folds):
        part = folded.filter(F.col("_fold") == k)
        for m in models:
            fitted = build(features, label, m, **(options or {}).get(m, {})).fit(folded.filter(F.col("_fold") != k))
            part = fitted.transform(part).withColumnRenamed("prediction", f"p_{m}").drop("_features")
        out = part if out is None else out.unionByName(part)
    line = build([f"p_{m}" for m in models], label, "linear").fit(out)
    return {m: build(features, label, m, **(options or {}).get(m, {})).fit(df) for m in models}, line


def predict_stack(base: dict[str, PipelineModel], line: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions of a stack."""
    for m, fitted in base.items():
        df = fitted.transform(df).withColumnRenamed("prediction", f"p_{m}").drop("_features")
    return line.transform(df).drop("_features", *[f"p_{m}" for m in base])


#: Optional boosting libraries: the module, and the class that fits a DataFrame.
OPTIONAL = {"xgboost": ("xgboost.spark", "SparkXGBRegressor"), "lightgbm": ("synapse.ml.lightgbm", "LightGBMRegressor"), "catboost": ("catboost_spark", "CatBoostRegressor")}


def optional_backend(name: str) -> tuple[type | None, str]:
    """The class of an optional library, or None and why it is skipped."""
    module, cls = OPTIONAL[name]
    if importlib.util.find_spec(module.split(".")[0]) is None:
        return None, f"{name} is not installed; skipped"
    try:
        return getattr(importlib.import_module(module), cls), ""
    except (ImportError, AttributeError) as e:
        return None, f"{name} can't be loaded: {e}; skipped"


def compare(results: list[DataFrame], metric: str = "mae") -> DataFrame:
    """Metrics of several models as one table, the best first; missing metrics last."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy(F.col(metric).asc_nulls_last(), "model")
