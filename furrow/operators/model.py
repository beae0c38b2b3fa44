"""Boosted-tree yield model: training with year-ordered folds, scoring, importances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.config import TreeGrid
from furrow.operators.forecast import FEATURES, evaluate, forecast_linear
from furrow.session import materialise

LABEL = "yield_bu_per_acre"
ROWS_A_TASK = 250_000


def _assembled(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def _few_parts(table: DataFrame) -> DataFrame:
    """The table in as many parts as there are cores, more where a part would pass :data:`ROWS_A_TASK`.

    A fit is some hundred short stages, each with a task a part, so the parts must not follow the number of files.
    """
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS_A_TASK))
    return table.coalesce(parts) if table.rdd.getNumPartitions() > parts else table


def train(training: DataFrame, grid: TreeGrid = TreeGrid(), folds: int = 2,
          features: Sequence[str] = FEATURES, parallel: int = 8) -> tuple[GBTRegressionModel, DataFrame]:
    """Best model of the grid and the fold scores.

    Folds are in time order: fold i trains on the years before the i-th last one
    and is scored on that year. The training table is written once, since every
    fit reads it many times. ``parallel`` fits of the grid run side by side: a fit is many short jobs.
    """
    table = _few_parts(materialise(_assembled(training, features).select("fips", "year", "features", LABEL), "training"))
    years = [r["year"] for r in table.select("year").distinct().orderBy(F.desc("year")).limit(folds + 1).collect()]
    held_out = years[:-1]
    if not held_out:
        raise ValueError("time-ordered folds need at least two years")

    def fold(depth: int, rate: float, rounds: int, year: int) -> DataFrame:
        model = _learner(grid, depth, rate, rounds).fit(table.filter(F.col("year") < year))
        return evaluate(model.transform(table.filter(F.col("year") == year)), LABEL, "prediction").select(
            F.lit(depth).alias("max_depth"), F.lit(rate).alias("learning_rate"),
            F.lit(rounds).alias("n_estimators"), F.lit(year).alias("fold_year"), "n", "r2", "mae")

    with ThreadPool(parallel) as pool:
        found = pool.starmap(inheritable_thread_target(table.sparkSession)(fold),
                              product(grid.depths, grid.rates, grid.rounds, held_out))
    scores = materialise(reduce(DataFrame.unionByName, found), "fold-scores")
    best = (scores.groupBy("max_depth", "learning_rate", "n_estimators").agg(F.avg("mae").alias("mae"))
            .orderBy("mae", "max_depth", "learning_rate", "n_estimators").first())
    model = _learner(grid, best["max_depth"], best["learning_rate"], best["n_estimators"]).fit(table)
    return model, scores


def _learner(grid: TreeGrid, depth: int, rate: float, rounds: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=LABEL, maxDepth=depth, stepSize=rate, maxIter=rounds,
                        subsamplingRate=grid.subsample, seed=grid.seed)


def score_model(features_table: DataFrame, model: Model | None, features: Sequence[str] = FEATURES) -> DataFrame:
    """Tree forecast where a model is given and the features are complete, else the linear one."""
    linear = forecast_linear(features_table)
    if model is None:
        return linear.withColumn("model_type", F.lit("linear"))
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    ready = linear.withColumn("__whole", whole).fillna(0.0, subset=list(features))
    vector = VectorAssembler(inputCols=list(features), outputCol="features").transform(ready)
    scored = model.transform(vector)
    return scored.withColumns({
        "raw_forecast": F.when(F.col("__whole"), F.col("prediction")).otherwise(F.col("raw_forecast")),
        "model_type": F.when(F.col("__whole"), "boosted trees").otherwise("linear"),
    }).drop("features", "prediction", "__whole")


def importances(model: GBTRegressionModel, spark, features: Sequence[str] = FEATURES, k: int = 5) -> DataFrame:
    """Normalised importances of the k strongest features."""
    rows = list(zip(features, (float(x) for x in model.featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(k)
