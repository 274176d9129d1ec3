"""Linear log-wage regression, prediction errors, marginal effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.vectors import present_features


# Steps in which tasks add up their vectors, of a value or several per feature, before the driver
# does: of 400 of them it then gets 7, not 20.
AGGREGATION_DEPTH = 3


def fit_wage_regression(
    train: DataFrame,
    reg_param: float = 0.01,
    elastic_net_param: float = 0.0,
    max_iter: int = 100,
    tolerance: float = 1e-6,
) -> LinearRegressionModel:
    """Elastic-net regression of `label` on the sparse `features`."""
    estimator = LinearRegression(
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        regParam=reg_param,
        elasticNetParam=elastic_net_param,
        maxIter=max_iter,
        tol=tolerance,
        solver="l-bfgs",
        aggregationDepth=AGGREGATION_DEPTH,
    )
    return estimator.fit(train)


def regression_errors(predictions: DataFrame, *groups: str) -> DataFrame:
    """RMSE and MAE of prediction `p` against `y`, per group."""
    miss = F.col("y") - F.col("p")
    return predictions.groupBy(*groups).agg(
        F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae")
    )


def feature_shares(samples: DataFrame) -> DataFrame:
    """Share of samples that hold each feature index."""
    total = samples.agg(F.count("*")).scalar()
    return (
        samples.select(F.explode(present_features()).alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"))
        .select("feature", (F.col("n") / total).alias("prop_doc"))
    )


def marginal_effects(
    samples: DataFrame, names: Sequence[str], gradients: Sequence[float]
) -> DataFrame:
    """(keyword, marginal_effect, prop_doc), largest effect first.

    `gradients` holds the mean derivative of the output per feature; for a linear model
    that is its coefficient. A feature no sample holds has proportion 0.
    """
    spark = samples.sparkSession
    # As an Arrow table, which takes a driver far less memory than a row object per feature.
    effects = spark.createDataFrame(
        pa.table(
            {
                "feature": np.arange(len(names), dtype=np.int32),
                "keyword": pa.array(names, pa.string()),
                "marginal_effect": np.asarray(gradients, float),
            }
        )
    )
    return (
        effects.join(feature_shares(samples), "feature", "left")
        .select("keyword", "marginal_effect", F.coalesce("prop_doc", F.lit(0.0)).alias("prop_doc"))
        .orderBy(F.desc("marginal_effect"), "keyword")
    )
