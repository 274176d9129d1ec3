"""Training folds and run metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.operators.splits import fold_of
from vacantia.schemas import RUN_METADATA


def persist_folds(
    samples: DataFrame,
    folder: str,
    metadata: dict,
    key: str = "code",
    folds: int = C.FOLDS,
    seed: int = C.FOLD_SEED,
) -> None:
    """Replace the folder's folds and metadata, in one pass over the samples."""
    spark = samples.sparkSession
    (
        samples.withColumn("fold", fold_of(F.col(key), folds, seed))
        .write.mode("overwrite")
        .partitionBy("fold")
        .parquet(os.path.join(folder, "folds"))
    )
    row = (metadata["feature_names"], metadata["full_sample_size"], metadata["segment_keyword"])
    spark.createDataFrame([row], RUN_METADATA).coalesce(1).write.mode("overwrite").json(
        os.path.join(folder, "metadata")
    )


def read_folds(
    spark: SparkSession, folder: str, use_log_wage: bool = True, folds: list[int] | None = None
) -> DataFrame:
    """All folds (or some, by partition pruning) with the chosen `label`."""
    samples = spark.read.parquet(os.path.join(folder, "folds"))
    if folds is not None:
        samples = samples.filter(F.col("fold").isin(folds))
    label = F.col("log_wage" if use_log_wage else "wage")
    return samples.withColumn("label", label)


def read_run_metadata(spark: SparkSession, folder: str) -> Row:
    """The metadata row; an error if none was written."""
    path = os.path.join(folder, "metadata")
    return spark.read.schema(RUN_METADATA).option("mode", "FAILFAST").json(path).first()
