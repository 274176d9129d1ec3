"""Reading training histories (model, epoch, val_rmse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop_epoch(
    history: DataFrame, threshold: float = 0.1, min_epochs: int = 30, window: int = 10
) -> DataFrame:
    """First epoch at which the last `window` epochs improved by less than the threshold;
    NULL for a model that never stops early."""
    by_epoch = Window.partitionBy("model").orderBy("epoch")
    opening = F.lag("val_rmse", window - 1).over(by_epoch)
    improvement = F.try_divide(opening - F.col("val_rmse"), opening)
    stops = (F.col("epoch") >= min_epochs) & (improvement < threshold)
    return (
        history.withColumn("stops", stops)
        .groupBy("model")
        .agg(F.min(F.when(F.col("stops"), F.col("epoch"))).alias("stop_epoch"))
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch of the first minimum of the validation error."""
    return history.groupBy("model").agg(
        F.min_by("epoch", F.struct("val_rmse", "epoch")).alias("best_epoch"),
        F.min("val_rmse").alias("best_rmse"),
    )
