"""Partitioned table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollguard.schemas import PREDICTION_COLUMNS

SILVER_CLUSTER = ["tag_plate_number", "transaction_date"]
MASTER_CLUSTER = ["tag_plate_number", "ml_predicted_category", "transaction_date"]


def write_partitioned(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str] = tuple(SILVER_CLUSTER),
    partition_by: str = "transaction_date",
    mode: str = "overwrite",
    partition_overwrite: str = "static",
    balanced: bool = False,
) -> None:
    """One directory per date, rows sorted by ``cluster_by`` inside each file.

    The rebalance hint lets adaptive execution split a hot date over several writers and put
    small dates together, so files come out evenly sized. Where ``df`` is ``balanced``, as columns of
    a table that was written so are, its rows are written where they are read, without a shuffle.
    """
    order = [partition_by, *[c for c in cluster_by if c != partition_by]]
    (
        (df if balanced else df.hint("rebalance", partition_by))
        .sortWithinPartitions(*order)
        .write.mode(mode).option("partitionOverwriteMode", partition_overwrite)
        .partitionBy(partition_by).parquet(path)
    )


def write_predictions(df: DataFrame, path: str) -> list[str]:
    """Write predictions by day of prediction; returns the expected columns ``df`` lacks.

    A day that is written again is replaced, so running a training twice does not double it;
    other days stay. A run has one day or two: rows are written where they are, without a shuffle.
    """
    known = [c for c in PREDICTION_COLUMNS if c in df.columns]
    dated = df.select(*known).withColumn("prediction_date", F.to_date("prediction_timestamp"))
    dated.sortWithinPartitions("prediction_date", "transaction_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("prediction_date").parquet(path)
    return [c for c in PREDICTION_COLUMNS if c not in df.columns]
