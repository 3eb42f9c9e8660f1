"""Gold to model features: frequency encoding and the training projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollguard.operators.skew import attach_small, bounded
from tollguard.schemas import FREQUENCY_FEATURES, TRAIN_COLUMNS


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, rows`` for all ``columns`` in one pass, missing values left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


def frequency_encode(
    df: DataFrame, features: Mapping[str, str] = FREQUENCY_FEATURES, counts: DataFrame | None = None
) -> DataFrame:
    """How often each row's value occurs, per text column; a missing value counts 0.

    One pass counts all columns, unless their ``value_counts`` are given. If the counts are small, as codes are, they are broadcast and
    the rows are not shuffled; otherwise every column is checked and joined on its own.
    """
    counts = value_counts(df, list(features)) if counts is None else counts
    small = bounded(counts)
    source = counts if small is None else small
    for column, feature in features.items():
        table = source.filter(F.col("column") == column).select(
            F.col("value").alias(column), F.col("rows").alias(feature)
        )
        if small is None:
            df = attach_small(df, table, [column])
        else:
            df = df.join(F.broadcast(table), column, "left")
        df = df.withColumn(feature, F.coalesce(F.col(feature), F.lit(0).cast("bigint")))
    return df


def gold_train(gold: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The training table: three ids and 23 features."""
    return train_part(gold, TRAIN_COLUMNS, counts)


def train_part(gold: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """These columns of all rows of the training table; ``gold`` needs only what they and the codes are made of.

    With the ``value_counts`` of silver, whose rows are gold's, gold is computed once.
    """
    return frequency_encode(gold, counts=counts).select(*columns)
