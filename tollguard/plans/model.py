"""Training table to predictions: impute, scale, isolate, cut at the contamination."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.operators.forest import SEED, TREES, Forest, fit_forest, score_forest
from tollguard.operators.medians import exact_medians, present
from tollguard.operators.ranks import Ranking, rank_values
from tollguard.schemas import METRICS_SCHEMA, PREDICTION_COLUMNS
from tollguard.session import materialize

CONTAMINATION = 0.01
ID = "transaction_id"
NOT_FEATURES = {ID, "tag_plate_number", "last_updated", "source_file"}


def feature_names(train: DataFrame) -> list[str]:
    """Numeric columns that are no id, no metadata and no flag."""
    return [
        field.name for field in train.schema
        if isinstance(field.dataType, T.NumericType)
        and field.name not in NOT_FEATURES
        and not field.name.startswith("flag_")
    ]


def feature_matrix(train: DataFrame) -> DataFrame:
    """Id and numeric features as doubles."""
    return train.select(ID, *[F.col(c).cast("double").alias(c) for c in feature_names(train)])


def impute_median(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """Missing values, NaN and infinite ones too, become the column's median. Columns without any value have none: they are
    dropped and named."""
    columns = [c for c in matrix.columns if c != ID]
    medians = exact_medians(matrix, columns)
    empty = [c for c in columns if medians[c] is None]
    filled = [F.coalesce(present(c), F.lit(medians[c])).alias(c) for c in columns if c not in empty]
    return matrix.select(ID, *filled), empty


EPSILON = 2.0**-52


def _scale(n: int, mean: float, std: float) -> float:
    """The divisor: 1 for a column whose spread is within rounding error of its mean."""
    constant = std * std <= n * EPSILON * std * std + (n * mean * EPSILON) ** 2
    return 1.0 if constant else std


def standard_scale(matrix: DataFrame) -> DataFrame:
    """Centre and divide by the population standard deviation, a constant column by 1."""
    columns = [c for c in matrix.columns if c != ID]
    stats = matrix.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns],
    ).first()
    if not stats["_rows"]:
        return matrix
    return matrix.select(ID, *[
        ((F.col(c) - stats[c]["mean"]) / _scale(stats["_rows"], *stats[c])).alias(c) for c in columns
    ])


@dataclass(frozen=True)
class Fitted:
    forest: Forest
    scaled: DataFrame
    dropped: list[str]


def isolation_forest_fit(train: DataFrame, trees: int = TREES, seed: int = SEED) -> Fitted:
    matrix, dropped = impute_median(feature_matrix(train))
    scaled = standard_scale(matrix)
    features = [c for c in scaled.columns if c != ID]
    return Fitted(fit_forest(scaled, ID, features, trees, seed=seed), scaled, dropped)


def isolation_forest_score(fitted: Fitted) -> DataFrame:
    """``transaction_id, raw_score`` for every training row."""
    return score_forest(fitted.scaled, fitted.forest).select(ID, "raw_score")


def contamination_cut(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Shift raw scores so that the ``contamination`` share falls below 0, and flag that share."""
    offset = rank_values(scores, "raw_score").interpolated(contamination)
    shifted = F.col("raw_score") - F.lit(offset)
    return scores.withColumns({
        "ml_anomaly_score": shifted,
        "is_anomaly": F.when(shifted < 0, 1).otherwise(0),
    })


def predict(
    train: DataFrame, predicted_at: str, contamination: float = CONTAMINATION
) -> DataFrame:
    """The prediction table: id, features, flag, score, time. ``train`` ids must be unique.

    Scores are kept by a checkpoint, so ranking them does not run the trees again.
    """
    scores = materialize(isolation_forest_score(isolation_forest_fit(train)))
    cut = contamination_cut(scores, contamination).drop("raw_score")
    return (
        train.join(cut, ID)
        .withColumn("prediction_timestamp", F.lit(predicted_at).cast("timestamp"))
        .select(*PREDICTION_COLUMNS)
    )


def training_metrics(
    predictions: DataFrame,
    model_id: str,
    trained_at: str,
    seconds: float,
    n_features: int,
    n_estimators: int = TREES,
    contamination: float = CONTAMINATION,
    ranking: Ranking | None = None,
) -> DataFrame:
    """One row on a training run, in the layout of the metrics table. ``ranking`` is that of the scores."""
    median = (ranking or rank_values(predictions, "ml_anomaly_score")).interpolated(0.5)
    score, flagged = F.col("ml_anomaly_score"), F.col("is_anomaly")
    row = predictions.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(F.sum(flagged), F.lit(0)).alias("n_anomalies"),
        F.avg(flagged.cast("double")).alias("anomaly_rate"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    ).withColumns({
        "model_id": F.lit(model_id),
        "model_type": F.lit("isolation_forest"),
        "training_timestamp": F.lit(trained_at).cast("timestamp"),
        "training_time_seconds": F.lit(float(seconds)),
        "n_features": F.lit(n_features).cast("bigint"),
        "n_estimators": F.lit(n_estimators).cast("bigint"),
        "contamination": F.lit(contamination),
        "score_median": F.lit(median).cast("double"),
    })
    return row.select([f.split()[0] for f in METRICS_SCHEMA.split(", ")])
