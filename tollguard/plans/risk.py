"""Predictions to risk: score percentiles, ranks, categories and the master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollguard import lookups
from tollguard.operators.ranks import Ranking, rank_values
from tollguard.operators.skew import attach
from tollguard.schemas import MASTER_COLUMNS, PRED_VIZ_COLUMNS

SCORE = "ml_anomaly_score"
# Percentile limits of the three risk categories.
PERCENTS = [1, 5, 25]
THRESHOLDS = ["p1", "p5", "p25"]


def score_percentiles(predictions: DataFrame, ranking: Ranking | None = None) -> DataFrame:
    """One row with the 1st, 5th and 25th percentile score, each a score that occurs."""
    limits = (ranking or rank_values(predictions, SCORE)).percentiles(PERCENTS)
    schema = ", ".join(f"{name} double" for name in THRESHOLDS)
    return predictions.sparkSession.createDataFrame(
        [tuple(None if v is None else float(v) for v in limits)], schema
    )


def score_threshold_cross(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The thresholds, three numbers, on every row."""
    limits = thresholds.first()
    return predictions.withColumns({p: F.lit(limits[p]).cast("double") for p in THRESHOLDS})


def score_percentile_rank(predictions: DataFrame, ranking: Ranking | None = None) -> DataFrame:
    """Share of the other rows with a lower score: exact, without sorting all rows in one task."""
    ranking = ranking or rank_values(predictions, SCORE)
    others = max(ranking.total - 1, 1)
    table = ranking.table.select(
        F.col("value").alias(SCORE),
        (F.col("rows_below") / F.lit(float(others))).alias("score_percentile_rank"),
    )
    return attach(predictions, table, [SCORE], null_safe=True)


def anomaly_category() -> Column:
    """Lower scores are riskier. ``Medium`` follows ``Critical``: there is no ``High``."""
    score = F.col(SCORE)
    return (
        F.when(score <= F.col("p1"), "Critical Risk")
        .when(score <= F.col("p5"), "Medium Risk")
        .when(score <= F.col("p25"), "Low Risk")
        .otherwise("No Risk")
    )


def categorize(predictions: DataFrame, ranked: bool = True, ranking: Ranking | None = None) -> DataFrame:
    """Thresholds, category and, if ``ranked``, percentile rank from one ranking of the scores."""
    ranking = ranking or rank_values(predictions, SCORE)
    limits = score_percentiles(predictions, ranking)
    placed = score_threshold_cross(predictions, limits).withColumn("anomaly_category", anomaly_category())
    return score_percentile_rank(placed, ranking) if ranked else placed


def pred_viz(predictions: DataFrame, ranking: Ranking | None = None) -> DataFrame:
    renamed = {p: f"score_{p}_threshold" for p in THRESHOLDS}
    return categorize(predictions, ranking=ranking).withColumnsRenamed(renamed).select(*PRED_VIZ_COLUMNS)


def review_status(category: Column) -> Column:
    """High and critical risks need a review; no category, no status."""
    risky = F.lower(category).isin("high risk", "critical risk")
    return F.when(risky, lookups.NEEDS_REVIEW).when(category.isNotNull(), lookups.NO_ACTION)


MASTER_FROM_PREDICTIONS = {
    "is_anomaly": "is_anomaly",
    "ml_predicted_score": "ml_anomaly_score",
    "ml_predicted_category": "anomaly_category",
    "prediction_timestamp": "prediction_timestamp",
}


def master_join(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold with its predictions by id. Prediction ids have to be unique (``check_unique``)."""
    scored = predictions.select(
        F.col("transaction_id").alias("_id"),
        *[F.col(c).alias(name) for name, c in MASTER_FROM_PREDICTIONS.items()],
    )
    return gold.join(scored, gold["transaction_id"] == F.col("_id"), "left").drop("_id")


def master_viz(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """The reporting table."""
    return master_part(gold, predictions, MASTER_COLUMNS)


def master_part(gold: DataFrame, predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of all rows of the reporting table; ``gold`` needs only what they are made of."""
    return (
        master_join(gold, predictions)
        .withColumn("status", review_status(F.col("ml_predicted_category")))
        .withColumnRenamed("anomaly_score", "rule_based_score")
        .select(*columns)
    )
