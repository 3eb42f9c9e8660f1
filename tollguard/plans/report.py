"""Reporting queries on the master table and its rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard import lookups
from tollguard.functions.money import sum_dollars

IS_ANOMALY = "is_anomaly"

# Flag column and its chart label.
FLAG_LABELS = {
    "flag_rush_hour": "Rush Hour",
    "flag_is_weekend": "Weekend",
    "flag_is_holiday": "Holiday",
    "flag_overlapping_journey": "Overlapping Journey",
    "flag_driver_amount_outlier": "Driver Amount Outlier",
    "flag_route_amount_outlier": "Route Amount Outlier",
    "flag_amount_unusually_high": "Amount Unusually High",
    "flag_driver_spend_spike": "Driver Spend Spike",
}


def _anomalous() -> Column:
    return F.col(IS_ANOMALY) == 1


def _loss() -> Column:
    return F.coalesce(sum_dollars(F.when(_anomalous(), F.col("amount"))), F.lit(0.0))


# Rollups ------------------------------------------------------------------------------------

def stats_summary(master: DataFrame, as_of: str) -> DataFrame:
    """One row over all time. Both amounts are the amount of the anomalies, by definition."""
    return master.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _loss().alias("total_amount_all_time"),
        F.count_if(_anomalous()).alias("total_alert_all_time"),
        _loss().alias("loss_all_time"),
    ).select(F.lit(as_of).cast("date").alias("as_of_date"), "*")


def stats_month(master: DataFrame, as_of: str) -> DataFrame:
    """One row per month of transaction."""
    return (
        master.filter(F.col("transaction_date").isNotNull())
        .groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(_anomalous()).alias("total_alerts"),
            _loss().alias("total_loss"),
        )
        .select(F.lit(as_of).cast("date").alias("as_of_date"), "*")
    )


def severity_counts(master: DataFrame) -> DataFrame:
    return (
        master.filter(F.col("ml_predicted_category").isNotNull())
        .groupBy(F.col("ml_predicted_category").alias("severity"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "severity")
    )


def flag_category_counts(master: DataFrame) -> DataFrame:
    """Anomalies per raised flag; flags never raised do not appear."""
    labels = F.array(*[F.when(F.col(f), F.lit(label)) for f, label in FLAG_LABELS.items()])
    return (
        master.filter(_anomalous())
        .select(F.explode(F.array_compact(labels)).alias("category"))
        .groupBy("category").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "category")
    )


def hourly_anomalies(master: DataFrame) -> DataFrame:
    """Anomalies per hour of entry, those without an entry time under NULL."""
    return (
        master.filter(_anomalous())
        .groupBy(F.hour("entry_time").cast("bigint").alias("hour"))
        .agg(F.count(F.lit(1)).alias("fraud_count"))
        .orderBy("hour")
    )


def category_share(counts: DataFrame) -> DataFrame:
    """Each row's percentage of the total ``count`` with one decimal, 0 if the total is 0.

    ``counts`` is a chart: a handful of categories.
    """
    total = F.sum("count").over(Window.partitionBy())
    share = F.round(F.coalesce(F.try_divide(F.col("count"), total) * 100, F.lit(0.0)), 1)
    return counts.withColumn("percentage", share)


# Lists and search ---------------------------------------------------------------------------

def _contains(column: str, search: str) -> Column:
    pattern = "%" + search.lower().replace("\\", "\\\\") + "%"
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).like(pattern)


def transaction_filter(search: str = "", status: str = "", category: str = "") -> Column:
    """Search in id, tag and category ignoring case (``%`` and ``_`` are wildcards), exact
    status, category ignoring case. Empty and ``all`` filter nothing."""
    search, status, category = search.strip(), status.strip(), category.strip()
    tests = [F.lit(True)]
    if search:
        columns = ("transaction_id", "tag_plate_number", "ml_predicted_category")
        tests.append(reduce(Column.__or__, [_contains(c, search) for c in columns]))
    if status and status != "all":
        tests.append(F.col("status") == status)
    if category and category != "all":
        tests.append(F.lower("ml_predicted_category") == category.lower())
    return reduce(Column.__and__, tests)


def _latest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("transaction_date"), "transaction_id")


def search_transactions(
    master: DataFrame,
    search: str = "",
    status: str = "",
    category: str = "",
    page: int = 1,
    limit: int = 50,
) -> DataFrame:
    """One page of the matching transactions, latest first."""
    found = master.filter(transaction_filter(search, status, category))
    return _latest_first(found).offset((page - 1) * limit).limit(limit)


def count_transactions(
    master: DataFrame, search: str = "", status: str = "", category: str = ""
) -> DataFrame:
    found = master.filter(transaction_filter(search, status, category))
    return found.agg(F.count(F.lit(1)).alias("total"))


def alerts(master: DataFrame, limit: int = 100) -> DataFrame:
    return _latest_first(master.filter(_anomalous())).limit(limit)


def recent_flagged(master: DataFrame, limit: int = 3) -> DataFrame:
    """Latest transactions to review or flagged by the model."""
    flagged = master.filter((F.col("status") == lookups.NEEDS_REVIEW) | _anomalous())
    return _latest_first(flagged).limit(limit).select(
        F.col("transaction_id").alias("id"),
        "transaction_id",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
        "tag_plate_number",
        F.col("tag_plate_number").alias("tagPlate"),
        "agency",
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        "status",
        F.coalesce("ml_predicted_category", F.lit("Anomaly Detected")).alias("category"),
        F.coalesce(_anomalous(), F.lit(False)).alias("is_anomaly"),
    )


METRICS = ["total_transactions", "total_amount_all_time", "total_alert_all_time", "loss_all_time"]


def latest_metrics(stats: DataFrame) -> DataFrame:
    """The newest summary row, or one row of zeros."""
    newest = stats.orderBy(F.desc("as_of_date")).limit(1)
    # An ungrouped aggregate of at most one row: it yields a row even for no input.
    return newest.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in METRICS])


def latest_month(months: DataFrame) -> DataFrame:
    newest = months.orderBy(F.desc("month")).limit(1)
    return newest.agg(
        F.max("month").alias("month"),
        F.coalesce(F.max("total_alerts"), F.lit(0)).alias("total_alerts"),
    )


def monthly_series(months: DataFrame, limit: int = 12) -> DataFrame:
    """The last twelve months, oldest first."""
    return months.orderBy(F.desc("month")).limit(limit).orderBy("month").select(
        "month",
        F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
        F.coalesce("total_alerts", F.lit(0)).alias("fraud_alerts"),
        F.coalesce("total_loss", F.lit(0.0)).alias("total_loss"),
    )


def score_scatter(master: DataFrame, since: str = "2024-01-01") -> DataFrame:
    return (
        master.filter(F.col("transaction_date") >= F.lit(since).cast("date"))
        .select(
            "amount",
            F.col("ml_predicted_score").alias("ml_anomaly_score"),
            F.col("ml_predicted_category").alias("risk_level"),
        )
        .dropna()
    )


# Ordering -----------------------------------------------------------------------------------

# Text columns that sort as numbers.
NUMERIC_TEXT = ["plan_rate"]


def sort_table(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    """Sort by type: numbers, dates and booleans as such, text ignoring case; NULL is smallest.

    Equal keys keep the order of the list, newest date first and then by id, as far as ``df`` has
    these columns.
    """
    key = F.col(column)
    if column in NUMERIC_TEXT:
        key = key.try_cast("double")
    elif isinstance(df.schema[column].dataType, T.StringType):
        key = F.lower(F.coalesce(key, F.lit("")))
    ordered = key.asc_nulls_first() if direction == "asc" else key.desc_nulls_last()
    ties = {"transaction_date": F.desc_nulls_last, "transaction_id": F.asc}
    return df.orderBy(ordered, *[by(c) for c, by in ties.items() if c in df.columns and c != column])


def order_by_severity(df: DataFrame, column: str = "severity") -> DataFrame:
    """Most severe first, unknown labels last."""
    known = F.array_position(F.lit(lookups.SEVERITY_ORDER), F.col(column))
    place = F.coalesce(F.nullif(known, F.lit(0)), F.lit(len(lookups.SEVERITY_ORDER) + 1))
    return df.orderBy(place, column)
