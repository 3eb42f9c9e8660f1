"""Rollup cells per date: statistics of the master table that are renewed for touched dates only.

Cells hold nothing that a review decision changes, so ``status.merge_updates`` leaves them right.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.functions.money import cents, dollars
from tollguard.plans.report import IS_ANOMALY
from tollguard.session import materialize, scratch_scope
from tollguard.sources import sinks
from tollguard.sources.ledger import exists

#: One row per date of the master table, dates that are NULL in one of their own. A loss without an
#: amount is NULL, as a sum is.
CELL_SCHEMA = "transaction_date date, transactions long, alerts long, loss_cents double, month string"
#: The month of rows without a date, as a folder name.
UNDATED = "none"


def stat_cells(master: DataFrame) -> DataFrame:
    """Per date: rows, anomalies, and the anomalies' amounts in whole cents, which add up exactly."""
    anomalous = F.col(IS_ANOMALY) == 1
    return master.groupBy("transaction_date").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(anomalous).alias("alerts"),
        F.sum(cents(F.when(anomalous, F.col("amount")))).alias("loss_cents"),
    ).withColumn("month", F.coalesce(F.date_format("transaction_date", "yyyy-MM"), F.lit(UNDATED)))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], CELL_SCHEMA)
    return spark.read.schema(CELL_SCHEMA).parquet(path)


def _write(cells: DataFrame, path: str, overwrite: str) -> None:
    # a cell per date: a month is one small file
    cells.repartition("month").sortWithinPartitions("month", "transaction_date").write.mode("overwrite").option(
        "partitionOverwriteMode", overwrite
    ).partitionBy("month").parquet(path)


def write_cells(master: DataFrame, path: str) -> None:
    """The cells of the whole table, in place of all that are stored."""
    _write(stat_cells(master), path, "static")



def refresh_cells(spark: SparkSession, master_path: str, path: str, dates: Iterable[date | None]) -> None:
    """Renew the cells of ``dates`` from the stored master table; None names the rows without a date.

    Only the date folders named are read and only the months around them written. A date without
    rows leaves no cell. Cells are counted anew and not added to, so a refresh that is repeated, or
    runs again after a stop, gives the same cells.
    """
    dates = set(dates)
    if not dates:
        return
    months = {d.strftime("%Y-%m") if d else UNDATED for d in dates}
    # literals let the scan pick folders, where a NULL date is a folder as well
    known, undated = F.col("transaction_date").isin([d for d in dates if d is not None]), F.col("transaction_date").isNull()
    touched = known | undated if None in dates else known
    with scratch_scope(spark):
        fresh = stat_cells(spark.read.parquet(master_path).filter(touched))
        others = read_cells(spark, path).filter(
            F.col("month").isin(list(months)) & ~F.coalesce(touched, F.lit(False)) & (F.col("transactions") > 0)
        )
        cells = materialize(fresh.unionByName(others))
        # a month that has lost its last row is overwritten by a cell of nothing, which no report shows
        left = {r[0] for r in cells.select("month").distinct().collect()}
        gone = spark.createDataFrame([(None, 0, 0, None, m) for m in sorted(months - left)], CELL_SCHEMA)
        _write(cells.unionByName(gone), path, "dynamic")


def replace_days(spark: SparkSession, rows: DataFrame, master_path: str, path: str, dates: Iterable[date | None]) -> None:
    """Write ``rows`` in place of what the stored master table holds for their dates, and renew the
    cells of ``dates``, which name all dates of ``rows``."""
    sinks.write_partitioned(rows, master_path, sinks.MASTER_CLUSTER, partition_overwrite="dynamic")
    refresh_cells(spark, master_path, path, dates)


# Rollups ------------------------------------------------------------------------------------

def stats_summary(cells: DataFrame, as_of: str) -> DataFrame:
    """``report.stats_summary`` of the table that the cells are of."""
    loss = F.coalesce(dollars(F.sum("loss_cents")), F.lit(0.0))
    return cells.agg(
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("total_transactions"),
        loss.alias("total_amount_all_time"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("total_alert_all_time"),
        loss.alias("loss_all_time"),
    ).select(F.lit(as_of).cast("date").alias("as_of_date"), "*")


def stats_month(cells: DataFrame, as_of: str) -> DataFrame:
    """``report.stats_month`` of the table that the cells are of."""
    return (
        cells.filter(F.col("transaction_date").isNotNull()).groupBy("month")
        .agg(
            F.sum("transactions").alias("total_transactions"),
            F.sum("alerts").alias("total_alerts"),
            F.coalesce(dollars(F.sum("loss_cents")), F.lit(0.0)).alias("total_loss"),
        )
        .select(F.lit(as_of).cast("date").alias("as_of_date"), "*")
    )
