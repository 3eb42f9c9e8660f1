"""Review decisions that stay: a history of accepted requests, folded into the stored master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.plans import review
from tollguard.session import materialize, scratch_scope
from tollguard.sources import sinks
from tollguard.sources.ledger import exists

#: An accepted request, in the order of batches and requests.
HISTORY_SCHEMA = (
    "transaction_id string, transaction_date date, new_status string, seq long, updated_at timestamp, batch string"
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def fold_history(master: DataFrame, history: DataFrame) -> DataFrame:
    """``master`` with the last accepted status of each transaction and its time; rows without a
    request stay as they are. Folding again changes nothing."""
    last = history.groupBy(F.col("transaction_id").alias("_id")).agg(
        F.max(F.struct("updated_at", "batch", "seq", "new_status")).alias("_last")
    )
    joined = master.join(last, master["transaction_id"] == F.col("_id"), "left")
    reviewed = F.col("_last").isNotNull()
    return joined.withColumns({
        "status": F.when(reviewed, F.col("_last.new_status")).otherwise(F.col("status")),
        "last_updated": F.when(reviewed, F.col("_last.updated_at")).otherwise(F.col("last_updated")),
    }).select(*master.columns)


def accepted_requests(master: DataFrame, updates: DataFrame, updated_at: str) -> DataFrame:
    """The accepted requests of ``updates``, with the date of their transaction."""
    steps = review.accepted_steps(master, updates).select("transaction_id", F.inline("steps"))
    dates = master.select(F.col("transaction_id").alias("_id"), "transaction_date")
    return steps.join(dates, F.col("transaction_id") == F.col("_id")).select(
        "transaction_id", "transaction_date", "new_status", F.col("seq").cast("long").alias("seq"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"),
    )


def merge_updates(
    spark: SparkSession, master_path: str, history_path: str, updates: DataFrame, updated_at: str, batch: str
) -> None:
    """Decide a batch of requests against the stored master table and write the outcome into it.

    The accepted requests are kept in the history first, in a folder of the batch; then only the date
    folders that they touch are written anew, all others keep their files. A batch that runs again is
    not decided again: what its history holds is folded in. Batches follow each other by
    ``updated_at``, equal ones by name; one at a time writes a table. ``medallion.build`` folds the
    history into each new master table.
    """
    folder = f"{history_path}/batch={batch}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        master = spark.read.parquet(master_path).select("transaction_id", "transaction_date", "status")
        accepted_requests(master, updates, updated_at).write.mode("overwrite").parquet(folder)
    history = read_history(spark, history_path)
    # one row per date of the batch
    dates = [r[0] for r in history.filter(F.col("batch") == batch).select("transaction_date").distinct().collect()]
    if not dates:
        return
    date = F.col("transaction_date")
    touched = date.isin([d for d in dates if d is not None]) | (date.isNull() if None in dates else F.lit(False))
    with scratch_scope(spark):
        rows = materialize(fold_history(spark.read.parquet(master_path).filter(touched), history))
        sinks.write_partitioned(rows, master_path, sinks.MASTER_CLUSTER, partition_overwrite="dynamic")
