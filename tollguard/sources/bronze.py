"""The bronze table: append, detect new files, verify, de-duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.functions.cleaning import plain_number
from tollguard.functions.money import sum_dollars
from tollguard.operators.skew import BROADCAST_ROWS, bounded
from tollguard.schemas import BRONZE_COLUMNS, BRONZE_SCHEMA, DEDUPE_KEYS


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """All loads: files of batches, and the folder that each streamed batch has of its own."""
    return spark.read.schema(BRONZE_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def bronze_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in BRONZE_COLUMNS])


def append_bronze(df: DataFrame, path: str) -> None:
    """Append rows as the 19 text columns. History is kept, unlike a drop and reload."""
    bronze_columns(df).write.mode("append").parquet(path)


def new_files_only(listing: DataFrame, bronze: DataFrame, name_column: str = "name") -> DataFrame:
    """Files of ``listing`` that no bronze row names as its source."""
    loaded = bronze.select(F.col("source_file").alias("_loaded")).dropna().distinct()
    return listing.join(loaded, listing[name_column] == F.col("_loaded"), "left_anti")


def verify_load(bronze: DataFrame) -> DataFrame:
    """One row: rows, files, date range and the sum of the amounts that are numbers."""
    return bronze.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("source_file").alias("unique_files"),
        F.min("transaction_date").alias("earliest_transaction"),
        F.max("transaction_date").alias("latest_transaction"),
        sum_dollars(plain_number(F.col("amount"))).alias("total_amount"),
    )


def dedupe_bronze(bronze: DataFrame, max_copied: int = BROADCAST_ROWS) -> DataFrame:
    """Keep the latest load of every passage; of equal loads the one whose file name, then whose
    other columns, are smallest. A load without a time counts as the oldest, a missing file name
    or column as the smallest. Columns are text, as bronze holds them.

    Passages are counted by a digest of their keys first, a number a row in a hash aggregate. Rows of a
    digest of their own stay where they are; only those of the others, if they are ``max_copied`` digests at
    most, are sorted and shuffled (two passages that share a digest are told apart there). Beyond
    that all rows are.
    """
    keys = [F.coalesce(F.col(c), F.lit("")) for c in DEDUPE_KEYS] + [F.col(c).isNull() for c in DEDUPE_KEYS]
    digest = F.xxhash64(*keys)
    counts = bronze.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_loads"))
    copied = bounded(counts.filter("_loads > 1").select("_digest"), max_copied)
    if copied is None:
        return _latest_loads(bronze)
    if copied.isEmpty():
        return bronze
    same = digest == F.col("_digest")
    once = bronze.join(F.broadcast(copied), same, "left_anti")
    return once.unionByName(_latest_loads(bronze.join(F.broadcast(copied), same, "left_semi")))


def _latest_loads(bronze: DataFrame) -> DataFrame:
    """An aggregate, not a window: copies are combined before the shuffle, so a passage with very
    many copies is no hot key. Complemented digits make the latest load time the smallest text."""
    rest = [c for c in bronze.columns if c not in DEDUPE_KEYS]
    rest = ["source_file", *(c for c in rest if c != "source_file")]
    newest = F.coalesce(F.translate("loaded_at", "0123456789", "9876543210"), F.lit("~"))
    latest = bronze.groupBy(*DEDUPE_KEYS).agg(
        F.min(F.struct(newest.alias("_newest"), *rest)).alias("_latest")
    )
    return latest.select(*DEDUPE_KEYS, "_latest.*").select(*bronze.columns)
