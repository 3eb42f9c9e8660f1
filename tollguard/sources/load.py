"""The statement load as one step: detect new files, read, normalise, commit, verify."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tollguard.schemas import RAW_COLUMNS
from tollguard.session import scratch_scope
from tollguard.sources import bronze as bronze_table
from tollguard.sources import ledger, statements


def write_load(
    rows: DataFrame,
    bronze: str,
    load_id: str,
    loaded_at: str,
    rejects: str | None,
    max_bad_rows: int,
    source: str | Sequence[str],
    headers: Sequence[str] = RAW_COLUMNS,
) -> None:
    """Write the rows of a staged load and commit it.

    Bad rows are counted while the good ones are written; more than ``max_bad_rows`` of them stop the
    load before its commit. Only if there are some are the statements read again, for the rejects.
    """
    spark, bad = rows.sparkSession, statements.is_bad_row(headers)
    counted = Observation()
    seen = rows.observe(counted, F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"))
    good = statements.normalize(seen.filter(~bad), loaded_at)
    bronze_table.bronze_columns(good).write.mode("overwrite").parquet(ledger.staged_folder(bronze, load_id))
    found = counted.get["bad"]
    if found > max_bad_rows:
        raise ValueError(f"{found} bad rows in {source}, allowed are {max_bad_rows}")
    if found and rejects:
        rejected = statements.rejected(rows.filter(bad), loaded_at, headers)
        rejected.write.mode("overwrite").parquet(ledger.staged_folder(rejects, load_id))
    ledger.commit(spark, bronze, load_id, rejects)


def load_statements(
    spark: SparkSession,
    source: str | list[str],
    bronze: str,
    rejects: str,
    loaded_at: str,
    max_bad_rows: int = statements.MAX_BAD_ROWS,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """Load the files of ``source`` that the ledger of ``bronze`` does not hold, and return
    ``verify_load`` of bronze.

    A file is known by its path, length and time of change, so files of one name in two folders are
    two, one without a good row is loaded once, and what a stream has loaded is not loaded again.
    Rows and rejects become visible by the commit, together. More than ``max_bad_rows`` bad rows stop
    the load before it. Running it again without new files loads nothing.
    """
    ledger.recover(spark, bronze, rejects)
    files = ledger.new_files(ledger.list_files(spark, source), ledger.read_ledger(spark, bronze))
    with scratch_scope(spark):
        paths = sorted(r["place"] for r in files.select("place").toLocalIterator())
        if paths:
            load_id = uuid.uuid4().hex
            ledger.stage(files, bronze, load_id)
            headers = spark.read.option("header", True).csv(paths).columns
            rows = statements.scan_statements(spark, paths, headers, quoted_newlines)
            write_load(rows, bronze, load_id, loaded_at, rejects, max_bad_rows, source, headers)
    return bronze_table.verify_load(bronze_table.read_bronze(spark, bronze))
