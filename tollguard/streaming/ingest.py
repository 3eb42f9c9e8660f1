"""Incremental ingest: each new statement file reaches bronze exactly once."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollguard.sources import ledger
from tollguard.sources.load import write_load
from tollguard.sources.statements import CSV_OPTIONS, MAX_BAD_ROWS, statement_schema


def stream_statements(
    spark: SparkSession,
    source: str,
    bronze: str,
    checkpoint: str,
    loaded_at: str,
    rejects: str | None = None,
    max_bad_rows: int = MAX_BAD_ROWS,
    quoted_newlines: bool = True,
) -> StreamingQuery:
    """Load every statement file in ``source`` not loaded before, then stop.

    A batch is a load in the ledger of ``bronze``, named by checkpoint and batch number: files that a
    batch load or another stream has committed are left out, a batch that runs again writes its load
    over, or nothing if it was committed. Bad rows follow the batch load: more than ``max_bad_rows``
    of them stop the batch, and they go to ``rejects`` if that is given.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    rows = (
        spark.readStream.schema(statement_schema())
        .options(**CSV_OPTIONS | {"multiLine": quoted_newlines}).csv(source)
        .withColumns({
            "source_name": F.col("_metadata.file_name"), "path": F.col("_metadata.file_path"),
            "length": F.col("_metadata.file_size"), "modified": F.col("_metadata.file_modification_time"),
        })
    )

    def load(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"stream-{stream}-{number}-"
        ledger.recover(spark, bronze, rejects)
        if ledger.is_committed(spark, bronze, name):
            return
        load_id = name + uuid.uuid4().hex[:12]  # another for each attempt
        files = batch.select(*ledger.FILE_KEY).distinct()
        ledger.stage(ledger.new_files(files, ledger.read_ledger(spark, bronze)), bronze, load_id)
        taken = ledger.read_ledger(spark, bronze).filter(F.col("load_id") == load_id).select("path").distinct()
        fresh = batch.join(taken, "path", "left_semi").drop(*ledger.FILE_KEY)
        write_load(fresh, bronze, load_id, loaded_at, rejects, max_bad_rows, source)

    return (
        rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
