"""What has been loaded: a write-ahead table of loads, which batches and streams share.

A load is entered with its files as staged, writes its rows and rejected rows to hidden folders, and
is then entered as committed; only after that do its folders get their visible names. A load that
stops before its commit leaves nothing that a reader sees, and its files are new to the next load; one
that stops after it is published by the next load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.session import remove

STAGED, COMMITTED = "staged", "committed"
FILE_KEY = ["path", "length", "modified"]
SCHEMA = "load_id string, state string, path string, length long, modified timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(source):
        return
    if files.exists(target):  # an earlier publication that stopped halfway
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{old} could not be renamed to {new}")


def _folder(bronze: str) -> str:
    """Hidden from those who read ``bronze``, as all names with an underscore are."""
    return f"{bronze}/_ledger"


def staged_folder(table: str, load_id: str) -> str:
    return f"{table}/_staged-{load_id}"


def loaded_folder(table: str, load_id: str) -> str:
    return f"{table}/load_id={load_id}"


def read_ledger(spark: SparkSession, bronze: str) -> DataFrame:
    """All entries; none where nothing was loaded yet."""
    if not exists(spark, _folder(bronze)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(_folder(bronze))


def list_files(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(path, name, length, modified, place) of the files in ``source``, whose content is not read;
    ``place`` is the path as readers take it, ``path`` as they report it."""
    files = spark.read.format("binaryFile").load(source)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("path").alias("place"),
    )


def committed_files(entries: DataFrame) -> DataFrame:
    """(path, length, modified) of all files of committed loads."""
    done = entries.filter(F.col("state") == COMMITTED).select("load_id").distinct()
    return entries.filter(F.col("state") == STAGED).join(done, "load_id", "left_semi").select(*FILE_KEY)


def new_files(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of ``files`` that no committed load holds. A file that was written over is new."""
    return files.join(committed_files(entries), FILE_KEY, "left_anti")


def _enter(rows: DataFrame, bronze: str) -> None:
    rows.select("load_id", "state", *FILE_KEY).coalesce(1).write.mode("append").parquet(_folder(bronze))


def stage(files: DataFrame, bronze: str, load_id: str) -> None:
    _enter(files.select(F.lit(load_id).alias("load_id"), F.lit(STAGED).alias("state"), *FILE_KEY), bronze)


def commit(spark: SparkSession, bronze: str, load_id: str, rejects: str | None = None) -> None:
    """From here on the files of the load count as loaded; its rows become visible."""
    _enter(spark.createDataFrame([(load_id, COMMITTED, None, None, None)], SCHEMA), bronze)
    publish(spark, bronze, load_id, rejects)


def publish(spark: SparkSession, bronze: str, load_id: str, rejects: str | None = None) -> None:
    for table in (bronze, rejects) if rejects else (bronze,):
        _rename(spark, staged_folder(table, load_id), loaded_folder(table, load_id))


def is_committed(spark: SparkSession, bronze: str, name: str) -> bool:
    """Whether a load whose id is or begins with ``name`` was committed."""
    done = read_ledger(spark, bronze).filter(F.col("state") == COMMITTED)
    return not done.filter(F.startswith("load_id", F.lit(name))).isEmpty()


def recover(spark: SparkSession, bronze: str, rejects: str | None = None) -> None:
    """Publish committed loads that were stopped before that, and remove what others left behind.

    One load at a time writes a table, so a staged load that is not committed was stopped. Only loads
    whose staged folder is still there are looked at: one or none, as every load begins with this.
    """
    for table in (bronze, rejects) if rejects else (bronze,):
        if not exists(spark, table):
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(table)
        held = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
        names = [h.getPath().getName() for h in held]
        for load_id in (n.removeprefix("_staged-") for n in names if n.startswith("_staged-")):
            if is_committed(spark, bronze, load_id):
                _rename(spark, staged_folder(table, load_id), loaded_folder(table, load_id))
            else:
                remove(spark, staged_folder(table, load_id))


def adopt(files: DataFrame, bronze: str, load_id: str) -> None:
    """Enter files as loaded that reached ``bronze`` without a ledger."""
    stage(files, bronze, load_id)
    commit(files.sparkSession, bronze, load_id)
