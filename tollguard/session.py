"""The shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"tollguard-{application_id}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_dir(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


_scopes: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, within the innermost scope if there is one."""
    folder = _scopes[-1] if _scopes else f"{shared_dir(spark)}/tollguard/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` and ``scratch_path`` make inside are removed at the end.

    For steps whose results are written elsewhere before the scope ends.
    """
    folder = scratch_path(spark, "scope")
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.remove(folder)
        remove(spark, folder)


def remove_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; nothing may read them after."""
    remove(spark, f"{shared_dir(spark)}/tollguard/{spark.sparkContext.applicationId}")


def require_utc(spark: SparkSession) -> None:
    """Refuse a session time zone other than UTC, where wall times of statements would shift."""
    name = spark.conf.get("spark.sql.session.timeZone")
    dates = [datetime(2024, month, 1) for month in (1, 4, 7, 10)]
    try:
        zone = ZoneInfo(name)
        shifted = any(zone.utcoffset(d) for d in dates)
    except (ValueError, ZoneInfoNotFoundError):
        shifted = name not in ("Z", "+00:00", "UTC", "GMT")
    if shifted:
        raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {name}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table in the shared folder.

    Several readers then do not recompute ``df``, each reads only its columns, and a lost
    executor costs one read.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
