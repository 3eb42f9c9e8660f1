"""Hot keys and checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[Row]:
    """Keys (NULL included) holding more than ``hot_rows`` rows.

    One pass over the key column, combined map-side. At most rows / hot_rows keys can qualify,
    which bounds what reaches the driver.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > hot_rows).collect()


def matching(left: DataFrame, names: dict[str, str], null_safe: bool) -> Column:
    """Join condition from left column names to right column names."""
    pairs = [(left[a], F.col(b)) for a, b in names.items()]
    tests = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return reduce(Column.__and__, tests)


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``max_rows`` rows, else None."""
    rows = df.limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, df.schema)


def _left_join(
    df: DataFrame, table: DataFrame, on: Sequence[str], null_safe: bool, hint: bool = False
) -> DataFrame:
    keys = {name: f"_key_{name}" for name in on}
    right = table.withColumnsRenamed(keys)
    if hint:
        right = F.broadcast(right)
    return df.join(right, matching(df, keys, null_safe), "left").drop(*keys.values())


def attach(
    df: DataFrame, table: DataFrame, on: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Left-join a per-key ``table`` (unique on ``on``) that grows with the data.

    No hint and no check: adaptive execution sees the real size of ``table`` after its shuffle,
    broadcasts it if small, and splits the partitions of hot keys if not.
    """
    return _left_join(df, table, on, null_safe)


def attach_small(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    null_safe: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join a per-key ``table`` that should be small, such as codes or routes.

    Its rows are counted first. Up to ``max_rows`` it is broadcast, so ``df``, however large, is
    not shuffled at all; beyond that it is joined as in :func:`attach`.
    """
    small = bounded(table, max_rows)
    if small is None:
        return _left_join(df, table, on, null_safe)
    return _left_join(df, small, on, null_safe, hint=True)
