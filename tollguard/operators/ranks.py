"""Exact global ranks without a single-task sort.

Equal values are counted first. The distinct values are partitioned into ranges by Spark's sampled
splitters, as many as their number asks for, counted per range, and ranked inside their range from
the count of all ranges below.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollguard.session import materialize

RANGE_ROWS = 5_000_000


@dataclass(frozen=True)
class Ranking:
    """``table`` has one row per distinct value: ``value, rows, rows_below`` (NULL ranks first)."""

    table: DataFrame
    total: int
    nulls: int

    def at_ranks(self, ranks: list[int]) -> list[float | None]:
        """The non-null values at zero-based ``ranks``."""
        end = F.col("rows_below") - self.nulls + F.col("rows")
        picks = [
            F.min(F.when(end > rank, F.col("value"))).alias(f"r{i}") for i, rank in enumerate(ranks)
        ]
        return list(self.table.agg(*picks).first())

    def percentiles(self, percents: list[int]) -> list[float | None]:
        """Smallest value with at least that share of the non-null rows at or below it."""
        present = self.total - self.nulls
        return self.at_ranks([max(-(-percent * present // 100) - 1, 0) for percent in percents])

    def interpolated(self, fraction: float) -> float | None:
        """The quantile by linear interpolation between neighbours."""
        present = self.total - self.nulls
        if not present:
            return None
        place = fraction * (present - 1)
        low, high = self.at_ranks([int(place), min(int(place) + 1, present - 1)])
        return low + (high - low) * (place - int(place))


def rank_values(df: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> Ranking:
    """Count and rank the distinct values of a numeric ``column``."""
    counts = materialize(
        df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    )
    shape = counts.agg(
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
    ).first()
    pieces = -(-shape["distinct"] // range_rows)
    if pieces > 1:
        placed = counts.repartitionByRange(pieces, F.asc_nulls_first("value"))
        ranged = materialize(placed.withColumn("_range", F.spark_partition_id()))
        # one row per range, and a range holds about range_rows values
        sizes = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.sum("rows")).collect())
        starts = accumulate((n for _, n in sizes), initial=0)
        before = df.sparkSession.createDataFrame(
            [(part, start) for (part, _), start in zip(sizes, starts)], "_range int, _start bigint"
        )
        ranged = ranged.join(F.broadcast(before), "_range")
    else:
        ranged = counts.withColumns({"_range": F.lit(0), "_start": F.lit(0).cast("bigint")})
    below = Window.partitionBy("_range").orderBy(F.asc_nulls_first("value")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows_below = F.col("_start") + F.coalesce(F.sum("rows").over(below), F.lit(0).cast("bigint"))
    table = ranged.withColumn("rows_below", rows_below).select("value", "rows", "rows_below")
    return Ranking(table, shape["total"], shape["nulls"])
