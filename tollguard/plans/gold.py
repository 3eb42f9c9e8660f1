"""Silver to gold: driver and route outliers, spend spikes and the rule-based score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollguard.functions import money
from tollguard.operators.skew import attach
from tollguard.schemas import GOLD_COLUMNS, GOLD_RULEBASED_COLUMNS, SILVER_COLUMNS

TAG, DAY = "tag_plate_number", "transaction_date"
SPEND_DAYS = 30

# Outlier limits and score weights.
OUTLIER_Z = 1
UNUSUAL_DEVIATION = 80
SPIKE_FACTOR = 3
SPIKE_MIN_AMOUNT = 50
SCORE_WEIGHTS = {
    "flag_driver_amount_outlier": 80,
    "flag_route_amount_outlier": 10,
    "flag_amount_unusually_high": 5,
    "flag_driver_spend_spike": 5,
}


def driver_amount_median(silver: DataFrame) -> DataFrame:
    """All-time median amount per tag: the middle amount in order, of two middles the smaller.

    Exact at every size. Amounts are counted per tag and price first, combined map-side, so a hot
    tag arrives at its window as one row per price.
    """
    prices = silver.groupBy(TAG, "amount").agg(F.count("amount").alias("_n"))
    upto = Window.partitionBy(TAG).orderBy("amount").rowsBetween(Window.unboundedPreceding, 0)
    prices = prices.withColumns({
        "_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(TAG)),
    })
    reached = (F.col("_n") > 0) & (2 * F.col("_upto") >= F.col("_all"))
    return prices.groupBy(TAG).agg(F.min(F.when(reached, F.col("amount"))).alias("driver_amount_median"))


def driver_median_join(silver: DataFrame) -> DataFrame:
    """The tag's median on every row; a missing tag gets none."""
    return attach(silver, driver_amount_median(silver), [TAG])


def daily_spend(silver: DataFrame) -> DataFrame:
    spend = money.sum_dollars(F.col("amount"))
    return silver.groupBy(TAG, DAY).agg(spend.alias("driver_today_spend"))


def daily_spend_30d_avg(daily: DataFrame) -> DataFrame:
    """Mean daily spend over the 30 days before; days without spend do not count as zero.

    The window runs over one row per tag and date, so even a hot tag is only as long as the
    calendar.
    """
    recent = (
        Window.partitionBy(TAG).orderBy(F.unix_date(DAY)).rangeBetween(-SPEND_DAYS, -1)
    )
    spend = F.col("driver_today_spend")
    mean = money.mean_dollars(
        F.sum(money.cents(spend)).over(recent), F.count(spend).over(recent)
    )
    return daily.withColumn("driver_avg_daily_spend_30d", mean)


def daily_spend_join(silver: DataFrame) -> DataFrame:
    """Spend of the day and its 30-day mean on every row with a tag and a date."""
    return attach(silver, daily_spend_30d_avg(daily_spend(silver)), [TAG, DAY])


def driver_spending(silver: DataFrame) -> DataFrame:
    """Median, daily spend and 30-day mean in one join on tag and date.

    The median is put on the per-day table first (both are grouped by tag already), so the
    transactions are shuffled once instead of twice.
    """
    days = daily_spend_30d_avg(daily_spend(silver))
    medians = driver_amount_median(silver).withColumnRenamed(TAG, "_tag")
    table = days.join(medians, days[TAG] == medians["_tag"], "left").drop("_tag")
    known = F.col(TAG).isNotNull() & F.col(DAY).isNotNull()
    table = table.withColumns({c: F.when(known, F.col(c)) for c in SPENDS})
    return attach(silver, table, [TAG, DAY], null_safe=True)


def _relative(value: str, base: str, scale: str | None = None) -> Column:
    return F.try_divide(F.col(value) - F.col(base), F.nullif(F.col(scale or base), F.lit(0.0)))


def driver_amount_modified_z_score() -> Column:
    return _relative("amount", "driver_amount_median", "driver_amount_last_30txn_std")


def amount_deviation_from_avg_pct() -> Column:
    return _relative("amount", "driver_amount_last_30txn_avg") * 100


def amount_deviation_from_median_pct() -> Column:
    """A ratio, unlike its neighbour: not times 100."""
    return _relative("amount", "driver_amount_median")


def route_amount_z_score() -> Column:
    return _relative("amount", "route_amount_avg", "route_amount_std")


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def flag_driver_amount_outlier() -> Column:
    return _true(F.col("driver_amount_modified_z_score") > OUTLIER_Z)


def flag_route_amount_outlier() -> Column:
    return _true(F.abs(F.col("route_amount_z_score")) > OUTLIER_Z)


def flag_amount_unusually_high() -> Column:
    above = [
        _true(F.col(c) > UNUSUAL_DEVIATION)
        for c in ("amount_deviation_from_avg_pct", "amount_deviation_from_median_pct")
    ]
    return above[0] | above[1]


def flag_driver_spend_spike() -> Column:
    """A day far above the 30-day mean, or equal to the largest recent toll."""
    today, mean = F.col("driver_today_spend"), F.col("driver_avg_daily_spend_30d")
    tripled = _true(today > SPIKE_FACTOR * mean)
    largest = _true(today == F.col("driver_amount_last_30txn_max"))
    return mean.isNotNull() & (tripled | largest) & _true(F.col("amount") >= SPIKE_MIN_AMOUNT)


def anomaly_score() -> Column:
    points = [F.when(F.col(f), w).otherwise(0) for f, w in SCORE_WEIGHTS.items()]
    return sum(points[1:], points[0]).cast("bigint")


DEVIATIONS = {
    "driver_amount_modified_z_score": driver_amount_modified_z_score,
    "amount_deviation_from_avg_pct": amount_deviation_from_avg_pct,
    "amount_deviation_from_median_pct": amount_deviation_from_median_pct,
    "route_amount_z_score": route_amount_z_score,
}
RULE_FLAGS = {
    "flag_driver_amount_outlier": flag_driver_amount_outlier,
    "flag_route_amount_outlier": flag_route_amount_outlier,
    "flag_amount_unusually_high": flag_amount_unusually_high,
    "flag_driver_spend_spike": flag_driver_spend_spike,
}
SPENDS = ["driver_today_spend", "driver_avg_daily_spend_30d"]

#: What gold's own columns are made of, in silver and of each other.
MADE_OF = {
    "driver_amount_median": [TAG, "amount"],
    "driver_today_spend": [TAG, DAY, "amount"],
    "driver_avg_daily_spend_30d": [TAG, DAY, "amount"],
    "driver_amount_modified_z_score": ["amount", "driver_amount_median", "driver_amount_last_30txn_std"],
    "amount_deviation_from_avg_pct": ["amount", "driver_amount_last_30txn_avg"],
    "amount_deviation_from_median_pct": ["amount", "driver_amount_median"],
    "route_amount_z_score": ["amount", "route_amount_avg", "route_amount_std"],
    "flag_driver_amount_outlier": ["driver_amount_modified_z_score"],
    "flag_route_amount_outlier": ["route_amount_z_score"],
    "flag_amount_unusually_high": ["amount_deviation_from_avg_pct", "amount_deviation_from_median_pct"],
    "flag_driver_spend_spike": [*SPENDS, "driver_amount_last_30txn_max", "amount"],
    "anomaly_score": list(SCORE_WEIGHTS),
}


def gold_select(df: DataFrame) -> DataFrame:
    return df.select(*GOLD_COLUMNS)


def _needed(columns: Sequence[str]) -> list[str]:
    """These columns and all that they are made of."""
    found = list(dict.fromkeys(columns))
    for column in found:  # grows while it is read
        found += [c for c in MADE_OF.get(column, []) if c not in found]
    return found


def silver_inputs(columns: Sequence[str]) -> list[str]:
    """The columns of silver that these columns of gold are made of."""
    return [c for c in _needed(columns) if c in SILVER_COLUMNS]


def gold(silver: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The gold table from silver, or these ``columns`` of all of its rows, which take only their
    ``silver_inputs`` and the joins and formulas that they are made of."""
    needed = set(_needed(columns or GOLD_COLUMNS))
    rows = silver
    if needed.intersection(SPENDS):
        rows = driver_spending(rows)
    elif "driver_amount_median" in needed:
        rows = driver_median_join(rows)
    for formulas in (DEVIATIONS, RULE_FLAGS, {"anomaly_score": anomaly_score}):
        rows = rows.withColumns({c: formula() for c, formula in formulas.items() if c in needed})
    return rows.select(*columns) if columns else gold_select(rows)


def gold_rulebased(gold_table: DataFrame) -> DataFrame:
    return gold_table.select(*GOLD_RULEBASED_COLUMNS)
