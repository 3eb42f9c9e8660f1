"""Travel features from the previous passage: time, speed, overlaps. Minutes truncate to zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road speeds in miles per hour.
REASONABLE_MPH = 88.0
FASTEST_MPH = 90.0
IMPOSSIBLE_MPH = 100.0
RAPID_MINUTES = 5

MINUTES = "travel_time_minutes"


def travel_time_minutes() -> Column:
    return F.timestamp_diff("MINUTE", F.col("exit_time_previous"), F.col("exit_time"))


def _mph(miles: Column, minutes: Column) -> Column:
    return F.try_divide(miles, minutes) * 60


def speed_mph() -> Column:
    miles, minutes = F.col("distance_miles"), F.col(MINUTES)
    return F.when(miles.isNotNull() & (minutes > 0), _mph(miles, minutes))


def min_required_travel_time_minutes() -> Column:
    miles = F.col("distance_miles")
    return F.when(miles > 0, miles / F.lit(REASONABLE_MPH) * 60)


def is_impossible_travel() -> Column:
    """NULL without distance or times; else out of order, below the fastest time, or too fast."""
    miles, minutes = F.col("distance_miles"), F.col(MINUTES)
    too_short = (miles > 0) & (minutes < miles / F.lit(FASTEST_MPH) * 60)
    too_fast = _mph(miles, minutes) >= IMPOSSIBLE_MPH
    return F.when(
        miles.isNotNull() & minutes.isNotNull(),
        (minutes <= 0) | too_short | F.coalesce(too_fast, F.lit(False)),
    )


def is_rapid_succession() -> Column:
    return F.col(MINUTES) < RAPID_MINUTES


def flag_overlapping_journey() -> Column:
    return F.coalesce(F.col("entry_time") < F.col("exit_time_previous"), F.lit(False))


def overlapping_journey_duration_minutes() -> Column:
    minutes = F.timestamp_diff("MINUTE", F.col("entry_time"), F.col("exit_time_previous"))
    return F.when(flag_overlapping_journey(), minutes).otherwise(F.lit(0).cast("bigint"))


def travel_time_category() -> Column:
    minutes = F.col(MINUTES)
    return (
        F.when(minutes < 0, "Invalid (Negative)")
        .when(minutes < 10, "Short (<10 min)")
        .when(minutes < 30, "Medium (10-30 min)")
        .when(minutes < 60, "Long (30-60 min)")
        .when(minutes.isNotNull(), "Very Long (60+ min)")
    )
