"""Row-level trip features: identity, calendar, time of day, vehicle and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollguard import lookups
from tollguard.functions.money import cents

# Last hour of each band and its label; later hours and NULL are "Late Night".
HOUR_BANDS = [
    (5, "Night"),
    (8, "Morning Rush"),
    (11, "Morning"),
    (14, "Midday"),
    (18, "Evening Rush"),
    (21, "Evening"),
]
REST_OF_DAY = "Late Night"


def transaction_id() -> Column:
    """Hex MD5 over seven fields; NULL reads ``NULL``, amount is whole cents."""
    fields = [
        F.col("transaction_date").cast("string"),
        F.col("entry_time").cast("string"),
        F.col("exit_time").cast("string"),
        F.col("tag_plate_number"),
        F.col("entry_plaza"),
        F.col("exit_plaza"),
        cents(F.col("amount")).try_cast("bigint").cast("string"),
    ]
    return F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("NULL")) for f in fields]))


def hour(column: str) -> Column:
    return F.hour(column).cast("bigint")


def time_of_day(column: str) -> Column:
    bands = reduce(
        lambda case, band: case.when(F.hour(column) <= band[0], band[1]),
        HOUR_BANDS[1:],
        F.when(F.hour(column) <= HOUR_BANDS[0][0], HOUR_BANDS[0][1]),
    )
    return bands.otherwise(REST_OF_DAY)


def travel_time_of_day() -> Column:
    return F.concat(time_of_day("entry_time"), F.lit(" to "), time_of_day("exit_time"))


def rush_hour() -> Column:
    labels = [time_of_day("entry_time"), time_of_day("exit_time")]
    return reduce(Column.__or__, [label.endswith("Rush") for label in labels])


def is_weekend() -> Column:
    """Saturday or Sunday; a missing date counts as a weekday."""
    return F.coalesce(F.dayofweek("transaction_date").isin(1, 7), F.lit(False))


def weekend_or_weekday() -> Column:
    return F.when(is_weekend(), "Weekend").otherwise("Weekday")


def vehicle_type_name() -> Column:
    code = F.col("vehicle_type_code")
    return (
        F.when(code.isin(lookups.PASSENGER_CODES), "Passenger Vehicle")
        .when(code.isin(lookups.LIGHT_COMMERCIAL_CODES), "Light Commercial")
        .when(code.isin(lookups.HEAVY_COMMERCIAL_CODES), "Heavy Commercial")
        .otherwise("Unknown")
    )


def is_commercial() -> Column:
    return vehicle_type_name().endswith("Commercial")


def is_outstate() -> Column:
    """Any state but NJ, an unknown one included."""
    return ~F.col("state_name").eqNullSafe("NJ")


def fare_type_name() -> Column:
    fare = F.col("fare_type")
    return F.when(fare == "N", "Normal").when(fare == "M", "Medium").otherwise(fare)
