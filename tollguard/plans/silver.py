"""Bronze text to typed, enriched trips with driver history and route statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tollguard import lookups
from tollguard.functions import cleaning, money, travel, trip
from tollguard.operators.preceding import Lookback, add_lookback, in_pieces, plain, split_hot
from tollguard.operators.skew import HOT_ROWS, attach_small
from tollguard.schemas import SILVER_COLUMNS
from tollguard.session import materialize, require_utc

TAG = "tag_plate_number"
ROUTE_KEY = ["route_name", "vehicle_type_code"]
MIN_ROUTE_ROWS_FOR_MEDIAN = 30
ROLLING_ROWS = 30


# Cleaning -----------------------------------------------------------------------------------

UPPER_TEXT = [TAG, "agency", "entry_plaza", "exit_plaza"]
PLAIN_TEXT = ["description", "entry_lane", "exit_lane", "plan_rate", "prepaid", "fare_type"]


def filter_dated(bronze: DataFrame) -> DataFrame:
    """Rows with a date text; an unreadable text stays and becomes a NULL date later."""
    return bronze.filter(F.col("transaction_date").isNotNull())


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: cleaning.parse_date(c) for c in ("transaction_date", "posting_date")
    })


def parse_times_midnight_null(df: DataFrame) -> DataFrame:
    times = {c: cleaning.parse_time_midnight_null(c) for c in ("entry_time", "exit_time")}
    return df.withColumns(times | {"loaded_at": cleaning.parse_second("loaded_at")})


def clean_text(df: DataFrame) -> DataFrame:
    upper = {c: cleaning.clean_text(c, upper=True) for c in UPPER_TEXT}
    return df.withColumns(upper | {c: cleaning.clean_text(c) for c in PLAIN_TEXT})


def default_vehicle_code(df: DataFrame) -> DataFrame:
    code = F.coalesce(cleaning.clean_text("vehicle_type_code"), F.lit("1"))
    return df.withColumn("vehicle_type_code", code)


def clean_amount(df: DataFrame) -> DataFrame:
    """Tolls are charged as negative amounts; the balance keeps its sign."""
    return df.withColumns({
        "amount": F.abs(cleaning.parse_number("amount")),
        "balance": cleaning.parse_number("balance"),
    })


def clean(bronze: DataFrame) -> DataFrame:
    rows = filter_dated(bronze)
    for step in (
        parse_dates, parse_times_midnight_null, clean_text, default_vehicle_code, clean_amount
    ):
        rows = step(rows)
    return rows


# Enrichment ---------------------------------------------------------------------------------

def filter_tolls(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("description") == "TOLL")


def map_fare_type(df: DataFrame) -> DataFrame:
    return df.withColumn("fare_type", trip.fare_type_name())


def enrich_agency(df: DataFrame) -> DataFrame:
    """Agency name and state by a broadcast of the 23 known agencies; unknown ones get NULL."""
    return df.join(F.broadcast(lookups.agencies(df.sparkSession)), "agency", "left")


def enrich_plaza(df: DataFrame) -> DataFrame:
    """Entry and exit plaza names by two broadcasts of the 113 known plazas."""
    plazas = lookups.plazas(df.sparkSession)
    for side in ("entry", "exit"):
        named = plazas.toDF(f"{side}_plaza", f"{side}_plaza_name")
        df = df.join(F.broadcast(named), f"{side}_plaza", "left")
    return df


def enrich(tolls_: DataFrame) -> DataFrame:
    return enrich_plaza(enrich_agency(map_fare_type(tolls_)))


def tolls(bronze: DataFrame) -> DataFrame:
    """Bronze to one clean, identified row per toll passage: what driver history needs."""
    return filter_tolls(clean(bronze)).withColumn("transaction_id", trip.transaction_id())


def trip_features(enriched: DataFrame) -> DataFrame:
    """Everything that a single row tells."""
    return enriched.withColumns({
        "weekend_or_weekday": trip.weekend_or_weekday(),
        "flag_is_weekend": trip.is_weekend(),
        "travel_time_of_day": trip.travel_time_of_day(),
        "flag_rush_hour": trip.rush_hour(),
        "entry_hour": trip.hour("entry_time"),
        "exit_hour": trip.hour("exit_time"),
        "vehicle_type_name": trip.vehicle_type_name(),
        "flag_vehicle_type": trip.is_commercial(),
        "flag_outstate": trip.is_outstate(),
    })


def trips(bronze: DataFrame) -> DataFrame:
    """Toll passages with names and row-level features."""
    return trip_features(enrich(tolls(bronze)))


# Driver history -----------------------------------------------------------------------------

LAST_MOMENT = (1 << 63) - 1
PREVIOUS = ["entry_plaza", "exit_plaza", "entry_time", "exit_time"]


def _exit_position() -> Column:
    return F.coalesce(F.unix_micros("exit_time"), F.lit(LAST_MOMENT))


def _entry_position() -> Column:
    return F.unix_micros(F.coalesce("entry_time", F.lit("1900-01-01").cast("timestamp")))


def _previous_columns(window: WindowSpec) -> dict[str, Column]:
    return {f"{c}_previous": F.lag(c).over(window) for c in PREVIOUS}


def _rolling_columns(window: WindowSpec) -> dict[str, Column]:
    recent = window.rowsBetween(-ROLLING_ROWS, -1)
    amount, cents = F.col("amount"), money.cents(F.col("amount"))
    return {
        "_priced": F.count(amount).over(recent),
        "_cents": F.sum(cents).over(recent),
        "_squares": F.sum(cents * cents).over(recent),
        "driver_amount_last_30txn_min": F.min(amount).over(recent),
        "driver_amount_last_30txn_max": F.max(amount).over(recent),
        "driver_amount_last_30txn_count": F.count(F.lit(1)).over(recent),
    }


def _rolling_moments() -> dict[str, Column]:
    priced, cents, squares = F.col("_priced"), F.col("_cents"), F.col("_squares")
    return {
        "driver_amount_last_30txn_avg": money.mean_dollars(cents, priced),
        "driver_amount_last_30txn_std": money.sample_std_dollars(cents, squares, priced),
    }


PREVIOUS_TRIP = Lookback(_exit_position, 1, PREVIOUS, _previous_columns)
ROLLING = Lookback(
    _entry_position, ROLLING_ROWS, ["amount"], _rolling_columns, _rolling_moments
)


def previous_trip(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Plazas and times of the tag's previous passage by exit time, missing times last."""
    return add_lookback(df, TAG, PREVIOUS_TRIP, hot_rows)


def driver_rolling_30txn(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Amount statistics over the tag's 30 passages before this one by entry time."""
    return add_lookback(df, TAG, ROLLING, hot_rows)


def daily_txn_count_window(df: DataFrame) -> DataFrame:
    per_day = Window.partitionBy(TAG, "transaction_date")
    return df.withColumn("driver_daily_txn_count", F.count(F.lit(1)).over(per_day))


def driver_daily_txn_count(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Passages per tag and date, missing tag or date being a group of its own."""
    cold, hot, _ = split_hot(df, TAG, hot_rows)
    counted = daily_txn_count_window(cold)
    return counted if hot is None else counted.unionByName(_daily_txn_count_joined(hot))


def _daily_txn_count_joined(hot: DataFrame) -> DataFrame:
    per_day = hot.groupBy(TAG, "transaction_date").agg(
        F.count(F.lit(1)).alias("driver_daily_txn_count")
    )
    return attach_small(hot, per_day, [TAG, "transaction_date"], null_safe=True)


def driver_history(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Daily count, previous passage and rolling statistics.

    All three windows of ordinary tags share one shuffle on the tag; the one on tag and date
    comes last, because rows grouped by tag are grouped by both, but not the other way round.
    """
    cold, hot, _ = split_hot(df, TAG, hot_rows)
    done = daily_txn_count_window(plain(plain(cold, TAG, PREVIOUS_TRIP), TAG, ROLLING))
    if hot is None:
        return done
    # every step looks for edges in its input first, so its input is stored
    counted = materialize(_daily_txn_count_joined(materialize(hot)))
    previous = materialize(in_pieces(counted, TAG, PREVIOUS_TRIP, hot_rows))
    return done.unionByName(in_pieces(previous, TAG, ROLLING, hot_rows))


# Routes and travel --------------------------------------------------------------------------

def route_name(df: DataFrame) -> DataFrame:
    start = F.coalesce("exit_plaza_previous", F.lit("Unknown"))
    return df.withColumn("route_name", F.concat(start, F.lit(" to "), F.col("exit_plaza")))


def route_distance(df: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """Miles from the previous exit plaza to this one; NULL without a distance table.

    ``distances`` has ``origin_plaza, destination_plaza, miles``, one row per pair.
    """
    if distances is None:
        return df.withColumn("distance_miles", F.lit(None).cast("double"))
    miles = distances.select(
        F.col("origin_plaza").alias("exit_plaza_previous"),
        F.col("destination_plaza").alias("exit_plaza"),
        F.col("miles").cast("double").alias("distance_miles"),
    )
    return attach_small(df, miles, ["exit_plaza_previous", "exit_plaza"])


def route_instate(df: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """``In-state`` when both plazas are origins of the distance table, else ``Unknown``."""
    if distances is None:
        return df.withColumn("route_instate", F.lit("Unknown"))
    origins = distances.select(F.col("origin_plaza")).dropna().distinct()
    for column in ("exit_plaza_previous", "exit_plaza"):
        known = origins.select(
            F.col("origin_plaza").alias(column), F.lit(True).alias(f"_known_{column}")
        )
        df = attach_small(df, known, [column])
    both = (
        F.col("_known_exit_plaza_previous") & F.col("_known_exit_plaza")
        & (F.col("exit_plaza") != "Unknown") & (F.col("exit_plaza_previous") != "Unknown")
    )
    instate = F.when(both, "In-state").otherwise("Unknown")
    return df.withColumn("route_instate", instate).drop(
        "_known_exit_plaza_previous", "_known_exit_plaza"
    )


def travel_features(df: DataFrame) -> DataFrame:
    return df.withColumn("travel_time_minutes", travel.travel_time_minutes()).withColumns({
        "speed_mph": travel.speed_mph(),
        "min_required_travel_time_minutes": travel.min_required_travel_time_minutes(),
        "is_impossible_travel": travel.is_impossible_travel(),
        "is_rapid_succession": travel.is_rapid_succession(),
        "flag_overlapping_journey": travel.flag_overlapping_journey(),
        "overlapping_journey_duration_minutes": travel.overlapping_journey_duration_minutes(),
        "travel_time_category": travel.travel_time_category(),
    })


def route_stats(df: DataFrame) -> DataFrame:
    """Amount statistics per route and vehicle code, one row each.

    Equal amounts are counted first, combined map-side, so a hot route reaches its reducer as
    one row per distinct price. Moments are exact: whole cents in decimals.
    """
    prices = df.groupBy(*ROUTE_KEY, "amount").agg(F.count(F.lit(1)).alias("rows"))
    whole = "decimal(18,0)"
    cents = money.cents(F.col("amount")).try_cast(whole)
    rows = F.col("rows").cast(whole)
    moments = prices.groupBy(*ROUTE_KEY).agg(
        F.sum("rows").alias("route_transaction_count"),
        F.sum(F.when(F.col("amount").isNotNull(), rows)).alias("_n"),
        F.try_sum(F.try_multiply(cents, rows)).alias("_total"),
        F.try_sum(F.try_multiply(F.try_multiply(cents, cents), rows)).alias("_squares"),
        F.min("amount").alias("route_amount_min"),
        F.max("amount").alias("route_amount_max"),
        F.percentile("amount", F.lit(0.5), F.col("rows")).alias("_median"),
    )
    n, total = F.col("_n").cast("double"), F.col("_total")
    spread = F.try_subtract(F.try_multiply("_n", "_squares"), F.try_multiply(total, total))
    std = F.sqrt(F.try_divide(spread.cast("double"), n * (n - 1))) / F.lit(100.0)
    enough = F.col("route_transaction_count") >= MIN_ROUTE_ROWS_FOR_MEDIAN
    return moments.select(
        *ROUTE_KEY,
        money.mean_dollars(total.cast("double"), n).alias("route_amount_avg"),
        F.when(n > 1, std).alias("route_amount_std"),
        "route_amount_min",
        "route_amount_max",
        F.when(enough, F.col("_median")).alias("route_amount_med"),
        "route_transaction_count",
    )


def add_route_stats(df: DataFrame) -> DataFrame:
    """Route statistics on every row; a missing route or code is a group of its own."""
    return attach_small(df, route_stats(df), ROUTE_KEY, null_safe=True)


# Flags and table ----------------------------------------------------------------------------

def flag_is_holiday(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Whether the date is one of ``holidays.holiday_date``; never multiplies rows."""
    days = holidays.select(
        F.col("holiday_date").alias("transaction_date"), F.lit(True).alias("_holiday")
    ).dropna().distinct()
    found = attach_small(df, days, ["transaction_date"])
    return found.withColumn("flag_is_holiday", F.col("_holiday").isNotNull()).drop("_holiday")


def silver_select(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("loaded_at", "last_updated").select(*SILVER_COLUMNS)


def routes(
    df: DataFrame, distances: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Toll passages with driver history, route and travel features."""
    named = route_name(driver_history(df, hot_rows))
    return travel_features(route_instate(route_distance(named, distances), distances))


#: Columns of silver that are not in the stored history, and what they are made of there.
ROUTE_STATS = {f"route_amount_{s}" for s in ("avg", "std", "min", "max", "med")} | {"route_transaction_count"}
MADE_OF = {c: [*ROUTE_KEY, "amount"] for c in ROUTE_STATS} | {
    "last_updated": ["loaded_at"],
    "agency_name": ["agency"],
    "state_name": ["agency"],
    "flag_outstate": ["agency"],
    "entry_plaza_name": ["entry_plaza"],
    "exit_plaza_name": ["exit_plaza"],
    "weekend_or_weekday": ["transaction_date"],
    "flag_is_weekend": ["transaction_date"],
    "flag_is_holiday": ["transaction_date"],
    "travel_time_of_day": ["entry_time", "exit_time"],
    "flag_rush_hour": ["entry_time", "exit_time"],
    "entry_hour": ["entry_time"],
    "exit_hour": ["exit_time"],
    "vehicle_type_name": ["vehicle_type_code"],
    "flag_vehicle_type": ["vehicle_type_code"],
}


def _stored(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The history with what ``columns`` of silver are made of stored, and NULL for all else."""
    needed = {source for c in columns for source in MADE_OF.get(c, [c])}
    rows = materialize(history.select(*[c for c in history.columns if c in needed]))
    return rows.select(*[
        F.col(f.name) if f.name in needed else F.lit(None).cast(f.dataType).alias(f.name) for f in history.schema
    ])


def silver(
    bronze: DataFrame,
    holidays: DataFrame,
    distances: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The silver table from bronze text, or these ``columns`` of all of its rows.

    Names and row-level features are added after the windows, so the shuffle on the tag and the
    passes that look for hot tags and count routes carry only what they need. The history is
    stored once; its routes are counted and joined from there, so bronze is read twice (once for
    the tags' sizes), and a third time only if there are hot tags. Of the history only what
    ``columns`` are made of is cleaned, shuffled and stored.
    """
    require_utc(bronze.sparkSession)
    columns = list(columns or SILVER_COLUMNS)
    rows = _stored(routes(tolls(bronze), distances, hot_rows), columns)
    if ROUTE_STATS.intersection(columns):
        rows = add_route_stats(rows)
    rows = flag_is_holiday(trip_features(enrich(rows)), holidays)
    return rows.withColumnRenamed("loaded_at", "last_updated").select(*columns)
