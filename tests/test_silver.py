from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard import lookups
from tollguard.functions import travel, trip
from tollguard.plans import silver
from tollguard.schemas import BRONZE_COLUMNS, BRONZE_SCHEMA

BASE = {
    "posting_date": "2024-01-08", "transaction_date": "2024-01-06", "tag_plate_number": " t1 ",
    "agency": "gsp", "description": " TOLL ", "entry_time": "2024-01-06 06:00:00",
    "entry_plaza": "pvk", "entry_lane": "-", "exit_time": "2024-01-06 06:30:00",
    "exit_plaza": "BER", "exit_lane": " 2 ", "vehicle_type_code": "-", "amount": "-4.50",
    "prepaid": "Y", "plan_rate": "-", "fare_type": "N", "balance": "-1.50",
    "loaded_at": "2024-02-01 00:00:00", "source_file": "a.csv",
}


def bronze(spark, *changes):
    data = [tuple((BASE | c)[name] for name in BRONZE_COLUMNS) for c in changes]
    return spark.createDataFrame(data, BRONZE_SCHEMA)


def one(spark, expression, **columns):
    types = {str: "string", int: "bigint", float: "double", bool: "boolean", datetime: "timestamp"}
    df = spark.range(1).select(*[
        F.lit(v[1] if isinstance(v, tuple) else v).cast(
            v[0] if isinstance(v, tuple) else types[type(v)]
        ).alias(k) for k, v in columns.items()
    ])
    return df.select(expression).first()[0]


def test_clean_row(spark):
    row = silver.clean(bronze(spark, {})).first()
    assert (row["tag_plate_number"], row["agency"], row["entry_plaza"]) == ("T1", "GSP", "PVK")
    assert (row["description"], row["entry_lane"], row["exit_lane"]) == ("TOLL", None, "2")
    assert (row["vehicle_type_code"], row["plan_rate"]) == ("1", None)
    assert (row["amount"], row["balance"]) == (4.5, -1.5)


def test_clean_never_raises_on_bad_text(spark):
    junk = {c: "??" for c in BRONZE_COLUMNS}
    row = silver.clean(bronze(spark, junk)).first()
    assert [row[c] for c in ("transaction_date", "posting_date", "entry_time", "amount")] == [None] * 4


def test_unreadable_dates_survive_but_missing_ones_do_not(spark):
    cleaned = silver.clean(bronze(spark, {"transaction_date": "junk"}, {"transaction_date": None}))
    assert rows(cleaned.select("transaction_date")) == [(None,)]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-06 00:00:00", None), ("2024-01-06 00:00:01", datetime(2024, 1, 6, 0, 0, 1)),
    ("-", None), ("2024-01-06", None), ("2024-02-30 10:00:00", None),
])
def test_midnight_is_a_placeholder(spark, text, expected):
    assert silver.clean(bronze(spark, {"exit_time": text})).first()["exit_time"] == expected


def test_only_tolls_by_exact_case(spark):
    df = silver.clean(bronze(spark, {}, {"description": "toll"}, {"description": "-"}))
    assert silver.filter_tolls(df).count() == 1


def test_enrichment_and_unknown_codes(spark):
    df = silver.trips(bronze(spark, {}, {"agency": "nysta", "entry_plaza": "zz", "fare_type": "Q"}))
    got = rows(df.select("agency_name", "state_name", "entry_plaza_name", "exit_plaza_name", "fare_type"))
    assert got == [
        ("Garden State Parkway", "NJ", "Pascack Valley", "Bergen", "Normal"),
        ("New York State Bridge Authority", "NY", None, "Bergen", "Q"),
    ]


def test_lookups_are_unique_keys():
    assert len({code for code, _, _ in lookups.AGENCIES}) == len(lookups.AGENCIES) == 23
    assert len({code for code, _ in lookups.PLAZAS}) == len(lookups.PLAZAS) == 113


def test_transaction_id_is_stable_and_spells_null(spark):
    import hashlib
    text = "2024-01-06|2024-01-06 06:00:00|NULL|T1|PVK|BER|450"
    row = silver.trips(bronze(spark, {"exit_time": "-"})).first()
    assert row["transaction_id"] == hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("hour, band", [
    (0, "Night"), (5, "Night"), (6, "Morning Rush"), (8, "Morning Rush"), (9, "Morning"),
    (11, "Morning"), (12, "Midday"), (14, "Midday"), (15, "Evening Rush"), (18, "Evening Rush"),
    (19, "Evening"), (21, "Evening"), (22, "Late Night"), (23, "Late Night"), (None, "Late Night"),
])
def test_hour_bands(spark, hour, band):
    time = ("timestamp", None if hour is None else f"2024-01-06 {hour:02d}:59:59")
    assert one(spark, trip.time_of_day("t"), t=time) == band


@pytest.mark.parametrize("entry, exit, rush", [
    ("05:59:59", "09:00:00", False), ("06:00:00", "09:00:00", True), ("05:00:00", "18:59:59", True),
    (None, "08:00:00", True), (None, None, False),
])
def test_rush_hour(spark, entry, exit, rush):
    at = lambda t: ("timestamp", t and f"2024-01-06 {t}")
    assert one(spark, trip.rush_hour(), entry_time=at(entry), exit_time=at(exit)) is rush


@pytest.mark.parametrize("date, weekend", [
    ("2024-01-05", False), ("2024-01-06", True), ("2024-01-07", True), ("2024-01-08", False),
    (None, False),
])
def test_weekend(spark, date, weekend):
    assert one(spark, trip.is_weekend(), transaction_date=("date", date)) is weekend


@pytest.mark.parametrize("code, name, flag", [
    ("2H", "Passenger Vehicle", False), ("B3", "Light Commercial", True),
    ("7H", "Heavy Commercial", True), ("X", "Unknown", False), (None, "Unknown", False),
])
def test_vehicle(spark, code, name, flag):
    value = ("string", code)
    assert one(spark, trip.vehicle_type_name(), vehicle_type_code=value) == name
    assert one(spark, trip.is_commercial(), vehicle_type_code=value) is flag


@pytest.mark.parametrize("state, out", [("NJ", False), ("NY", True), (None, True)])
def test_outstate(spark, state, out):
    assert one(spark, trip.is_outstate(), state_name=("string", state)) is out


@pytest.mark.parametrize("seconds, minutes, category, rapid", [
    (59, 0, "Short (<10 min)", True), (-59, 0, "Short (<10 min)", True),
    (-60, -1, "Invalid (Negative)", True), (299, 4, "Short (<10 min)", True),
    (300, 5, "Short (<10 min)", False), (600, 10, "Medium (10-30 min)", False),
    (1800, 30, "Long (30-60 min)", False), (3600, 60, "Very Long (60+ min)", False),
])
def test_travel_minutes_truncate(spark, seconds, minutes, category, rapid):
    df = spark.sql(f"""SELECT timestamp'2024-01-06 10:00:00' AS exit_time_previous,
        timestamp'2024-01-06 10:00:00' + make_interval(0,0,0,0,0,0,{seconds}) AS exit_time""")
    df = df.withColumn("travel_time_minutes", travel.travel_time_minutes())
    got = df.select("travel_time_minutes", travel.travel_time_category(), travel.is_rapid_succession())
    assert tuple(got.first()) == (minutes, category, rapid)


@pytest.mark.parametrize("miles, minutes, impossible", [
    (None, 10, None), (10.0, None, None), (10.0, 0, True), (0.0, -1, True), (0.0, 1, False),
    (15.0, 9, True), (15.0, 10, False), (9.0, 6, False), (90.0, 60, False), (91.0, 60, True),
])
def test_impossible_travel(spark, miles, minutes, impossible):
    got = one(
        spark, travel.is_impossible_travel(),
        distance_miles=("double", miles), travel_time_minutes=("bigint", minutes),
    )
    assert got is impossible


def test_speed_and_required_time(spark):
    columns = {"distance_miles": ("double", 44.0), "travel_time_minutes": ("bigint", 30)}
    assert one(spark, travel.speed_mph(), **columns) == 88.0
    assert one(spark, travel.min_required_travel_time_minutes(), **columns) == 30.0
    columns["travel_time_minutes"] = ("bigint", 0)
    assert one(spark, travel.speed_mph(), **columns) is None


@pytest.mark.parametrize("entry, overlap, minutes", [
    ("09:30:30", True, 29), ("10:00:00", False, 0), (None, False, 0),
])
def test_overlap(spark, entry, overlap, minutes):
    columns = {
        "entry_time": ("timestamp", entry and f"2024-01-06 {entry}"),
        "exit_time_previous": ("timestamp", "2024-01-06 10:00:00"),
    }
    assert one(spark, travel.flag_overlapping_journey(), **columns) is overlap
    assert one(spark, travel.overlapping_journey_duration_minutes(), **columns) == minutes


def test_holidays_do_not_multiply_rows(spark):
    days = spark.createDataFrame([("2024-01-06",), ("2024-01-06",), (None,)], "d string").select(
        F.col("d").cast("date").alias("holiday_date")
    )
    df = silver.trips(bronze(spark, {}, {"transaction_date": "2024-01-07"}, {"transaction_date": "x"}))
    got = silver.flag_is_holiday(df, days)
    assert rows(got.select("transaction_date", "flag_is_holiday").withColumn(
        "transaction_date", F.col("transaction_date").cast("string")
    )) == [(None, False), ("2024-01-06", True), ("2024-01-07", False)]


def routes(spark, counts):
    data = [
        (route, "1", amount)
        for route, amounts in counts.items() for amount in amounts
    ]
    return spark.createDataFrame(data, "route_name string, vehicle_type_code string, amount double")


def test_route_median_needs_30_rows(spark):
    df = routes(spark, {"a": [float(i) for i in range(29)], "b": [float(i) for i in range(30)]})
    got = {r["route_name"]: r for r in silver.route_stats(df).collect()}
    assert (got["a"]["route_transaction_count"], got["a"]["route_amount_med"]) == (29, None)
    assert (got["b"]["route_transaction_count"], got["b"]["route_amount_med"]) == (30, 14.5)


def test_route_stats_on_constant_null_and_single_amounts(spark):
    df = routes(spark, {"same": [2.35] * 40, "one": [1.0], None: [3.0, None], "none": [None]})
    got = {r["route_name"]: r for r in silver.route_stats(df).collect()}
    assert (got["same"]["route_amount_avg"], got["same"]["route_amount_std"]) == (2.35, 0.0)
    assert got["one"]["route_amount_std"] is None
    assert (got[None]["route_transaction_count"], got[None]["route_amount_avg"]) == (2, 3.0)
    assert got["none"]["route_amount_avg"] is None


def test_missing_route_is_a_group_of_its_own(spark):
    got = silver.add_route_stats(routes(spark, {None: [1.0, 3.0], "a": [5.0]}))
    assert rows(got.select("route_name", "route_amount_avg", "route_transaction_count")) == [
        (None, 2.0, 2), (None, 2.0, 2), ("a", 5.0, 1),
    ]


def test_instate_needs_both_origins(spark):
    lookup = spark.createDataFrame(
        [("A", "B", 5.0), ("B", "A", 5.0)], "origin_plaza string, destination_plaza string, miles double"
    )
    df = spark.createDataFrame(
        [("A", "B"), ("A", "C"), (None, "A"), ("A", None)], "exit_plaza_previous string, exit_plaza string"
    )
    got = silver.route_instate(silver.route_distance(df, lookup), lookup)
    assert rows(got.select("exit_plaza_previous", "exit_plaza", "distance_miles", "route_instate")) == [
        (None, "A", None, "Unknown"), ("A", None, None, "Unknown"), ("A", "B", 5.0, "In-state"),
        ("A", "C", None, "Unknown"),
    ]
    off = silver.route_instate(silver.route_distance(df)).first()
    assert (off["distance_miles"], off["route_instate"]) == (None, "Unknown")


def test_silver_keeps_every_toll(spark):
    holidays = spark.createDataFrame([], "holiday_date date")
    changes = [{"tag_plate_number": t, "entry_lane": str(i)} for i in range(40) for t in ("a", "-")]
    got = silver.silver(bronze(spark, *changes), holidays)
    assert got.count() == 80
    assert got.filter("tag_plate_number is null").first()["driver_daily_txn_count"] == 40
