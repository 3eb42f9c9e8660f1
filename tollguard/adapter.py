"""Given test tables as toll data: ``events`` as statements, bronze rows and status requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.schemas import BRONZE_COLUMNS, RAW_COLUMNS

AGENCY_CYCLE = ["GSP", "NJTP", "SJ", "PTC", "PANYNJ", "XX"]
PLAZA_CYCLE = ["PVK", "BER", "UNI", "14C", "18W", "APL", "ZZZ"]
VEHICLE_CYCLE = ["1", "2L", "B2", "-"]
FARE_CYCLE = ["N", "M", "X"]
STATUS_CYCLE = [
    "Investigating", "Resolved - Fraud", "Needs Review", "Resolved - Not Fraud", "Escalated",
]
HOLIDAYS = ["2024-01-01", "2024-01-15"]


#: Texts that are no amounts, though some engines read most of them as numbers.
BAD_AMOUNTS = ["bad", "60d", "1f", "NaN", "Infinity", "0x1p3"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _cycle(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _every(n: int, then: Column | str, otherwise: Column) -> Column:
    then = F.lit(then) if isinstance(then, str) else then
    return F.when(F.col("event_id") % n == 0, then).otherwise(otherwise)


def bronze(source: DataFrame) -> DataFrame:
    """``events`` rows as the 19 bronze text columns."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    event = F.col("event_id")
    leave = F.date_trunc("second", F.col("ts"))
    enter = leave - F.make_dt_interval(mins=(event % 45).cast("int"))
    midnight = F.date_trunc("day", F.col("ts"))
    bad = F.floor(event / 101) % len(BAD_AMOUNTS)
    return source.select(
        F.date_add("ts", 2).cast("string").alias("posting_date"),
        F.to_date("ts").cast("string").alias("transaction_date"),
        _every(97, "-", F.concat(F.lit(" t"), F.col("user_id").cast("string"))).alias(
            "tag_plate_number"
        ),
        _cycle(AGENCY_CYCLE, k % 6).alias("agency"),
        F.when(F.col("event_type") == "error", "FEE").otherwise("TOLL").alias("description"),
        _every(50, "-", enter.cast("string")).alias("entry_time"),
        _cycle(PLAZA_CYCLE, k % 5).alias("entry_plaza"),
        (event % 9).cast("string").alias("entry_lane"),
        _every(89, midnight, leave).cast("string").alias("exit_time"),
        _cycle(PLAZA_CYCLE, k % 7).alias("exit_plaza"),
        F.lit("-").alias("exit_lane"),
        _cycle(VEHICLE_CYCLE, event % 4).alias("vehicle_type_code"),
        _every(101, _cycle(BAD_AMOUNTS, bad), F.concat(F.lit("-"), F.col("value").cast("string")))
        .alias("amount"),
        F.lit("Y").alias("prepaid"),
        F.lit("STANDARD").alias("plan_rate"),
        _cycle(FARE_CYCLE, event % 3).alias("fare_type"),
        F.lit("100.00").alias("balance"),
        F.lit("2024-02-01 00:00:00").alias("loaded_at"),
        F.lit("transaction_2024_01.csv").alias("source_file"),
    ).select(*BRONZE_COLUMNS)


def statements(source: DataFrame) -> DataFrame:
    """``events`` rows as raw statement lines: US dates, bare times, dollar amounts."""
    event = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    leave = F.date_trunc("second", F.col("ts"))
    enter = leave - F.make_dt_interval(mins=(event % 45).cast("int"))
    day = _every(2, F.date_format("ts", "MM/dd/yyyy"), F.date_format("ts", "M/d/yyyy"))
    value = F.format_number(F.col("value") * 10, 2)
    return source.select(
        F.date_format(F.date_add("ts", 2), "MM/dd/yyyy").alias("POSTING DATE"),
        _every(103, "13/45/2024", day).alias("TRANSACTION DATE"),
        F.concat(F.lit(" t"), F.col("user_id").cast("string")).alias("TAG/PLATE NUMBER"),
        _cycle(AGENCY_CYCLE, k % 6).alias("AGENCY"),
        F.lit("TOLL").alias("DESCRIPTION"),
        _every(50, "-", F.date_format(enter, "HH:mm:ss")).alias("ENTRY TIME"),
        _cycle(PLAZA_CYCLE, k % 5).alias("ENTRY PLAZA"),
        (event % 9).cast("string").alias("ENTRY LANE"),
        _every(89, "25:61:00", F.date_format(leave, "HH:mm:ss")).alias("EXIT TIME"),
        _cycle(PLAZA_CYCLE, k % 7).alias("EXIT PLAZA"),
        F.lit("-").alias("EXIT LANE"),
        _cycle(VEHICLE_CYCLE, event % 4).alias("VEHICLE TYPE CODE"),
        _every(
            101, _cycle(BAD_AMOUNTS, F.floor(event / 101) % len(BAD_AMOUNTS)),
            _every(2, F.concat(F.lit("($"), value, F.lit(")")), F.concat(F.lit(" $"), value)),
        ).alias("AMOUNT"),
        F.lit("Y").alias("PREPAID"),
        F.lit("STANDARD").alias("PLAN/RATE"),
        _cycle(FARE_CYCLE, event % 3).alias("FARE TYPE"),
        F.lit("$1,000.50").alias("BALANCE"),
    ).select(*RAW_COLUMNS)


def holidays(spark: SparkSession) -> DataFrame:
    days = spark.createDataFrame([(d,) for d in HOLIDAYS], "holiday_date string")
    return days.select(F.col("holiday_date").cast("date"))


def distances(spark: SparkSession) -> DataFrame:
    known = list(enumerate(PLAZA_CYCLE[:-1]))
    pairs = [(a, b, 5.0 * abs(i - j)) for i, a in known for j, b in known if i != j]
    return spark.createDataFrame(
        pairs, "origin_plaza string, destination_plaza string, miles double"
    )


def status_requests(master: DataFrame) -> DataFrame:
    """Two or three requests per transaction, in an order and with statuses its id decides."""
    digit = F.conv(F.substring("transaction_id", 1, 4), 16, 10).cast("bigint")
    turn = F.explode(F.sequence(F.lit(0), (digit % 3).cast("int")))
    return master.select("transaction_id", digit.alias("_digit"), turn.alias("_turn")).select(
        F.when(F.col("_digit") % 11 == 0, F.concat(F.lit("x"), "transaction_id"))
        .when(F.col("_digit") % 13 != 0, F.col("transaction_id")).alias("transaction_id"),
        _cycle(STATUS_CYCLE, (F.col("_digit") / 7 + F.col("_turn") * 3).cast("bigint") % 5).alias(
            "new_status"
        ),
        (F.col("_digit") * 10 + (F.col("_turn") * 7) % 3).alias("seq"),
    )


PREDICTED_AT = "2024-02-02 00:00:00"


def rule_predictions(gold: DataFrame) -> DataFrame:
    """Predictions without a model, for checks in SQL: the driver z-score as the score."""
    score = -F.coalesce("driver_amount_modified_z_score", F.lit(0.0))
    return gold.withColumns({
        "ml_anomaly_score": score,
        "is_anomaly": F.when(F.col("anomaly_score") >= 80, 1).otherwise(0),
        "prediction_timestamp": F.lit(PREDICTED_AT).cast("timestamp"),
    })


def file_names(source: DataFrame) -> DataFrame:
    """A statement file name per event, in the spellings that occur."""
    event = F.col("event_id")
    month = _cycle(
        ["January", "feb", "MARCH", "apr", "may", "June", "jul", "August", "sept", "Oct", "nov",
         "December", "Smarch"],
        event % 13,
    )
    named = F.concat(F.lit("Transactions "), month, F.lit(" "), F.year("ts").cast("string"))
    spelling = [
        F.date_format("ts", "'transaction_'yyyy_MM'.csv'"),
        F.date_format("ts", "'statement-'yyyy-MM'-final.csv'"),
        F.date_format("ts", "'st'yyyyMM'.csv'"),
        F.concat(named, F.lit(".csv")),
        F.lit("statement.csv"),
    ]
    return source.select(
        "event_id", F.get(F.array(*spelling), (event % 5).cast("int")).alias("source_file")
    )


def order_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as one toll per order: years of history for calendar windows."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("tag_plate_number"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").alias("amount"),
    )
