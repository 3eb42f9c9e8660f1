from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.plans import gold, training


def one(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (t, v) in columns.items()])
    return df.select(expression).first()[0]


def doubles(**values):
    return {k: ("double", v) for k, v in values.items()}


def spend(spark, data):
    df = spark.createDataFrame(data, "tag_plate_number string, d string, amount double")
    return df.select("tag_plate_number", F.col("d").cast("date").alias("transaction_date"), "amount")


def test_spend_window_is_1_to_30_days_before(spark):
    df = spend(spark, [
        ("T", "2024-01-01", 10.0), ("T", "2024-01-01", 5.0), ("T", "2024-01-31", 20.0),
        ("T", "2024-02-01", 40.0), ("T", "2024-04-01", 1.0),
    ])
    got = {
        str(r["transaction_date"]): (r["driver_today_spend"], r["driver_avg_daily_spend_30d"])
        for r in gold.daily_spend_30d_avg(gold.daily_spend(df)).collect()
    }
    assert got == {
        "2024-01-01": (15.0, None), "2024-01-31": (20.0, 15.0), "2024-02-01": (40.0, 20.0),
        "2024-04-01": (1.0, None),
    }


def test_missing_tag_or_date_gets_no_spend_and_missing_tag_no_median(spark):
    df = spend(spark, [
        ("T", "2024-01-01", 1.0), ("T", None, 3.0), (None, "2024-01-01", 5.0), ("T", "2024-01-02", None),
    ])
    for joined in (
        gold.driver_spending(df),
        gold.daily_spend_join(gold.driver_median_join(df)),
    ):
        got = joined.select("tag_plate_number", "amount", "driver_amount_median", "driver_today_spend")
        assert rows(got) == [
            (None, 5.0, None, None), ("T", None, 1.0, None), ("T", 1.0, 1.0, 1.0), ("T", 3.0, 1.0, None),
        ]


def test_spend_does_not_depend_on_order(spark):
    amounts = [0.1, 0.2, 0.3, 1e6, 0.7, 2.35] * 50
    data = [("T", "2024-01-01", a) for a in amounts]
    for parts in (1, 7):
        got = gold.daily_spend(spend(spark, data).repartition(parts)).first()["driver_today_spend"]
        assert got == round(sum(round(a * 100) for a in amounts)) / 100


def test_deviations_guard_zero_and_units(spark):
    values = doubles(
        amount=30.0, driver_amount_median=10.0, driver_amount_last_30txn_std=0.0,
        driver_amount_last_30txn_avg=15.0,
    )
    assert one(spark, gold.driver_amount_modified_z_score(), **values) is None
    assert one(spark, gold.amount_deviation_from_avg_pct(), **values) == 100.0
    assert one(spark, gold.amount_deviation_from_median_pct(), **values) == 2.0


@pytest.mark.parametrize("z, flag", [(1.0, False), (1.01, True), (-5.0, False), (None, False)])
def test_driver_outlier_is_one_sided(spark, z, flag):
    got = one(spark, gold.flag_driver_amount_outlier(), **doubles(driver_amount_modified_z_score=z))
    assert got is flag


@pytest.mark.parametrize("z, flag", [(1.0, False), (-1.01, True), (2.0, True), (None, False)])
def test_route_outlier_is_two_sided(spark, z, flag):
    assert one(spark, gold.flag_route_amount_outlier(), **doubles(route_amount_z_score=z)) is flag


@pytest.mark.parametrize("pct, ratio, flag", [
    (80.0, None, False), (80.1, None, True), (None, 81.0, True), (None, None, False), (5.0, 79.0, False),
])
def test_unusually_high(spark, pct, ratio, flag):
    values = doubles(amount_deviation_from_avg_pct=pct, amount_deviation_from_median_pct=ratio)
    assert one(spark, gold.flag_amount_unusually_high(), **values) is flag


@pytest.mark.parametrize("today, mean, largest, amount, flag", [
    (301.0, 100.0, None, 50.0, True), (300.0, 100.0, 7.0, 50.0, False),
    (60.0, 100.0, 60.0, 50.0, True), (301.0, 100.0, None, 49.99, False),
    (301.0, None, 301.0, 50.0, False), (301.0, 100.0, None, None, False),
])
def test_spend_spike(spark, today, mean, largest, amount, flag):
    values = doubles(
        driver_today_spend=today, driver_avg_daily_spend_30d=mean,
        driver_amount_last_30txn_max=largest, amount=amount,
    )
    assert one(spark, gold.flag_driver_spend_spike(), **values) is flag


def test_score_adds_weights(spark):
    flags = {f: ("boolean", True) for f in gold.SCORE_WEIGHTS}
    assert one(spark, gold.anomaly_score(), **flags) == 100
    flags["flag_driver_amount_outlier"] = ("boolean", False)
    assert one(spark, gold.anomaly_score(), **flags) == 20


def test_frequency_counts_values_and_zeroes_null(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "p string, q string")
    expected = [(None, "x", 0, 3), ("a", None, 2, 0), ("a", "x", 2, 3), ("b", "x", 1, 3)]
    for small in (True, False):
        if not small:  # beyond the broadcast limit
            monkeypatch.setattr(training, "bounded", lambda table: None)
        got = training.frequency_encode(df, {"p": "p_n", "q": "q_n"})
        assert rows(got.select("p", "q", "p_n", "q_n")) == expected


def test_dates_stay_dates(spark):
    df = spend(spark, [("T", "2024-01-01", 1.0)])
    assert gold.daily_spend(df).first()["transaction_date"] == date(2024, 1, 1)


@pytest.mark.parametrize("n", [1, 2, 9, 50_000, 50_001])
def test_driver_median_is_exact_at_every_size(spark, n):
    tags = spark.range(n).select(
        F.lit(None).cast("string").alias("tag_plate_number"), (F.col("id") * 7 % n).cast("double").alias("amount")
    )
    tags = tags.unionByName(tags.limit(1).select(F.lit("t").alias("tag_plate_number"), F.lit(None).cast("double").alias("amount")))
    found = {r[0]: r[1] for r in gold.driver_amount_median(tags).collect()}
    values = sorted(float(i * 7 % n) for i in range(n))
    assert found == {None: values[(n - 1) // 2], "t": None}
