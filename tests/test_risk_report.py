import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.plans import quality, report, review, risk

NEW = "2024-05-01 00:00:00"


def scores(spark, values):
    data = [(f"{i:03d}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "transaction_id string, ml_anomaly_score double")


def test_categories_by_percentile(spark):
    got = risk.categorize(scores(spark, [float(i) for i in range(1, 101)]).repartition(3))
    counts = dict(got.groupBy("anomaly_category").count().collect())
    assert counts == {"Critical Risk": 1, "Medium Risk": 4, "Low Risk": 20, "No Risk": 75}
    ranks = {r["ml_anomaly_score"]: r["score_percentile_rank"] for r in got.collect()}
    assert (ranks[1.0], ranks[100.0], ranks[34.0]) == (0.0, 1.0, 33 / 99)


def test_percentile_rank_shares_ties_and_one_row_is_zero(spark):
    got = risk.score_percentile_rank(scores(spark, [2.0, 1.0, 2.0, 3.0, 1.0]))
    assert [r[2] for r in rows(got.select("ml_anomaly_score", "transaction_id", "score_percentile_rank"))] \
        == [0.0, 0.0, 0.5, 0.5, 1.0]
    assert risk.score_percentile_rank(scores(spark, [7.0])).first()["score_percentile_rank"] == 0.0


@pytest.mark.parametrize("category, status", [
    ("Critical Risk", "Needs Review"), ("HIGH RISK", "Needs Review"),
    ("Medium Risk", "No Action Required"), (None, None),
])
def test_review_status(spark, category, status):
    df = spark.createDataFrame([(category,)], "c string")
    assert df.select(risk.review_status(F.col("c"))).first()[0] == status


def master(spark, *changes):
    base = {
        "transaction_id": "a", "status": "Needs Review", "transaction_date": date(2024, 1, 5),
        "tag_plate_number": "T1", "agency": "GSP", "amount": 10.0, "is_anomaly": 1,
        "ml_predicted_category": "Critical Risk", "ml_predicted_score": -0.5,
        "entry_time": datetime(2024, 1, 5, 7), "last_updated": datetime(2024, 2, 1),
        **{f: False for f in report.FLAG_LABELS},
    }
    types = {"transaction_date": "date", "amount": "double", "is_anomaly": "int",
             "ml_predicted_score": "double", "entry_time": "timestamp", "last_updated": "timestamp",
             **{f: "boolean" for f in report.FLAG_LABELS}}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in base)
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], schema)


def test_master_join_keeps_gold_rows_without_prediction(spark):
    gold = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    pred = spark.createDataFrame(
        [("a", 1, -0.2, "Low Risk", NEW)],
        "transaction_id string, is_anomaly int, ml_anomaly_score double, anomaly_category string, "
        "prediction_timestamp string",
    )
    got = risk.master_join(gold, pred).select("transaction_id", "is_anomaly", "ml_predicted_category")
    assert rows(got) == [("a", 1, "Low Risk"), ("b", None, None)]


def test_stats_count_anomalies_as_loss(spark):
    df = master(
        spark, {}, {"amount": 0.1}, {"amount": None}, {"is_anomaly": 0}, {"is_anomaly": None},
        {"transaction_date": None, "amount": 5.0}, {"transaction_date": date(2023, 12, 31)},
    )
    assert tuple(report.stats_summary(df, "2024-03-01").first())[1:] == (7, 25.1, 5, 25.1)
    assert rows(report.stats_month(df, "2024-03-01").drop("as_of_date")) == [
        ("2023-12", 1, 1, 10.0), ("2024-01", 5, 3, 10.1),
    ]
    empty = report.stats_summary(df.limit(0), "2024-03-01").first()
    assert tuple(empty)[1:] == (0, 0.0, 0, 0.0)


def test_flag_counts_only_raised_flags_of_anomalies(spark):
    df = master(
        spark, {"flag_rush_hour": True, "flag_is_weekend": True}, {"flag_rush_hour": True},
        {"flag_is_holiday": True, "is_anomaly": 0}, {"flag_is_holiday": None},
    )
    counts = report.flag_category_counts(df)
    assert [tuple(r) for r in counts.collect()] == [("Rush Hour", 2), ("Weekend", 1)]
    shares = report.category_share(counts)
    assert rows(shares.select("category", "percentage")) == [("Rush Hour", 66.7), ("Weekend", 33.3)]
    zero = report.category_share(counts.withColumn("count", F.lit(0).cast("bigint")))
    assert {r["percentage"] for r in zero.collect()} == {0.0}


def test_hourly_keeps_missing_hours(spark):
    df = master(spark, {}, {"entry_time": None}, {"entry_time": None, "is_anomaly": 0})
    assert [tuple(r) for r in report.hourly_anomalies(df).collect()] == [(None, 1), (7, 1)]


@pytest.mark.parametrize("search, status, category, ids", [
    ("", "", "", "abc"), ("T1", "", "", "ab"), ("t_", "", "", "abc"), ("%1", "", "", "ab"),
    ("critical", "all", "all", "ac"), ("", "Needs Review", "", "ac"), ("", "needs review", "", ""),
    ("", "", "LOW RISK", "b"), ("it's", "", "", ""), ("\\", "", "", ""), ("  t2  ", "", "", "c"),
])
def test_search(spark, search, status, category, ids):
    df = master(
        spark, {},
        {"transaction_id": "b", "status": "No Action Required", "ml_predicted_category": "Low Risk"},
        {"transaction_id": "c", "tag_plate_number": "T2"},
    )
    found = report.search_transactions(df, search, status, category)
    assert sorted(r["transaction_id"] for r in found.collect()) == list(ids)
    assert report.count_transactions(df, search, status, category).first()["total"] == len(ids)


def test_pages_are_latest_first_and_do_not_overlap(spark):
    df = master(spark, *[
        {"transaction_id": f"{i:02d}", "transaction_date": date(2024, 1, 1 + i % 5)} for i in range(25)
    ])
    pages = [report.search_transactions(df, page=p, limit=10).collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    seen = [r["transaction_id"] for p in pages for r in p]
    assert len(set(seen)) == 25 and pages[0][0]["transaction_date"] == date(2024, 1, 5)


def test_recent_flagged_defaults(spark):
    df = master(
        spark, {"amount": None, "ml_predicted_category": None, "is_anomaly": None},
        {"transaction_id": "b", "status": None, "is_anomaly": 0},
    )
    got = report.recent_flagged(df).collect()
    assert len(got) == 1
    assert (got[0]["amount"], got[0]["category"], got[0]["is_anomaly"], got[0]["transaction_date"]) == (
        0.0, "Anomaly Detected", False, "2024-01-05"
    )
    assert report.alerts(df).count() == 0


def test_latest_rows_and_empty_tables(spark):
    stats = spark.createDataFrame(
        [(date(2024, 1, 1), 5, 1.0, 1, 1.0), (date(2024, 1, 2), 1000, 5000.0, 12, None)],
        "as_of_date date, total_transactions long, total_amount_all_time double, "
        "total_alert_all_time long, loss_all_time double",
    )
    assert tuple(report.latest_metrics(stats).first()) == (1000, 5000.0, 12, 0.0)
    assert tuple(report.latest_metrics(stats.limit(0)).first()) == (0, 0.0, 0, 0.0)
    months = spark.createDataFrame(
        [(f"2023-{m:02d}", m, None, None) for m in range(1, 13)] + [("2024-01", 1, 7, 2.5)],
        "month string, total_transactions long, total_alerts long, total_loss double",
    )
    assert tuple(report.latest_month(months).first()) == ("2024-01", 7)
    assert tuple(report.latest_month(months.limit(0)).first()) == (None, 0)
    series = report.monthly_series(months).collect()
    assert [r["month"] for r in series][::11] == ["2023-02", "2024-01"]
    assert (series[0]["fraud_alerts"], series[0]["total_loss"]) == (0, 0.0)


def test_scatter_drops_missing_and_old(spark):
    df = master(spark, {}, {"amount": None}, {"transaction_date": date(2023, 12, 31)},
                {"ml_predicted_category": None}, {"transaction_date": date(2024, 1, 1)})
    assert report.score_scatter(df).count() == 2


@pytest.mark.parametrize("column, direction, expected", [
    ("s", "asc", [None, "a", "B", "c"]), ("s", "desc", ["c", "B", "a", None]),
    ("b", "asc", [None, False, True, True]), ("plan_rate", "asc", ["x", "9", "10", "11"]),
    ("n", "desc", [3.0, 2.0, 1.0, None]),
])
def test_sort_table(spark, column, direction, expected):
    df = spark.createDataFrame(
        [("B", True, "10", 1.0), (None, None, "x", None), ("c", False, "9", 2.0), ("a", True, "11", 3.0)],
        "s string, b boolean, plan_rate string, n double",
    )
    assert [r[column] for r in report.sort_table(df, column, direction).collect()] == expected


def test_equal_keys_keep_the_order_of_the_list(spark):
    data = [("b", "2024-01-01", 1.0), ("a", "2024-01-01", 1.0), ("c", "2024-01-03", 1.0), ("d", None, 1.0), ("e", None, 0.5)]
    df = spark.createDataFrame(data, "transaction_id string, transaction_date string, amount double").repartition(4)
    for direction, order in (("asc", "ecabd"), ("desc", "cabde")):
        assert "".join(r[0] for r in report.sort_table(df, "amount", direction).collect()) == order


def test_missing_prediction_columns_are_failures(spark):
    found = quality.missing_columns("pred_raw", spark.range(1), ["amount", "speed_mph"])
    assert [tuple(r) for r in found.collect()] == [("pred_raw", "present", c, 1) for c in ("amount", "speed_mph")]


def test_severity_order(spark):
    labels = ["Odd", "No Risk", "Low Risk", "Critical Risk", "High Risk", "Medium Risk"]
    df = spark.createDataFrame([(v,) for v in labels], "severity string")
    assert [r[0] for r in report.order_by_severity(df).collect()] == [
        "Critical Risk", "High Risk", "Medium Risk", "Low Risk", "No Risk", "Odd",
    ]


# Status updates -----------------------------------------------------------------------------

ALLOWED = {
    "Needs Review": ["Resolved - Not Fraud", "Investigating", "Resolved - Fraud"],
    "Investigating": ["Resolved - Not Fraud", "Resolved - Fraud"],
}


def updates(spark, data):
    return spark.createDataFrame(data, "transaction_id string, new_status string, seq long")


def test_single_updates(spark):
    df = master(spark, {}, {"transaction_id": "done", "status": "Resolved - Fraud"})
    asked = updates(spark, [
        ("a", "Investigating", 1), ("done", "Investigating", 2), ("a", None, 3), (None, "x", 4),
        ("nope", "Investigating", 5), ("", "x", 6),
    ])
    got = {r["seq"]: (r["accepted"], r["reason"]) for r in review.review_requests(df, asked).collect()}
    assert got == {
        1: (True, None), 2: (False, review.INVALID), 3: (False, review.MISSING),
        4: (False, review.MISSING), 5: (False, review.NOT_FOUND), 6: (False, review.MISSING),
    }
    after = {r["transaction_id"]: r for r in review.apply_status_updates(df, asked, NEW).collect()}
    assert (after["a"]["status"], after["a"]["last_updated"]) == ("Investigating", datetime(2024, 5, 1))
    assert after["done"]["last_updated"] == datetime(2024, 2, 1)


def test_update_sequences_equal_a_replay(spark):
    rnd = random.Random(3)
    statuses = ["Needs Review", "Investigating", "Resolved - Fraud", "Resolved - Not Fraud",
                "No Action Required", "Odd"]
    current = {f"{i:03d}": rnd.choice(statuses + [None, None, "Needs Review"]) for i in range(150)}
    asked = [(rnd.choice(list(current)), rnd.choice(statuses[:4] + ["Odd"]), s) for s in range(900)]
    expected, state = {}, dict(current)
    for key, new, seq in asked:
        met = state[key]
        ok = met is None or new in ALLOWED.get(met, [])
        expected[seq] = (ok, met)
        if ok:
            state[key] = new
    df = master(spark, *[{"transaction_id": k, "status": v} for k, v in current.items()])
    shuffled = updates(spark, rnd.sample(asked, len(asked)))
    got = review.review_requests(df, shuffled).collect()
    assert {r["seq"]: (r["accepted"], r["current_status"]) for r in got} == expected
    after = review.apply_status_updates(df, shuffled, NEW).collect()
    assert {r["transaction_id"]: r["status"] for r in after} == state


# Data quality -------------------------------------------------------------------------------

def test_quality_checks(spark):
    df = spark.createDataFrame(
        [("a", "GSP"), ("a", "XX"), ("b", None), (None, "XX"), (None, "SJ")],
        "transaction_id string, agency string",
    )
    assert tuple(quality.check_not_null(df, ["transaction_id", "agency"]).first()) == (2, 1)
    assert rows(quality.check_unique(df)) == [("a", 2)]
    assert rows(quality.check_accepted_values(df)) == [("XX", 2)]


def test_only_the_first_of_equal_requests_is_accepted(spark):
    master = spark.createDataFrame([("a", "Needs Review"), ("b", None)], "transaction_id string, status string")
    asked = [("a", "Investigating", 1)] * 3 + [("b", "Confirmed Fraud", 5)] * 2
    found = review.review_requests(
        master, spark.createDataFrame(asked, "transaction_id string, new_status string, seq int")
    )
    got = rows(found.select("transaction_id", "accepted", "current_status", "reason"))
    invalid = "Invalid status transition"
    want = [("a", True, "Needs Review", None)] + [("a", False, "Investigating", invalid)] * 2
    want += [("b", True, None, None), ("b", False, "Confirmed Fraud", invalid)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", quality.CHECKED)
def test_check_table_computes_its_table_once(spark, name):
    ids = F.when(F.col("id") % 10 != 3, F.col("id") % 7)
    table = spark.range(100).select(
        ids.cast("string").alias("transaction_id"), F.when(F.col("id") > 4, F.lit("2024-01-01")).cast("date").alias("transaction_date"),
        F.when(F.col("id") > 1, F.lit("t")).alias("tag_plate_number"), F.col("id").alias("amount"),
        F.get(F.array(F.lit("XX"), F.lit("PTC"), F.lit(None), F.lit("YY")), (F.col("id") % 4).cast("int")).alias("agency"),
    )
    found = quality.check_table(name, table)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    nulls = {"transaction_id": 10, "transaction_date": 5, "tag_plate_number": 2, "agency": 25, "amount": 0}
    want = [(name, "not_null", c, nulls[c]) for c in quality.NOT_NULL[name]]
    want += [(name, "unique", "transaction_id", 7)] if name in quality.UNIQUE else []
    want += [(name, "accepted_values", "agency", 2)] if name in quality.ACCEPTED else []
    assert rows(found) == sorted(want, key=lambda r: [str(v) for v in r])
    assert {r.failures for r in quality.check_table(name, table.limit(0)).collect()} == {0}
