import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.operators import preceding, skew
from tollguard.plans import silver

SCHEMA = (
    "transaction_id string, source_file string, tag_plate_number string, transaction_date string, "
    "entry_time string, exit_time string, entry_plaza string, exit_plaza string, amount double"
)


def trips(spark, n, seed, hot_time_share=0.0, id_of=None):
    """A third of the rows on one tag, some on no tag, with ties and missing times."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        tag = rnd.choice(["HOT", "HOT", None] + [f"T{k}" for k in range(6)])
        second = 0 if rnd.random() < hot_time_share else rnd.randrange(4000)
        time = None if rnd.random() < 0.1 else f"2024-01-01 0{second // 3600}:{second // 60 % 60:02d}:{second % 60:02d}"
        data.append((
            id_of(i) if id_of else f"{rnd.getrandbits(128):032x}", f"f{i}", tag, "2024-01-01", time,
            time if rnd.random() < 0.9 else None, rnd.choice("AB"), rnd.choice("CD"),
            rnd.choice([None, 1.0, 2.5, 7.75, 100.01]),
        ))
    return spark.createDataFrame(data, SCHEMA).withColumns({
        c: F.col(c).cast("timestamp") for c in ("entry_time", "exit_time")
    }).repartition(5)


@pytest.mark.parametrize("hot_rows, ties", [(60, 0.0), (60, 0.9), (10, 0.5), (3, 0.9)])
def test_pieces_equal_one_window(spark, hot_rows, ties):
    """Also with pieces far shorter than the 30 rows looked back, and with mostly equal times."""
    df = trips(spark, 500, hot_rows, ties).persist()
    assert skew.hot_keys(df, "tag_plate_number", hot_rows)
    plain = silver.driver_history(df)
    assert rows(silver.driver_history(df, hot_rows).select(*plain.columns)) == rows(plain)
    assert rows(silver.previous_trip(df, hot_rows)) == rows(silver.previous_trip(df))
    assert rows(silver.driver_rolling_30txn(df, hot_rows)) == rows(silver.driver_rolling_30txn(df))


def test_pieces_equal_one_window_when_copies_share_an_id(spark):
    df = trips(spark, 300, 1, 0.8, id_of=lambda i: f"{i % 3:032x}").persist()
    assert rows(silver.driver_history(df, 20)) == rows(silver.driver_history(df))


@pytest.mark.parametrize("block_rows", [1_000_000, 7])
def test_many_equal_rows_are_folded(spark, monkeypatch, block_rows):
    """A third of all rows are copies of one passage: the result is still that of one window."""
    monkeypatch.setattr(preceding, "BLOCK_ROWS", block_rows)
    df = trips(spark, 300, 2, 0.5)
    one = df.filter("tag_plate_number = 'HOT' and amount is not null").orderBy("exit_time").limit(1)
    df = df.unionByName(one.crossJoin(spark.range(150)).drop("id")).persist()
    assert df.count() == 450
    plain = silver.driver_history(df)
    got = silver.driver_history(df, 40).select(*plain.columns)
    assert rows(got) == rows(plain)
    folded, has_copies = preceding.fold_copies(df.filter("tag_plate_number = 'HOT'"), 30, 40)
    assert has_copies and folded.groupBy("transaction_id").count().agg(F.max("count")).first()[0] == 31


def test_pieces_are_bounded(spark):
    """Equal times are cut along the id, so no piece keeps the whole tag."""
    df = trips(spark, 1200, 7, 1.0).filter("tag_plate_number = 'HOT'").withColumn(
        "_at", silver._entry_position()
    )
    edges = {r["tag_plate_number"]: preceding._spread_ties(r["cuts"])
             for r in preceding._edges(df, "tag_plate_number", 60)}
    assert len(set(edges["HOT"])) >= df.count() // 60


def test_hot_keys_are_few_and_include_null(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 6 + [("b",)] * 4, "k string")
    assert {r["k"]: r["rows"] for r in skew.hot_keys(df, "k", 4)} == {"a": 5, None: 6}


def test_lag_puts_missing_exit_times_last_and_breaks_ties_by_id(spark):
    data = [("c", "T", None), ("a", "T", "10:00:00"), ("b", "T", "10:00:00"), ("d", "T", "09:00:00")]
    df = spark.createDataFrame(data, "transaction_id string, tag_plate_number string, t string").select(
        "transaction_id", "tag_plate_number", F.lit("f").alias("source_file"),
        F.concat(F.lit("2024-01-01 "), "t").cast("timestamp").alias("exit_time"),
        F.lit(None).cast("timestamp").alias("entry_time"),
        F.lit("E").alias("entry_plaza"), F.col("transaction_id").alias("exit_plaza"),
    )
    got = silver.route_name(silver.previous_trip(df))
    assert rows(got.select("transaction_id", "exit_plaza_previous", "route_name")) == [
        ("a", "d", "d to a"), ("b", "a", "a to b"), ("c", "b", "b to c"), ("d", None, "Unknown to d"),
    ]


def test_rolling_excludes_the_row_and_stops_at_30(spark):
    df = spark.range(33).select(
        F.format_string("%03d", "id").alias("transaction_id"), F.lit("f").alias("source_file"),
        F.lit("T").alias("tag_plate_number"), F.lit(None).cast("timestamp").alias("entry_time"),
        F.col("id").cast("double").alias("amount"),
    )
    got = {r["transaction_id"]: r for r in silver.driver_rolling_30txn(df).collect()}
    name = "driver_amount_last_30txn_"
    assert (got["000"][name + "count"], got["000"][name + "avg"]) == (0, None)
    assert (got["001"][name + "avg"], got["001"][name + "std"]) == (0.0, None)
    assert got["002"][name + "std"] == pytest.approx(0.7071067811865476)
    assert (got["030"][name + "count"], got["030"][name + "min"]) == (30, 0.0)
    assert (got["032"][name + "count"], got["032"][name + "min"], got["032"][name + "max"]) == (30, 2.0, 31.0)


def test_history_of_ordinary_tags_is_one_shuffle(spark):
    df = trips(spark, 50, 3)
    planned = silver.driver_history(df)
    planned.collect()
    final = planned._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_tag = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
    assert len(by_tag) == 1


def test_attach_small_broadcasts_only_within_the_limit(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for limit, hinted in ((5, True), (4, False)):
        joined = skew.attach_small(df, table, ["k"], max_rows=limit)
        optimized = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in optimized) is hinted
        assert joined.count() == 100 and joined.filter("n = 20").count() == 100
