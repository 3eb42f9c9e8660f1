"""What queries store between their stages: the columns that their results are made of, and no others."""

import pytest
from pyspark.sql import functions as F

from tollguard import adapter, session
from tollguard.plans import gold, risk, silver, training
from tollguard.schemas import GOLD_COLUMNS
from tollguard.sources import sinks
from verification import queries as registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole_silver(spark):
    return silver.silver(adapter.bronze(adapter.events(spark, SF_DIR)), adapter.holidays(spark))


@pytest.fixture(scope="module")
def whole_gold(spark, whole_silver):
    return session.materialize(gold.gold(whole_silver))


@pytest.mark.parametrize("name, most", [
    ("stats_summary", 4), ("sort_table", 6), ("score_scatter", 5), ("apply_status_updates", 4), ("merge_status_updates", 6),
    ("stats_incremental", 8), ("pred_viz", 28), ("write_predictions", 28), ("check_tables", 28), ("impute_median", 26),
])
def test_stored_tables_are_no_wider_than_asked(spark, monkeypatch, name, most):
    widths, store = [], registry.materialize

    def counted(df):
        widths.append(len(df.columns))
        return store(df)

    monkeypatch.setattr(registry, "materialize", counted)
    registry.QUERIES[name](spark, SF_DIR)
    assert widths and max(widths) <= most < len(GOLD_COLUMNS)


def test_part_of_master_equals_the_whole(spark):
    columns = ["transaction_id", "status", "rule_based_score", "ml_predicted_category", "amount", "is_anomaly"]
    whole = registry._master(spark, SF_DIR).select(*columns)
    part = registry._master_part(spark, SF_DIR, *columns)
    assert part.columns == columns and part.exceptAll(whole).isEmpty() and whole.exceptAll(part).isEmpty()


def test_history_holds_only_what_the_columns_are_made_of(spark, monkeypatch):
    widths, store = [], silver.materialize

    def counted(df):
        widths.append(df.columns)
        return store(df)

    monkeypatch.setattr(silver, "materialize", counted)
    registry.QUERIES["stats_summary"](spark, SF_DIR)
    assert len(widths) == 1 and len(widths[0]) == 9 and "posting_date" not in widths[0]


@pytest.mark.parametrize("column", ["flag_outstate", "entry_plaza_name", "flag_rush_hour", "route_amount_med", "exit_hour",
                                    "flag_vehicle_type", "flag_is_holiday", "last_updated", "speed_mph"])
def test_part_of_silver_equals_the_whole(spark, whole_silver, column):
    bronze, holidays = adapter.bronze(adapter.events(spark, SF_DIR)), adapter.holidays(spark)
    part = silver.silver(bronze, holidays, columns=["transaction_id", column])
    whole = whole_silver.select("transaction_id", column)
    assert part.schema == whole.schema and part.exceptAll(whole).isEmpty() and whole.exceptAll(part).isEmpty()


def test_category_without_rank_is_the_same(spark):
    rows = spark.createDataFrame([(str(i), float(i % 40)) for i in range(100)] + [("n", None)], "transaction_id string, ml_anomaly_score double")
    plain = risk.categorize(rows, ranked=False)
    assert "score_percentile_rank" not in plain.columns
    assert plain.exceptAll(risk.categorize(rows).drop("score_percentile_rank")).isEmpty()


@pytest.mark.parametrize("name", ["score_scatter", "sort_table", "apply_status_updates"])
def test_category_takes_only_the_rolling_deviation_and_the_median(spark, monkeypatch, name):
    widths, store, joins = [], silver.materialize, []

    def counted(df):
        widths.append(set(df.columns))
        return store(df)

    monkeypatch.setattr(silver, "materialize", counted)
    monkeypatch.setattr(gold, "driver_spending", lambda df: joins.append(df))
    registry.QUERIES[name](spark, SF_DIR)
    unread = {"route_name", "agency", "driver_amount_last_30txn_max", "driver_amount_last_30txn_avg"}
    assert len(widths) == 1 and not widths[0] & unread and not joins


@pytest.mark.parametrize("column", [*gold.MADE_OF, "route_amount_med", "driver_daily_txn_count"])
def test_part_of_gold_equals_the_whole(spark, whole_gold, column):
    bronze, holidays = adapter.bronze(adapter.events(spark, SF_DIR)), adapter.holidays(spark)
    columns = ["transaction_id", column]
    part = gold.gold(silver.silver(bronze, holidays, columns=gold.silver_inputs(columns)), columns)
    whole = whole_gold.select(*columns)
    assert part.dtypes == whole.dtypes and part.exceptAll(whole).isEmpty() and whole.exceptAll(part).isEmpty()


@pytest.mark.parametrize("columns", [["amount", "ml_predicted_score"], ["status", "last_updated"], ["rule_based_score"], ["is_anomaly"]])
def test_part_of_master_without_rules_equals_the_whole(spark, columns):
    whole = registry._master(spark, SF_DIR).select(*columns)
    part = registry._master_part(spark, SF_DIR, *columns)
    assert part.columns == columns and part.exceptAll(whole).isEmpty() and whole.exceptAll(part).isEmpty()


def test_training_table_does_not_store_gold(spark, monkeypatch):
    stored, store = [], registry.materialize

    def kept(df):
        stored.append(df.columns)
        return store(df)

    monkeypatch.setattr(registry, "materialize", kept)
    train = registry._train(spark, SF_DIR)
    assert stored == [["column", "value", "rows"]]
    whole = training.gold_train(gold.gold(silver.silver(registry._bronze(spark, SF_DIR), adapter.holidays(spark))))
    assert train.columns == whole.columns and train.exceptAll(whole).isEmpty() and whole.exceptAll(train).isEmpty()


def test_predictions_are_written_without_a_shuffle(spark, monkeypatch, tmp_path):
    rebalanced = []
    monkeypatch.setattr(sinks, "write_partitioned", lambda *a, **k: rebalanced.append(a))
    rows = spark.range(20, numPartitions=2).select(
        F.col("id").cast("string").alias("transaction_id"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).cast("timestamp").alias("prediction_timestamp"))
    for _ in range(2):
        sinks.write_predictions(rows, str(tmp_path / "p"))
    sinks.write_predictions(rows.filter("id % 3 = 1").limit(1), str(tmp_path / "p"))
    assert not rebalanced
    counts = dict(spark.read.parquet(str(tmp_path / "p")).groupBy(F.col("prediction_date").cast("string")).count().collect())
    assert counts == {"2024-01-01": 7, "2024-01-02": 1, "2024-01-03": 6}
