"""Rollup cells equal the rollups of the whole table after every change, and touch no other month."""

import datetime

import pytest

from conftest import rows
from tollguard.plans import cells, report
from tollguard.sources import sinks

SCHEMA = (
    "transaction_id string, transaction_date date, tag_plate_number string, ml_predicted_category string, "
    "status string, amount double, is_anomaly int"
)


def day(month, d):
    return datetime.date(2024, month, d)


def table(spark, days, per_day=5, scale=1.0):
    data = [
        (f"{d}-{i}", d, "tag", "Low Risk", "Needs Review", None if i == 3 else scale * (i + 0.1), [1, 0, None, 1, 1][i % 5])
        for d in days for i in range(per_day)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def stored(spark, tmp_path):
    path, kept = str(tmp_path / "master"), str(tmp_path / "cells")
    sinks.write_partitioned(table(spark, [day(1, 1), day(1, 2), day(2, 1), None]), path, sinks.MASTER_CLUSTER)
    cells.write_cells(spark.read.parquet(path), kept)
    return path, kept


def check(spark, path, kept):
    master, found = spark.read.parquet(path), cells.read_cells(spark, kept)
    assert rows(cells.stats_summary(found, "2024-03-01")) == rows(report.stats_summary(master, "2024-03-01"))
    assert rows(cells.stats_month(found, "2024-03-01")) == rows(report.stats_month(master, "2024-03-01"))
    return found


def test_full_cells(spark, stored):
    found = check(spark, *stored)
    assert found.count() == 4 and sorted(r[0] for r in found.select("month").collect())[-1] == cells.UNDATED


def test_replaced_new_and_undated_days(spark, stored, tmp_path):
    path, kept = stored
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("cells/month=2024-02/*.parquet")}
    days = [day(1, 2), day(3, 31), None]
    for _ in range(2):  # a repeated refresh adds nothing
        cells.replace_days(spark, table(spark, days, 8, 2.5), path, kept, days)
        assert check(spark, path, kept).count() == 5
    assert before and before == {p: p.stat().st_mtime_ns for p in tmp_path.glob("cells/month=2024-02/*.parquet")}


def test_a_day_and_a_month_that_lose_their_rows(spark, stored):
    path, kept = stored
    sinks.write_partitioned(table(spark, [day(1, 2)]), path, sinks.MASTER_CLUSTER)
    spark.catalog.refreshByPath(path)
    cells.refresh_cells(spark, path, kept, [day(1, 1), day(2, 1), None])
    check(spark, path, kept)
    both = [day(2, 1), day(2, 2)]
    cells.replace_days(spark, table(spark, both), path, kept, both)
    assert check(spark, path, kept).filter("transactions > 0").count() == 3


def test_no_cells_and_no_dates(spark, stored, tmp_path):
    path, kept = stored
    cells.refresh_cells(spark, path, kept, [])
    check(spark, path, kept)
    empty = cells.read_cells(spark, str(tmp_path / "absent"))
    assert rows(cells.stats_month(empty, "2024-03-01")) == []
    assert rows(cells.stats_summary(empty, "2024-03-01")) == [(datetime.date(2024, 3, 1), 0, 0.0, 0, 0.0)]


def test_a_refresh_counts_only_its_days(spark, stored):
    path, kept = stored
    before = rows(cells.read_cells(spark, kept).filter("transaction_date != date'2024-01-02'"))
    both = table(spark, [day(1, 1), day(1, 2)], 8)
    sinks.write_partitioned(both, path, sinks.MASTER_CLUSTER, partition_overwrite="dynamic")
    cells.refresh_cells(spark, path, kept, [day(1, 2)])
    found = cells.read_cells(spark, kept)
    assert rows(found.filter("transaction_date != date'2024-01-02'")) == before
    assert rows(found.filter("transaction_date = date'2024-01-02'").select("transactions")) == [(8,)]
