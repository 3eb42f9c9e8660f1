"""Stored review decisions: merged by date, kept by a rebuild, once however often a batch runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.plans import status
from tollguard.sources import sinks

DAYS = [datetime.date(2024, 1, d) for d in (1, 2, 3)]
AT = "2024-05-0{} 00:00:00"


@pytest.fixture
def table(spark, tmp_path):
    data = [(f"t{i}", DAYS[i % 3] if i < 9 else None, "tag", "Critical Risk", "Needs Review", None) for i in range(10)]
    df = spark.createDataFrame(
        data, "transaction_id string, transaction_date date, tag_plate_number string, ml_predicted_category string, "
        "status string, last_updated timestamp",
    )
    path = str(tmp_path / "master")
    sinks.write_partitioned(df, path, sinks.MASTER_CLUSTER)
    return df, path, str(tmp_path / "history"), tmp_path


def asked(spark, *requests):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(requests)], "transaction_id string, new_status string, seq long")


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.glob("master/transaction_date=*/*.parquet")}


def statuses(spark, path):
    return dict(spark.read.parquet(path).select("transaction_id", "status").collect())


def test_only_touched_dates_are_written(spark, table):
    df, path, history, folder = table
    before = files(folder)
    status.merge_updates(spark, path, history, asked(spark, ("t1", "Investigating"), ("t9", "Investigating")), AT.format(1), "a")
    after = files(folder)
    kept = {f for f, t in before.items() if after.get(f) == t}
    assert all("2024-01-02" not in f and "HIVE_DEFAULT" not in f for f in kept) and len(kept) >= 2
    assert {f.split("/")[1] for f in kept} == {"transaction_date=2024-01-01", "transaction_date=2024-01-03"}
    found = statuses(spark, path)
    assert (found["t1"], found["t9"], found["t0"], len(found)) == ("Investigating", "Investigating", "Needs Review", 10)


def test_decisions_stay_and_batches_run_once(spark, table, monkeypatch):
    df, path, history, _ = table
    first = asked(spark, ("t1", "Investigating"), ("t2", "No such status"), ("absent", "Investigating"))
    with monkeypatch.context() as patch:
        patch.setattr(status.sinks, "write_partitioned", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            status.merge_updates(spark, path, history, first, AT.format(1), "a")
    for _ in range(2):
        status.merge_updates(spark, path, history, first, AT.format(1), "a")
    # a build writes the table anew, with the history folded in
    sinks.write_partitioned(status.fold_history(df, status.read_history(spark, history)), path, sinks.MASTER_CLUSTER)
    assert statuses(spark, path)["t1"] == "Investigating"
    # an investigated transaction cannot be investigated again; another one can
    status.merge_updates(spark, path, history, asked(spark, ("t1", "Investigating"), ("t3", "Investigating")), AT.format(2), "b")
    kept = status.read_history(spark, history)
    assert rows(kept.select("transaction_id", "batch", F.date_format("updated_at", "d"))) == [("t1", "a", "1"), ("t3", "b", "2")]
    times = dict(spark.read.parquet(path).select("transaction_id", F.date_format("last_updated", "d")).collect())
    assert (times["t1"], times["t3"], times["t0"]) == ("1", "2", None)


def test_nothing_accepted_writes_nothing(spark, table):
    df, path, history, folder = table
    before = files(folder)
    status.merge_updates(spark, path, history, asked(spark, ("absent", "Investigating"), (None, None)), AT.format(1), "a")
    assert files(folder) == before and status.read_history(spark, history).count() == 0
