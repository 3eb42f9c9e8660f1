"""The ledger of loads: every row and every reject once, whatever stops, and whoever loads."""

import pytest

from conftest import rows
from test_sources import LINE, write
from tollguard.sources import bronze as bronze_table
from tollguard.sources import ledger, load
from tollguard.streaming.ingest import stream_statements

AT = "2024-04-01 00:00:00"


class Folders:
    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.bronze, self.rejects = str(base / "bronze"), str(base / "rejects")

    def batch(self, source="in"):
        return load.load_statements(self.spark, str(self.base / source), self.bronze, self.rejects, AT).first()

    def stream(self, source="in", state="state"):
        stream_statements(
            self.spark, str(self.base / source), self.bronze, str(self.base / state), AT, self.rejects
        ).awaitTermination()

    def counts(self):
        n = bronze_table.read_bronze(self.spark, self.bronze).count()
        if not ledger.exists(self.spark, self.rejects):
            return n, 0
        return n, self.spark.read.schema("record string").parquet(self.rejects).count()


@pytest.fixture
def folders(spark, tmp_path):
    return Folders(spark, tmp_path)


def test_files_without_a_good_row_are_loaded_once(folders, tmp_path):
    write(tmp_path / "in", "bad.csv", LINE + ",1", LINE + ",2", LINE + ",3")
    write(tmp_path / "in", "empty.csv")
    write(tmp_path / "in", "good.csv", LINE)
    for _ in range(2):
        assert folders.batch()["total_rows"] == 1
        assert folders.counts() == (1, 3)
    held = ledger.committed_files(ledger.read_ledger(folders.spark, folders.bronze))
    assert held.count() == 3


def test_equal_names_in_two_folders_and_a_file_written_over(folders, tmp_path):
    write(tmp_path / "in" / "a", "x.csv", LINE)
    write(tmp_path / "in" / "b", "x.csv", LINE, LINE)
    for _ in range(2):
        assert folders.batch("in/*")["total_rows"] == 3
    write(tmp_path / "in" / "a", "x.csv", LINE, LINE, LINE, LINE)
    assert folders.batch("in/*")["total_rows"] == 7


def test_batch_and_stream_do_not_load_each_others_files(folders, tmp_path):
    write(tmp_path / "in", "a b+c%.csv", LINE, LINE + ",extra")
    folders.batch()
    folders.stream()
    assert folders.counts() == (1, 1)
    write(tmp_path / "in", "b.csv", LINE, LINE, LINE + ",extra")
    folders.stream()
    folders.batch()
    folders.stream(state="another")
    assert folders.counts() == (3, 2)


@pytest.mark.parametrize("stop", ["rejected", "commit", "publish"])
def test_a_stopped_load_runs_again(folders, tmp_path, monkeypatch, stop):
    write(tmp_path / "in", "a.csv", LINE, LINE + ",extra")
    folders.batch()
    write(tmp_path / "in", "b.csv", LINE, LINE + ",extra", LINE + ",more")

    def stopped(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(load.statements if stop == "rejected" else ledger, stop, stopped)
        with pytest.raises(RuntimeError, match="lost"):
            folders.batch()
    assert folders.counts() == (1, 1)  # nothing of it is seen
    for _ in range(2):
        assert folders.batch()["total_rows"] == 2
        assert folders.counts() == (2, 3)
    assert not list(tmp_path.glob("*/_staged-*"))


def test_half_published_loads_are_published_again(folders, tmp_path, monkeypatch):
    write(tmp_path / "in", "a.csv", LINE, LINE + ",extra")
    rename, seen = ledger._rename, []

    def once(*names):
        if seen:
            raise RuntimeError("lost")
        seen.append(names)
        rename(*names)

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "_rename", once)
        with pytest.raises(RuntimeError, match="lost"):
            folders.batch()
    assert folders.counts() == (1, 0)
    folders.batch()
    assert folders.counts() == (1, 1)


def test_too_many_bad_rows_leave_nothing(folders, tmp_path):
    write(tmp_path / "in", "a.csv", LINE, LINE + ",1", LINE + ",2")
    with pytest.raises(ValueError, match="2 bad rows"):
        load.load_statements(folders.spark, str(tmp_path / "in"), folders.bronze, folders.rejects, AT, max_bad_rows=1)
    assert not ledger.exists(folders.spark, folders.rejects)
    assert folders.batch()["total_rows"] == 1 and folders.counts() == (1, 2)


def test_a_stream_batch_that_runs_again_is_loaded_once(folders, tmp_path, monkeypatch):
    write(tmp_path / "in", "a.csv", LINE, LINE + ",extra")

    def stopped(*_):
        raise RuntimeError("lost")

    for stop in ("commit", "publish"):
        with monkeypatch.context() as patch:
            patch.setattr(ledger, stop, stopped)
            with pytest.raises(Exception, match="lost"):
                folders.stream()
    for _ in range(2):
        folders.stream()
        assert folders.counts() == (1, 1)


def test_files_of_a_table_without_ledger_can_be_adopted(folders, tmp_path):
    write(tmp_path / "in", "a.csv", LINE)
    ledger.adopt(ledger.list_files(folders.spark, str(tmp_path / "in")), folders.bronze, "before")
    write(tmp_path / "in", "b.csv", LINE.replace("t1", "t2"))
    assert folders.batch()["total_rows"] == 1
    assert rows(bronze_table.read_bronze(folders.spark, folders.bronze).select("tag_plate_number")) == [(" t2 ",)]
