"""CSV records of split files against the reader that takes a file whole."""

import random

import pytest

from conftest import rows
from tollguard.session import materialize
from tollguard.sources import records, statements

HEADERS = ["A", "B b", "C"]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(spark, path, headers=HEADERS):
    options = statements.CSV_OPTIONS | {"multiLine": True}
    return spark.read.schema(statements.statement_schema(headers)).options(**options).csv(path)


def lines(draw, n, end="\n"):
    def field():
        kind = draw.randrange(6)
        if kind == 0:
            return ""
        text = "".join(draw.choices("abcé ", k=draw.randrange(1, 12))).strip() or "x"
        if kind < 3:
            return text
        inner = "".join(draw.choices(["x", ",", '""', "\n", "yz", "\n\n"], k=draw.randrange(1, 9)))
        return f'"{inner}"'

    made = ["A,B b,C", *(",".join(["r", *(field() for _ in range(2))]) for _ in range(n))]
    return end.join(made) + end


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_splits, seed, end):
    draw = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(lines(draw, 60, end), newline="")
    (tmp_path / "c.csv").write_text("A,B b,C" + end + 'r,"' + "long\nfield " * 60 + '",x', newline="")
    (tmp_path / "d.csv").write_text("A,B b,C")
    path = str(tmp_path)
    got = statements.scan_statements(spark, path, HEADERS)
    columns = [f"`{c}`" for c in HEADERS]
    assert rows(got.select(*columns, "source_name")) == rows(
        whole(spark, path).selectExpr(*columns, "_metadata.file_name AS source_name")
    )
    assert records.quote_parity(spark, path).count() > 20


def test_one_file_takes_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(lines(random.Random(4), 200))
    path = str(tmp_path)
    parts = records.read_records(spark, path, materialize(records.quote_parity(spark, path)), HEADERS)
    spread = parts.selectExpr("spark_partition_id() AS p", "kind").collect()
    assert len({r.p for r in spread}) > 8
    assert {r.kind for r in spread} >= {records.WHOLE, records.BEGIN, records.END}


def test_bad_rows_and_odd_ends(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('A,B b,C\n1,"x\ny",2,3\n4,"q\n\nr",5\n\n6\n7,8,"open\nto the end')
    bad = statements.read_rejected(spark, str(tmp_path), "now", HEADERS).collect()
    assert [r.record for r in bad] == ['1,"x\ny",2,3']
    good = statements.read_statements(spark, str(tmp_path), HEADERS)
    assert rows(good.select("A", "`B b`"))[:2] == [("4", "q\n\nr"), ("6", None)] and good.count() == 3


def test_another_header_and_other_blocks_stop_the_read(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('A,B b,D\n1,"x\ny",2\n')
    with pytest.raises(Exception, match="has the header"):
        statements.scan_statements(spark, str(tmp_path), HEADERS).count()
    (tmp_path / "a.csv").write_text('A,B b,C\n1,"x\ny",2\n')
    parity = materialize(records.quote_parity(spark, str(tmp_path)))
    with pytest.raises(Exception, match="other blocks"):
        records.read_records(spark, str(tmp_path), parity.selectExpr("_path", "_start + 1 AS _start", "_odd"), HEADERS).count()


def test_no_file_has_blocks_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert records.quote_parity(spark, str(tmp_path)).count() == 0
    assert statements.scan_statements(spark, str(tmp_path), HEADERS).count() == 0
