import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.schemas import BRONZE_COLUMNS, BRONZE_SCHEMA, RAW_COLUMNS
from tollguard.sources import bronze as bronze_table
from tollguard.functions import cleaning
from tollguard.session import require_utc
from tollguard.sources import load, sinks, statements
from tollguard.streaming.ingest import stream_statements

HEADER = ",".join(RAW_COLUMNS)
LINE = (
    "03/07/2024,3/5/2024, t1 ,GSP,TOLL,08:00:00,PVK,1,08:30:00,BER,2,1,($60.56),Y,STANDARD,N,"
    '"$1,234.50"'
)


def write(folder, name, *lines, header=HEADER):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def bronze_rows(spark, *changes):
    base = dict.fromkeys(BRONZE_COLUMNS, "x") | {"loaded_at": "2024-01-01 00:00:00"}
    data = [tuple((base | change)[c] for c in BRONZE_COLUMNS) for change in changes]
    return spark.createDataFrame(data, BRONZE_SCHEMA)


def test_statement_to_bronze(spark, tmp_path):
    write(tmp_path / "in", "a.csv", LINE)
    raw = statements.read_statements(spark, str(tmp_path / "in"))
    row = statements.normalize(raw, "2024-04-01 00:00:00").first().asDict()
    assert list(row) == BRONZE_COLUMNS
    assert row["posting_date"] == "2024-03-07"
    assert row["transaction_date"] == "2024-03-05"
    assert row["entry_time"] == "2024-03-05 08:00:00"
    assert (row["amount"], row["balance"]) == ("-60.56", "1234.5")
    assert (row["source_file"], row["loaded_at"]) == ("a.csv", "2024-04-01 00:00:00")
    assert row["tag_plate_number"] == " t1 "


def test_quoted_newline_short_and_bad_rows(spark, tmp_path):
    quoted = LINE.replace("TOLL", '"TO\nLL, x"')
    short = "03/07/2024,3/5/2024,t2"
    write(tmp_path / "in", "a.csv", LINE, quoted, short, LINE + ",extra")
    read = statements.read_statements(spark, str(tmp_path / "in"))
    got = rows(read.select("`TAG/PLATE NUMBER`", "DESCRIPTION", "BALANCE"))
    assert got == rows(spark.createDataFrame(
        [(" t1 ", "TOLL", "$1,234.50"), (" t1 ", "TO\nLL, x", "$1,234.50"), ("t2", None, None)],
        "a string, b string, c string",
    ))


def test_files_are_split_unless_a_newline_is_quoted(spark, tmp_path):
    write(tmp_path / "plain", "a.csv", LINE, LINE.replace("TOLL", '"say ""x"""'))
    write(tmp_path / "quoted", "a.csv", LINE.replace("TOLL", '"TO\nLL"'))
    assert not statements.has_quoted_newlines(spark, str(tmp_path / "plain"))
    assert statements.has_quoted_newlines(spark, str(tmp_path / "quoted"))
    plain = [statements.read_statements(spark, str(tmp_path / "plain"), quoted_newlines=q) for q in (None, True)]
    assert rows(plain[0]) == rows(plain[1])


def test_bad_row_budget(spark, tmp_path):
    write(tmp_path / "in", "a.csv", LINE, LINE + ",1", LINE + ",2")
    assert statements.read_statements(spark, str(tmp_path / "in"), max_bad_rows=2).count() == 1
    with pytest.raises(ValueError, match="bad rows"):
        statements.read_statements(spark, str(tmp_path / "in"), max_bad_rows=1)


def test_headers_are_trimmed_and_mapped_by_name(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "GSP,$1.00,z", header=" AGENCY ,AMOUNT,NOTE")
    read = statements.read_statements(spark, str(tmp_path / "in"))
    named = statements.normalize_headers(read)
    assert named.columns == ["agency", "amount", "NOTE", "source_name"]
    assert statements.normalize_money(named).first()["amount"] == "1.0"


@pytest.mark.parametrize("text, expected", [
    ("($60.56)", "-60.56"), ("$1,234.50", "1234.5"), (" -5 ", "-5.0"), ("bad", None),
    ("", None), (None, None), ("(bad)", None),
])
def test_money(spark, text, expected):
    df = spark.createDataFrame([(text,)], "amount string")
    assert statements.normalize_money(df).first()["amount"] == expected


@pytest.mark.parametrize("date, time, expected", [
    ("3/5/2024", "08:09:10", "2024-03-05 08:09:10"), ("03/05/2024", "-", None),
    ("13/45/2024", "08:09:10", None), ("3/5/2024", "25:00:00", None),
    ("3/5/2024", "00:00:00", "2024-03-05 00:00:00"), ("2024-03-05", "8:09:10", "2024-03-05 08:09:10"),
    (None, "08:09:10", None), ("3/5/2024", None, None),
])
def test_dates_and_times(spark, date, time, expected):
    df = spark.createDataFrame([(date, time)], "transaction_date string, entry_time string")
    done = statements.normalize_times(statements.normalize_dates(df)).first()
    assert done["entry_time"] == expected


@pytest.mark.parametrize("name, expected", [
    ("x_2023-04.csv", (2023, 4)), ("x202312.csv", (2023, 12)), ("Transaction  Sept 2022.csv", (2022, 9)),
    ("transactions May 2021.csv", (2021, 5)), ("transactions Foo 2021.csv", (2025, 6)),
    ("statement.csv", (2025, 6)),
])
def test_statement_period(spark, name, expected):
    df = spark.createDataFrame([(name,)], "source_file string")
    row = statements.statement_period(df, "2025-06-30").first()
    assert (row["statement_year"], row["statement_month"]) == expected


def test_new_files_only_ignores_null_sources(spark):
    loaded = bronze_rows(spark, {"source_file": "a.csv"}, {"source_file": None})
    listing = spark.createDataFrame([("a.csv",), ("b.csv",)], "name string")
    assert rows(bronze_table.new_files_only(listing, loaded)) == [("b.csv",)]


def test_append_keeps_history_and_verify_counts(spark, tmp_path):
    path = str(tmp_path / "bronze")
    day = {"transaction_date": "2024-01-02", "amount": "-1.25", "source_file": "a.csv"}
    bronze_table.append_bronze(bronze_rows(spark, day), path)
    later = day | {"transaction_date": "2024-01-05", "amount": "bad", "source_file": "b.csv"}
    bronze_table.append_bronze(bronze_rows(spark, later), path)
    total = bronze_table.verify_load(bronze_table.read_bronze(spark, path)).first()
    assert tuple(total) == (2, 2, "2024-01-02", "2024-01-05", -1.25)


def test_dedupe_keeps_latest_load_and_null_keys(spark):
    old = {"entry_time": None, "source_file": "a.csv", "entry_lane": "old"}
    new = old | {"loaded_at": "2024-02-01 00:00:00", "entry_lane": "new"}
    other = old | {"agency": "y", "entry_lane": "other"}
    kept = bronze_table.dedupe_bronze(bronze_rows(spark, old, new, old, other))
    assert rows(kept.select("agency", "entry_lane")) == [("x", "new"), ("y", "other")]


def test_only_copied_passages_are_shuffled(spark):
    data = [
        {"tag_plate_number": str(i % 40), "exit_plaza": None if i % 3 else "", "entry_plaza": "" if i % 3 else None,
         "loaded_at": f"2024-01-{i % 7 + 1:02d}", "source_file": f"{i % 5}.csv", "entry_lane": str(i)}
        for i in range(100)
    ]
    table = bronze_rows(spark, *data)
    # bounds above, at and below the number of copied passages
    results = [bronze_table.dedupe_bronze(table, most) for most in (10_000, 30, 3, 0)]
    assert len({tuple(map(str, rows(r))) for r in results}) == 1
    seen = {(d["tag_plate_number"], d["exit_plaza"]) for d in data}
    assert results[0].count() == len(seen)
    plans = [r._jdf.queryExecution().executedPlan().toString() for r in results]
    assert "LeftAnti" in plans[0] and "LeftSemi" in plans[0] and "LeftAnti" not in plans[3]
    assert plans[0].count("SortAggregate") == plans[3].count("SortAggregate")
    alone = bronze_rows(spark, *data[:40])
    once = bronze_table.dedupe_bronze(alone)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and rows(once) == rows(alone)


@pytest.mark.parametrize("text, expected", [
    ("60d", None), ("1f", None), ("0x1p3", None), ("NaN", None), ("Infinity", None), ("-inf", None),
    ("1e999", None), ("1e2", 100.0), (" -5. ", -5.0), (".5", 0.5), ("-", None), ("1 2", None),
])
def test_only_plain_finite_numbers_are_numbers(spark, text, expected):
    df = spark.createDataFrame([(text,)], "amount string")
    assert df.select(cleaning.parse_number("amount")).first()[0] == expected


def test_equal_loads_go_by_the_smallest_file_name(spark):
    rows_ = [{"source_file": s, "loaded_at": t, "entry_lane": f"{s}{t}"} for s in "ab" for t in ("2024-01-02", "2024-01-10", None)]
    assert bronze_table.dedupe_bronze(bronze_rows(spark, *rows_)).first()["entry_lane"] == "a2024-01-10"


def test_another_time_zone_is_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    require_utc(spark)


def test_batch_stream_batch_in_one_folder(spark, tmp_path):
    out, source = str(tmp_path / "bronze"), tmp_path / "in"
    bronze_table.append_bronze(bronze_rows(spark, {"source_file": "x.csv"}), out)
    write(source, "a.csv", LINE, LINE + ",extra")
    rejects = str(tmp_path / "rejects")
    stream_statements(spark, str(source), out, str(tmp_path / "s"), "2024-04-01 00:00:00", rejects).awaitTermination()
    assert bronze_table.read_bronze(spark, out).count() == 2
    bronze_table.append_bronze(bronze_rows(spark, {"source_file": "y.csv"}), out)
    assert bronze_table.read_bronze(spark, out).count() == 3
    kept = spark.read.option("recursiveFileLookup", True).parquet(rejects).collect()
    assert [(r["source_file"], r["record"]) for r in kept] == [("a.csv", LINE + ",extra")]
    write(source, "b.csv", LINE + ",1", LINE + ",2")
    with pytest.raises(Exception, match="bad rows"):
        stream_statements(
            spark, str(source), out, str(tmp_path / "s"), "2024-04-01 00:00:00", rejects, max_bad_rows=1
        ).awaitTermination()
    assert bronze_table.read_bronze(spark, out).count() == 3


def test_load_takes_new_files_only_and_keeps_bad_rows(spark, tmp_path):
    out, rejects, source = str(tmp_path / "bronze"), str(tmp_path / "rejects"), tmp_path / "in"
    write(source, "a.csv", LINE, LINE + ",extra")
    assert load.load_statements(spark, str(source), out, rejects, "2024-04-01 00:00:00").first()["total_rows"] == 1
    write(source, "b.csv", LINE)
    for _ in range(2):
        found = load.load_statements(spark, str(source), out, rejects, "2024-04-02 00:00:00").first()
        assert (found["total_rows"], found["unique_files"]) == (2, 2)
    assert spark.read.parquet(rejects).count() == 1


def test_write_partitioned_round_trip_and_pruning(spark, tmp_path):
    df = spark.range(1000).select(
        F.concat(F.lit("t"), F.col("id") % 7).alias("tag_plate_number"),
        F.when(F.col("id") % 10 > 0, F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")))
        .alias("transaction_date"),
        "id",
    )
    path = str(tmp_path / "table")
    sinks.write_partitioned(df, path)
    back = spark.read.parquet(path).select(*df.columns)
    assert rows(back) == rows(df)
    plan = back.filter("transaction_date = '2024-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(transaction_date" in plan


def test_write_predictions_reports_missing_columns(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1, -0.1, 5)],
        "transaction_id string, is_anomaly int, ml_anomaly_score double, unknown int",
    ).withColumn("prediction_timestamp", F.lit("2024-02-03 04:05:06").cast("timestamp"))
    path = str(tmp_path / "pred")
    missing = sinks.write_predictions(df, path)
    sinks.write_predictions(df, path)
    back = spark.read.parquet(path)
    assert "amount" in missing and "is_anomaly" not in missing
    assert back.count() == 1 and "unknown" not in back.columns
    assert str(back.first()["prediction_date"]) == "2024-02-03"


def test_stream_equals_batch_and_loads_each_file_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def load():
        stream_statements(spark, str(source), out, state, "2024-04-01 00:00:00").awaitTermination()

    write(source, "a.csv", LINE, LINE + ",extra")
    load()
    load()
    assert bronze_table.read_bronze(spark, out).count() == 1
    write(source, "b.csv", LINE.replace("t1", "t2"))
    load()
    batch = statements.normalize(
        statements.read_statements(spark, str(source)), "2024-04-01 00:00:00"
    )
    assert rows(bronze_table.read_bronze(spark, out)) == rows(batch)


def test_rejects_are_read_from_whole_statement_files(spark, tmp_path, monkeypatch):
    from verification import queries

    spark.range(1, 4000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 08:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 50 AS user_id",
        "'view' AS event_type", "id / 7D AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    read, paths = queries.statements.read_rejected, []
    monkeypatch.setattr(queries.statements, "read_rejected", lambda s, p, *a: paths.append(p) or read(s, p, *a))
    rejects = queries.rejected_rows(spark, str(tmp_path))
    assert {r.record for r in rejects.collect()} == {f"{n * 997}{',' * 17}" for n in (1, 2, 3, 4)}
    lines = spark.read.text(paths[0])
    assert lines.filter("value NOT LIKE 'POSTING DATE,%'").count() == 3999
    assert lines.filter("value LIKE 'POSTING DATE,%'").count() > 1
