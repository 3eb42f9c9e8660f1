"""What a build does once only, and the layout of the tables that it writes without a shuffle."""

import glob

import pyarrow.parquet as pq
from conftest import rows
from pyspark.sql import functions as F

from tollguard import adapter
from tollguard.plans import medallion, model, quality, risk
from tollguard.schemas import GOLD_RULEBASED_COLUMNS
from tollguard.sources import sinks


def _events(spark, n):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp'2024-01-10 08:00:00' + make_interval(0, 0, 0, CAST(id % 3 AS INT), 0, CAST(id % 600 AS INT))").alias("ts"),
        (F.col("id") % 23).alias("user_id"), F.lit("view").alias("event_type"),
        ((F.col("id") * 37 % 91) / 4 + 1).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 40).cast("string"), F.lit("}")).alias("props"),
    )


def test_build_ranks_and_groups_each_table_once(spark, tmp_path, monkeypatch):
    ranked, grouped, written = [], [], {}
    rank, check, write = medallion.rank_values, quality.check_table, sinks.write_partitioned
    for module in (medallion, model, risk):
        monkeypatch.setattr(module, "rank_values", lambda df, column: ranked.append(column) or rank(df, column))
    monkeypatch.setattr(quality, "check_table", lambda name, df: grouped.append(name) or check(name, df))
    monkeypatch.setattr(quality, "check_unique", lambda df: grouped.append("unique"))

    def kept(df, path, *args, **kwargs):
        written[path.rsplit("/", 1)[1]] = kwargs["balanced"]
        write(df, path, *args, **kwargs)

    monkeypatch.setattr(sinks, "write_partitioned", kept)
    tables = medallion.build(
        spark, adapter.bronze(_events(spark, 900)), adapter.holidays(spark), str(tmp_path), "2024-02-02 00:00:00"
    )
    assert sorted(ranked) == ["ml_anomaly_score", "raw_score"]
    assert sorted(grouped) == sorted(quality.CHECKED)
    assert written == {"silver": False, "gold": False, "gold_rulebased": True, "gold_train": True, "master_viz": False}
    checks = tables["checks"].collect()
    assert len(checks) == 20 and all(c.failures == 0 for c in checks if c.test == "unique")
    assert rows(tables["gold_rulebased"]) == rows(tables["gold"].select(*GOLD_RULEBASED_COLUMNS))
    assert rows(tables["gold_train"].select("transaction_id", "transaction_date", "amount")) == rows(
        tables["gold"].select("transaction_id", "transaction_date", "amount")
    )
    scores = [r[0] for r in tables["pred_raw"].select("ml_anomaly_score").orderBy("ml_anomaly_score").collect()]
    middle = scores[(len(scores) - 1) // 2], scores[len(scores) // 2]
    assert abs(tables["metrics_training"].first().score_median - sum(middle) / 2) < 1e-12
    for score, share in tables["pred_viz"].select("ml_anomaly_score", "score_percentile_rank").distinct().collect():
        assert abs(share - sum(s < score for s in scores) / (len(scores) - 1)) < 1e-12


def test_balanced_writes_keep_the_layout(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    day = F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")))
    df = spark.range(5_000).select(
        F.col("id").alias("n"), F.concat(F.lit("t"), (F.col("id") * 31 % 97).cast("string")).alias("tag_plate_number"),
        day.alias("transaction_date"),
    )
    sinks.write_partitioned(df, source)
    stored = spark.read.parquet(source)
    sinks.write_partitioned(stored, target, balanced=True)
    assert rows(spark.read.parquet(target)) == rows(df.select("n", "tag_plate_number", "transaction_date"))
    files = [glob.glob(f"{path}/*/*.parquet") for path in (source, target)]
    assert len(files[1]) <= len(files[0])
    for file in files[1]:
        tags = pq.ParquetFile(file).read(["tag_plate_number"]).column(0).to_pylist()
        assert tags == sorted(tags)
