"""Bronze to report tables, each stage written once and read back by the next."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.operators.ranks import rank_values
from tollguard.operators.skew import BROADCAST_ROWS
from tollguard.plans import cells, gold, model, quality, risk, silver, status, training
from tollguard.schemas import FREQUENCY_FEATURES
from tollguard.session import materialize, require_utc, scratch_scope
from tollguard.sources import bronze as bronze_table
from tollguard.sources import sinks

#: The table of accepted status requests below the folder, see ``plans.status``.
HISTORY = "status_history"
#: The table of rollup cells below the folder, see ``plans.cells``.
CELLS = "stat_cells"


def build(
    spark: SparkSession,
    bronze: DataFrame,
    holidays: DataFrame,
    folder: str,
    run_time: str,
    distances: DataFrame | None = None,
    dedupe: bool = True,
) -> dict[str, DataFrame]:
    """Write every table below ``folder`` and return them by name.

    ``dedupe`` drops passages loaded twice, as bronze is documented to; without it, copies
    share an id and the unique check on the training table fails. Building again into the same
    folder replaces what the first run wrote; predictions of other days and metrics of other
    runs stay, and only this run's predictions are joined. Review decisions in ``status_history`` are
    folded into the new master table. ``checks`` has a row for each data
    test of each table, and one for each column that the predictions lack.
    """
    require_utc(spark)

    def stored(
        name: str, df: DataFrame, cluster: list[str] = sinks.SILVER_CLUSTER, balanced: bool = False
    ) -> DataFrame:
        path = f"{folder}/{name}"
        sinks.write_partitioned(df, path, cluster, balanced=balanced)
        return spark.read.parquet(path).select(*df.columns)

    def kept_by(name: str, df: DataFrame, run: str) -> DataFrame:
        path = f"{folder}/{name}"
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("run").parquet(path)
        return spark.read.parquet(path).select(*df.columns)

    with scratch_scope(spark):
        rows = bronze_table.dedupe_bronze(bronze) if dedupe else bronze
        tables = {"silver": stored("silver", silver.silver(rows, holidays, distances))}
        tables["gold"] = stored("gold", gold.gold(tables["silver"]))
        tables["gold_rulebased"] = stored("gold_rulebased", gold.gold_rulebased(tables["gold"]), balanced=True)
        counts = materialize(training.value_counts(tables["gold"], list(FREQUENCY_FEATURES)))
        # few codes are broadcast, so the rows stay as gold holds them
        few = counts.count() <= BROADCAST_ROWS
        tables["gold_train"] = stored("gold_train", training.gold_train(tables["gold"], counts), balanced=few)
        checks = {"gold_train": _unique_checks("gold_train", tables["gold_train"])}

        path, started = f"{folder}/pred_raw", time.monotonic()
        missing = sinks.write_predictions(model.predict(tables["gold_train"], run_time), path)
        seconds = time.monotonic() - started
        this_run = F.col("prediction_timestamp") == F.lit(run_time).cast("timestamp")
        predictions = spark.read.parquet(path).filter(this_run).drop("prediction_date")
        tables["pred_raw"] = predictions
        checks["pred_raw"] = _unique_checks("pred_raw", predictions)
        ranking = rank_values(predictions, risk.SCORE)
        n_features = len(model.feature_names(tables["gold_train"]))
        metrics = model.training_metrics(predictions, f"isolation_forest_{run_time}", run_time, seconds, n_features, ranking=ranking)
        tables["metrics_training"] = kept_by("metrics_training", metrics, run_time)
        viz = risk.pred_viz(tables["pred_raw"], ranking)
        viz.write.mode("overwrite").parquet(f"{folder}/pred_viz")
        tables["pred_viz"] = spark.read.parquet(f"{folder}/pred_viz")
        # what reviewers decided stays
        history = status.read_history(spark, f"{folder}/{HISTORY}")
        master = status.fold_history(risk.master_viz(tables["gold"], tables["pred_viz"]), history)
        tables["master_viz"] = stored("master_viz", master, sinks.MASTER_CLUSTER)
        # one scan of the table for all rollups
        cells.write_cells(tables["master_viz"], f"{folder}/{CELLS}")
        tables[CELLS] = cells.read_cells(spark, f"{folder}/{CELLS}")
        as_of = run_time[:10]
        for name, rollup in (("stats", cells.stats_summary), ("stats_month", cells.stats_month)):
            rollup(tables[CELLS], as_of).write.mode("overwrite").parquet(f"{folder}/{name}")
            tables[name] = spark.read.parquet(f"{folder}/{name}")
        found = [
            checks[name] if name in checks else quality.check_table(name, tables[name]) for name in quality.CHECKED
        ]
        found.append(quality.missing_columns("pred_raw", predictions, missing))
        reduce(DataFrame.unionByName, found).write.mode("overwrite").parquet(f"{folder}/checks")
        tables["checks"] = spark.read.parquet(f"{folder}/checks")
    return tables


def _unique_checks(name: str, table: DataFrame) -> DataFrame:
    """The data tests of a table, stored, after its ids were found to be unique by them."""
    checks = materialize(quality.check_table(name, table))
    if not checks.filter("test = 'unique' AND failures > 0").isEmpty():
        raise ValueError(f"transaction_id is not unique in {name}")
    return checks
