"""Data-quality checks. Each returns what is wrong; an empty or zero result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollguard import lookups

# Columns that must not be NULL, per table.
NOT_NULL = {
    "silver": ["transaction_date", "tag_plate_number", "agency", "amount"],
    "gold": ["transaction_id", "transaction_date", "tag_plate_number", "agency", "amount"],
    "gold_train": ["transaction_id", "transaction_date", "tag_plate_number", "amount"],
    "master_viz": ["transaction_id"],
    "pred_raw": ["transaction_id"],
}
# Tables whose ids are unique, and tables whose agency codes are listed.
UNIQUE = ["gold_train", "pred_raw", "master_viz"]
ACCEPTED = ["silver", "gold"]
CHECKED = ["silver", "gold", "gold_train", "pred_raw", "master_viz"]


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of NULLs per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def check_table(name: str, df: DataFrame) -> DataFrame:
    """All data tests of a table: ``table_name, test, column_name, failures`` (rows for NULLs,
    values for the other tests).

    ``df`` is computed once: NULLs are counted per id or agency, on whose groups the other test looks.
    """
    key = "transaction_id" if name in UNIQUE else "agency"
    groups = df.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in NOT_NULL[name]]
    )
    failures = [("not_null", c, F.coalesce(F.sum(c), F.lit(0))) for c in NOT_NULL[name]]
    if name in UNIQUE:
        failures.append(("unique", key, F.count_if(F.col("_key").isNotNull() & (F.col("_rows") > 1))))
    elif name in ACCEPTED:
        accepted = [code for code, _, _ in lookups.AGENCIES]
        failures.append(("accepted_values", key, F.count_if(F.col("_key").isNotNull() & ~F.col("_key").isin(accepted))))
    found = groups.agg(F.array(*[
        F.struct(F.lit(test).alias("test"), F.lit(c).alias("column_name"), n.alias("failures")) for test, c, n in failures
    ]).alias("_found"))
    return found.select(F.inline("_found")).select(F.lit(name).alias("table_name"), "test", "column_name", "failures")


def missing_columns(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """A failure for each column that a table should have and lacks, in the layout of ``check_table``."""
    rows = [(name, "present", c, 1) for c in columns]
    schema = "table_name string, test string, column_name string, failures long"
    return df.sparkSession.createDataFrame(rows, schema)


def check_unique(df: DataFrame, column: str = "transaction_id") -> DataFrame:
    """Values that occur more than once, with their count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counts.filter(F.col("rows") > 1)


def check_accepted_values(
    df: DataFrame, column: str = "agency", accepted: list[str] | None = None
) -> DataFrame:
    """Values outside the list, with their count; NULL is not a value."""
    accepted = accepted or [code for code, _, _ in lookups.AGENCIES]
    outside = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(accepted))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
