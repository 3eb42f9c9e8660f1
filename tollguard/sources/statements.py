"""Raw toll statements: reading CSV and normalising it to bronze text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard import lookups
from tollguard.functions import cleaning
from tollguard.schemas import BRONZE_COLUMNS, CORRUPT_COLUMN, RAW_COLUMNS, RAW_TO_BRONZE
from tollguard.session import materialize
from tollguard.sources import records

MAX_BAD_ROWS = 100

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    "columnPruning": False,
    "enforceSchema": False,
}
COMMA_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def statement_schema(headers: Sequence[str] = RAW_COLUMNS) -> T.StructType:
    """All-text schema in file order, plus the column that receives rows CSV cannot fit."""
    return T.StructType([T.StructField(h, T.StringType()) for h in [*headers, CORRUPT_COLUMN]])


def is_bad_row(headers: Sequence[str] = RAW_COLUMNS) -> Column:
    """More fields than headers. Short rows are fine, their missing fields are NULL.

    The test names a data column too, as Spark refuses to read the record column alone.
    """
    record = F.coalesce(F.col(CORRUPT_COLUMN), F.col(f"`{headers[0]}`"))
    fields = F.size(F.split(record, COMMA_OUTSIDE_QUOTES))
    return F.col(CORRUPT_COLUMN).isNotNull() & (fields > len(headers))


def has_quoted_newlines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line holds an odd number of quotes, so that a quoted field goes on after it."""
    return not records.quote_parity(spark, path).filter("_quoted = 1").isEmpty()


def scan_statements(
    spark: SparkSession,
    path: str | list[str],
    headers: Sequence[str],
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """Statement rows as text with ``source_name``, the file they came from.

    Files are split, and quoted newlines are kept also where they cross splits. Unless told that
    there are none, a pass over the lines counts the quotes of each split; only if some line holds
    an odd number, a second one puts the records together (``sources.records``) and stores them.
    """
    schema = statement_schema(headers)
    if quoted_newlines is not False:
        parity = materialize(records.quote_parity(spark, path))
        if not parity.filter("_quoted = 1").isEmpty():
            parts = materialize(records.read_records(spark, path, parity, headers))
            whole = records.whole_records(parts)
            ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
            options = {k: str(v) for k, v in CSV_OPTIONS.items() if k in ("quote", "escape", "mode", "columnNameOfCorruptRecord")}
            rows = whole.select("path", F.from_csv("record", ddl, options).alias("_row"))
            names = parity.select(F.col("_path").alias("path"), "_name").distinct()
            return rows.join(F.broadcast(names), "path").select("_row.*", F.col("_name").alias("source_name"))
    rows = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return rows.withColumn("source_name", F.col("_metadata.file_name"))


def within_budget(bad: DataFrame, path: str, max_bad_rows: int) -> None:
    """Raise if there are more bad rows than allowed."""
    found = bad.count()
    if found > max_bad_rows:
        raise ValueError(f"{found} bad rows in {path}, allowed are {max_bad_rows}")


def rejected(
    bad: DataFrame, loaded_at: str, headers: Sequence[str] = RAW_COLUMNS
) -> DataFrame:
    """Bad rows as ``source_file``, ``record`` (the line as it stands) and ``loaded_at``."""
    first = F.coalesce(F.col(CORRUPT_COLUMN), F.col(f"`{headers[0]}`"))
    return bad.select(
        F.col("source_name").alias("source_file"), first.alias("record"),
        F.lit(loaded_at).alias("loaded_at"),
    )


def read_rejected(
    spark: SparkSession,
    path: str | list[str],
    loaded_at: str,
    headers: Sequence[str] | None = None,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """The rows that :func:`read_statements` leaves out."""
    headers = headers or spark.read.option("header", True).csv(path).columns
    rows = scan_statements(spark, path, headers, quoted_newlines)
    return rejected(rows.filter(is_bad_row(headers)), loaded_at, headers)


def read_statements(
    spark: SparkSession,
    path: str | list[str],
    headers: Sequence[str] | None = None,
    max_bad_rows: int = MAX_BAD_ROWS,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """Statement rows without the bad ones; more than ``max_bad_rows`` of them is an error.

    The header line gives the columns unless ``headers`` does; a file with another header fails
    the read instead of filling the wrong columns.
    """
    headers = headers or spark.read.option("header", True).csv(path).columns
    rows = scan_statements(spark, path, headers, quoted_newlines)
    bad = is_bad_row(headers)
    within_budget(rows.filter(bad), path, max_bad_rows)
    return rows.filter(~bad).drop(CORRUPT_COLUMN)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim headers and rename the known ones to snake case; unknown ones stay."""
    return df.withColumnsRenamed(
        {name: RAW_TO_BRONZE.get(name.strip(), name.strip()) for name in df.columns}
    )


def normalize_dates(df: DataFrame) -> DataFrame:
    columns = [c for c in ("posting_date", "transaction_date") if c in df.columns]
    return df.withColumns({c: cleaning.statement_date(c) for c in columns})


def normalize_times(df: DataFrame) -> DataFrame:
    """Entry and exit times become full timestamps; needs normalised dates."""
    if "transaction_date" not in df.columns:
        return df
    columns = [c for c in ("entry_time", "exit_time") if c in df.columns]
    return df.withColumns({c: cleaning.statement_time("transaction_date", c) for c in columns})


def normalize_money(df: DataFrame) -> DataFrame:
    columns = [c for c in ("amount", "balance") if c in df.columns]
    return df.withColumns({c: cleaning.statement_money(c) for c in columns})


def add_lineage(df: DataFrame, loaded_at: str, source_file: str = "source_name") -> DataFrame:
    """``loaded_at`` (one value per run) and ``source_file`` from the column that names the file."""
    return df.withColumns({"loaded_at": F.lit(loaded_at), "source_file": F.col(source_file)})


def normalize(df: DataFrame, loaded_at: str) -> DataFrame:
    """Statement rows to bronze rows."""
    rows = normalize_money(normalize_times(normalize_dates(normalize_headers(df))))
    return add_lineage(rows, loaded_at).select(*BRONZE_COLUMNS)


def statement_period(df: DataFrame, run_date: str, name_column: str = "source_file") -> DataFrame:
    """Year and month of a statement from its file name.

    ``2024-03``, ``2024_03`` or ``202403`` wins; then ``transactions March 2024``; else the run
    date. A named month that is not one also falls back to the run date.
    """
    name = F.lower(F.col(name_column))
    digits, words = r"(\d{4})[-_]?(\d{2})", r"transactions?\s+(\w+)\s+(\d{4})"
    word_month = F.regexp_extract(name, words, 1)
    months = F.create_map(*[F.lit(part) for item in lookups.MONTHS.items() for part in item])
    numeric, named = name.rlike(digits), F.try_element_at(months, word_month).isNotNull()

    def pick(digit_group: int, word_value, run_value):
        return (
            F.when(numeric, F.regexp_extract(name, digits, digit_group).cast("int"))
            .when(named, word_value)
            .otherwise(run_value)
        )

    run = F.lit(run_date).cast("date")
    word_year = F.regexp_extract(name, words, 2).try_cast("int")
    return df.withColumns({
        "statement_year": pick(1, word_year, F.year(run)),
        "statement_month": pick(2, F.try_element_at(months, word_month), F.month(run)),
    })
