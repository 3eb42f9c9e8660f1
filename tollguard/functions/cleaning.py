"""Text, date, time and money cleaning. Nothing here raises on bad input under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(column: str, upper: bool = False) -> Column:
    """Trim, optionally upper-case; the placeholder ``-`` becomes NULL."""
    text = F.trim(F.col(column))
    return F.nullif(F.upper(text) if upper else text, F.lit("-"))


def parse_date(column: str) -> Column:
    """``yyyy-MM-dd`` text to a date, NULL if it is not one."""
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-M-d")).cast("date")


def parse_second(column: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp, NULL if it is not one."""
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-M-d H:m:s"))


def parse_time_midnight_null(column: str) -> Column:
    """As :func:`parse_second`; exactly midnight is a placeholder and becomes NULL."""
    time = parse_second(column)
    return F.when(time != F.date_trunc("day", time), time)


#: Fixed value: what counts as a number. Type letters, hexadecimal digits and words do not.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def plain_number(text: Column) -> Column:
    """A finite decimal number; any other text, such as ``60d``, ``NaN`` or ``Infinity``, is NULL."""
    number = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def parse_number(column: str) -> Column:
    return plain_number(F.col(column))


def statement_date(column: str) -> Column:
    """``M/d/yyyy`` (or already ISO) text to ``yyyy-MM-dd`` text, NULL if it is neither."""
    text = F.trim(F.col(column))
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("yyyy-M-d"))
    )
    return parsed.cast("date").cast("string")


def statement_time(date_column: str, time_column: str) -> Column:
    """Normalised date and ``HH:mm:ss`` text to timestamp text; ``-`` and bad times become NULL."""
    text = F.nullif(F.trim(F.col(time_column)), F.lit("-"))
    parsed = F.try_to_timestamp(
        F.concat(F.col(date_column), F.lit(" "), text), F.lit("yyyy-MM-dd H:m:s")
    )
    return parsed.cast("string")


def statement_money(column: str) -> Column:
    """``$1,234.50`` and ``($60.56)`` to plain signed number text, NULL if not a number."""
    text = F.regexp_replace(F.trim(F.col(column)), r"[$,]", "")
    bare = F.regexp_replace(text, r"[()]", "")
    signed = F.when(text.rlike(r"\(.*\)"), F.concat(F.lit("-"), bare)).otherwise(text)
    return plain_number(signed).cast("string")
