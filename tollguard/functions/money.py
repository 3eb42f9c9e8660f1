"""Money statistics that do not depend on row order.

Amounts are doubles, as in the tables. Sums and squares are taken over whole cents held in
doubles: whole numbers add up exactly (below 2**53), so a retry, another partitioning or a
merge in another order gives the same bits, and tests such as ``today == rolling max`` hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    return F.rint(amount * F.lit(100.0))


def dollars(total_cents: Column) -> Column:
    return total_cents / F.lit(100.0)


def mean_dollars(total_cents: Column, count: Column) -> Column:
    return F.try_divide(total_cents, count) / F.lit(100.0)


def sample_std_dollars(total_cents: Column, total_squares: Column, count: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares; NULL below two values."""
    n = count.cast("double")
    spread = F.greatest(n * total_squares - total_cents * total_cents, F.lit(0.0))
    return F.when(count > 1, F.sqrt(F.try_divide(spread, n * (n - 1))) / F.lit(100.0))


def sum_dollars(amount: Column) -> Column:
    """Aggregate: order-independent ``SUM(amount)``."""
    return dollars(F.sum(cents(amount)))
