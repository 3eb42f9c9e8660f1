"""Status updates of reviewed transactions, as a batch.

States only move forward (Needs Review, Investigating, resolved), and a missing status takes
whatever comes first. So at most three requests per transaction can be accepted, and which
ones follows from three minima per transaction: its first request, first "Investigating" and
first resolution. These combine map-side, so a transaction with very many requests is no hot
key, and no request order has to be replayed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollguard.lookups import INVESTIGATING, NEEDS_REVIEW, RESOLVED

# Reasons of rejection.
MISSING = "Missing transactionId or newStatus"
NOT_FOUND = "Transaction not found"
INVALID = "Invalid status transition"

REQUEST = ["transaction_id", "new_status", "seq"]


def _missing() -> Column:
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("transaction_id", "new_status")]
    return empty[0] | empty[1]


def _first(condition: Column | None = None) -> Column:
    request = F.struct("seq", "new_status")
    return F.min(request if condition is None else F.when(condition, request))


def accepted_steps(master: DataFrame, updates: DataFrame) -> DataFrame:
    """Per requested transaction: its status and the accepted requests in order (``steps``).

    ``updates`` has ``transaction_id, new_status, seq``; ``seq`` gives the order of requests.
    """
    status = F.col("new_status")
    wanted = updates.filter(~_missing()).groupBy("transaction_id").agg(
        _first().alias("first"),
        _first(status == INVESTIGATING).alias("investigating"),
        _first(status.isin(RESOLVED)).alias("resolved"),
    )
    current = master.select("transaction_id", F.col("status").alias("current_status"))
    start = F.col("current_status")
    # A missing status becomes that of the first request, which is then the state to go on from.
    state = F.coalesce(start, F.col("first.new_status"))
    opening = F.when(start.isNull(), F.col("first"))
    investigating, resolved = F.col("investigating"), F.col("resolved")
    early = resolved.isNull() | (investigating < resolved)
    look = F.when((state == NEEDS_REVIEW) & early, investigating)
    close = F.when(state.isin(NEEDS_REVIEW, INVESTIGATING), resolved)
    return wanted.join(current, "transaction_id").select(
        "transaction_id",
        "current_status",
        F.array_compact(F.array(opening, look, close)).alias("steps"),
    )


def review_requests(master: DataFrame, updates: DataFrame) -> DataFrame:
    """Every request with ``accepted``, the status it met and the reason if rejected.

    Of requests equal in transaction, ``seq`` and status one is the first; the others come after
    it and meet the status it set.
    """
    steps = accepted_steps(master, updates)
    equal = Window.partitionBy(*REQUEST).orderBy("seq")
    asked = updates.select(*REQUEST).withColumns({
        "_missing": _missing(), "_again": F.row_number().over(equal) > 1,
    })
    joined = asked.join(steps, "transaction_id", "left")
    this = F.struct("seq", "new_status")
    found = F.col("steps").isNotNull() & ~F.col("_missing")
    again = F.col("_again")
    accepted = F.coalesce(found & F.array_contains("steps", this) & ~again, F.lit(False))
    before = F.filter("steps", lambda step: (step < this) | (again & (step == this)))
    met = F.when(F.size(before) > 0, F.get(before, F.size(before) - 1)["new_status"]).otherwise(
        F.col("current_status")
    )
    reason = (
        F.when(F.col("_missing"), MISSING)
        .when(~found, NOT_FOUND)
        .when(~accepted, INVALID)
    )
    return joined.select(
        *REQUEST, accepted.alias("accepted"), F.when(found, met).alias("current_status"),
        reason.alias("reason"),
    )


def apply_status_updates(master: DataFrame, updates: DataFrame, updated_at: str) -> DataFrame:
    """The master table after all accepted requests; touched rows get ``last_updated``."""
    final = accepted_steps(master, updates).filter(F.size("steps") > 0).select(
        F.col("transaction_id").alias("_id"),
        F.get("steps", F.size("steps") - 1)["new_status"].alias("_status"),
    )
    joined = master.join(final, master["transaction_id"] == F.col("_id"), "left")
    touched = F.col("_id").isNotNull()
    return joined.withColumns({
        "status": F.when(touched, F.col("_status")).otherwise(F.col("status")),
        "last_updated": F.when(touched, F.lit(updated_at).cast("timestamp")).otherwise(
            F.col("last_updated")
        ),
    }).select(*master.columns)
