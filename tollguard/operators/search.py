"""Find the piece of a sorted edge list a value falls in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piece_of(edges: Column, value: Column, edge_count: int) -> Column:
    """Number of ``edges`` (ascending array, at most ``edge_count`` long) that are <= ``value``.

    Binary search inside one expression, so a row pays log2 of the edge count. NULL falls in 0.
    """
    steps = [1 << bit for bit in reversed(range(edge_count.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(edges, low + step - 1) <= value, low + step).otherwise(low),
    )
