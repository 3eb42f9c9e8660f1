"""Exact medians of several columns in a few reads and bounded memory.

Each wanted rank is kept in an open interval. The first read counts the values of all columns and
brackets their middle by mergeable approximate quantiles of a bounded error, so the bracket holds at
most a known share of the rows. The next read counts the rows on either side of the bracket and, in
the same pass, fetches the values inside if that share is few enough, or brackets the rank again. Two
reads do up to sixteen million values a column, three to ten billion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FETCH_ROWS = 20_000
#: Approximate quantiles are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000
#: Half the width of a bracket, and the step between the quantiles that later brackets are cut from.
MARGIN = 5e-4
STEPS = round(1 / MARGIN)


@dataclass
class _Rank:
    """A rank that lies between ``low`` and ``high``, with ``inside`` values there and ``below`` before
    them; ``span`` is the bracket to try, which holds at most ``width`` of the values inside."""

    column: str
    rank: int
    inside: int
    span: tuple[float, float] | None = None
    width: float = 1.0
    below: int = 0
    low: float = -inf
    high: float = inf
    value: float | None = None

    def fetched(self, fetch_rows: int) -> bool:
        most = self.inside if self.span is None else ceil(self.inside * self.width) + 2
        return most <= fetch_rows

    def bracket(self) -> tuple[float, float]:
        return self.span or (self.low, self.high)

    def settle(self, answer, fetch_rows: int) -> None:
        """Narrow the interval by the counts, and read off the value or the next bracket."""
        under_low, at_low, under_high, at_high, inner = answer
        fetched, span = self.fetched(fetch_rows), self.bracket()
        (low, high), self.span = span, None
        if under_low <= self.rank < under_low + at_low:
            self.value = low
        elif under_high <= self.rank < under_high + at_high:
            self.value = high
        elif self.rank < under_low:
            self.high, self.inside = low, under_low - self.below
        elif self.rank >= under_high + at_high:
            self.inside = self.below + self.inside - under_high - at_high
            self.low, self.below = high, under_high + at_high
        else:
            self.low, self.high = low, high
            self.below, self.inside = under_low + at_low, under_high - under_low - at_low
            if not fetched:
                place = (self.rank - self.below + 0.5) / self.inside * STEPS
                first, last = max(floor(place - 0.5), 0), min(ceil(place + 0.5), STEPS)
                self.span, self.width = (inner[first], inner[last]), (last - first) / STEPS + 2 / ACCURACY
            elif inner is None:
                raise ValueError(f"rank {self.rank} of {self.column} cannot be read; did the rows change?")
            else:
                self.value = inner


def present(column: str) -> Column:
    """A finite value; NaN and infinite ones count as missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < inf), x)


def _answers(df: DataFrame, ranks: list[_Rank], fetch_rows: int) -> list[Row]:
    """For each rank, from one read of all: the values below, at the lower end, below and at the upper end
    of its bracket, and of the values inside the one of that rank or, if they are too many, quantiles.

    Batches are counted and the few values inside picked out by numpy; these travel, by rank.
    """
    columns = list(dict.fromkeys(r.column for r in ranks))
    asked = [(columns.index(r.column), *r.bracket()) for r in ranks]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            counts, inside = [], []
            for at, low, high in asked:
                x = values[at]
                counts.append([np.count_nonzero(t) for t in (x < low, x == low, x < high, x == high)])
                inside.append(x[(x > low) & (x < high)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(asked)), pa.int32()), *[pa.array(t, pa.int64()) for t in zip(*counts)],
                 pa.array(inside, pa.list_(pa.float64()))],
                names=["rank", *names, "inside"],
            )

    names = [f"t{i}" for i in range(4)]
    picked = df.select(*[present(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        read, f"rank int, {', '.join(f'{t} long' for t in names)}, inside array<double>"
    )
    # the counts stand beside no value, so that each is added once
    values = F.concat(F.array(F.lit(None).cast("double")), "inside")
    rows = picked.select("rank", *names, F.posexplode(values).alias("_at", "x")).select(
        "rank", "x", *[F.when(F.col("_at") == 0, F.col(t)).alias(t) for t in names]
    )
    places = F.get(F.array(*[F.lit(r.rank) for r in ranks]), F.col("rank")) - (F.sum("t0") + F.sum("t1"))
    one = F.get(F.sort_array(F.collect_list("x")), F.when(places >= 0, places).cast("int"))
    many = F.percentile_approx("x", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    found = {}
    for fetched, inner in ((True, one), (False, many)):
        mine = [i for i, r in enumerate(ranks) if r.fetched(fetch_rows) == fetched]
        if mine:
            part = rows.filter(F.col("rank").isin(mine)) if len(mine) < len(ranks) else rows
            answers = part.groupBy("rank").agg(*[F.sum(t).alias(t) for t in names], inner.alias("inner")).collect()
            found |= {a["rank"]: a[1:] for a in answers}
    return [found[i] for i in range(len(ranks))]


def exact_medians(
    df: DataFrame, columns: list[str], fetch_rows: int = FETCH_ROWS
) -> dict[str, float | None]:
    """Median per column (mean of the middle two if even), None if a column has no values.

    NaN and infinite values count as missing.
    """
    if not columns:
        return {}
    middle = [0.5 - MARGIN, 0.5 + MARGIN]
    counts = df.agg(*[
        F.struct(F.count(present(c)), F.percentile_approx(present(c), middle, ACCURACY)).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    ranks = [
        _Rank(c, rank, n, None if n <= fetch_rows else tuple(span), 2 * MARGIN + 2 / ACCURACY)
        for c, (n, span) in zip(columns, counts) if n
        for rank in sorted({(n - 1) // 2, n // 2})
    ]
    while open_ranks := [r for r in ranks if r.value is None]:
        for r, answer in zip(open_ranks, _answers(df, open_ranks, fetch_rows)):
            r.settle(answer, fetch_rows)
    found: dict[str, list[float]] = {}
    for r in ranks:
        found.setdefault(r.column, []).append(r.value)
    return {c: sum(found[c]) / len(found[c]) if c in found else None for c in columns}
