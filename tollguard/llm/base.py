"""What several operators share: exact global ranks, the word pattern, plain constants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollguard.session import materialize

#: A word is a run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of the whole text as a long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def portions(
    batches: Iterator[pa.RecordBatch], text: int, rows: int = 256, size: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows, and of about ``size`` bytes of the column
    ``text`` unless one value is larger, so that a worker has few texts as Python objects at a time.
    Memory that Arrow holds back goes to the system after each batch."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        low = held = 0
        for i, n in enumerate(lengths):
            if i > low and (i - low >= rows or held + n > size):
                yield batch.slice(low, i - low)
                low, held = i, 0
            held += n
        if low < batch.num_rows:
            yield batch.slice(low)
        del batch
        pa.default_memory_pool().release_unused()


def ranked(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """``df`` with its exact position (from 0) in the order of ``order``, and no single-task sort.

    Rows are range-partitioned and sorted once, with a running number of partition and place, and
    written. The place becomes the rank by adding the rows of the partitions before: one count per
    partition, which is all that passes through the driver. A hot key spreads over many ranges as
    long as later columns of ``order`` tell its rows apart.
    """
    at, part = f"{name}_at", f"{name}_part"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(placed.withColumn(at, F.monotonically_increasing_id()))
    stored = stored.withColumn(part, F.shiftright(at, 33))
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in stored.groupBy(part).count().collect()):
        before.append((p, total - (p << 33)))
        total += n
    shift = df.sparkSession.createDataFrame(before, f"{part} long, {name}_shift long")
    return (
        stored.join(F.broadcast(shift), part)
        .withColumn(name, F.col(at) + F.col(f"{name}_shift"))
        .drop(part, at, f"{name}_shift")
    )
