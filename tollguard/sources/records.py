"""CSV records of files that are read in blocks, where a quoted newline may cross a block's edge."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks of the files that are read at once; there is one per ``spark.sql.files.maxPartitionBytes``.
MAX_BLOCKS = 1_000_000
#: A whole record; the first lines of one that the next block goes on with; a block inside one; its
#: last lines.
WHOLE, BEGIN, INSIDE, END = range(4)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def quote_parity(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_path, _start, _name, _odd, _quoted): for each block of each file whether it holds an odd number of
    quotes, and whether one of its lines does."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return _lines(spark, path).groupBy("_path", "_start").agg(
        F.first("_name").alias("_name"), (F.sum(quotes) % 2).alias("_odd"), F.max(quotes % 2).alias("_quoted")
    )


def _open_blocks(parity: DataFrame) -> DataFrame:
    """(_path, _start, _open): whether a block begins within a quoted field, which is the case if the
    blocks of its file before it hold an odd number of quotes."""
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2
    return parity.select("_path", "_start", (odd == 1).alias("_open"))


class _Block:
    """What is left of the block that a task is reading: an open record, and whether it began
    before the block."""

    def __init__(self, path: str, start: int, is_open: bool | None) -> None:
        if is_open is None:
            raise RuntimeError(f"{path} was cut into other blocks than before; run the load again")
        self.path, self.start, self.open, self.early = path, start, int(is_open), is_open
        self.lines: list[str] = []
        self.header = start == 0

    def close(self, line: str) -> tuple[int, str]:
        kind, record = END if self.early else WHOLE, "\n".join([*self.lines, line])
        self.lines, self.early = [], False
        return kind, record

    def rest(self) -> list[tuple[int, str]]:
        return [(INSIDE if self.early else BEGIN, "\n".join(self.lines))] if self.lines else []


def _check_header(path: str, record: str, headers: Sequence[str]) -> None:
    found = next(csv.reader([record.removesuffix("\r").removeprefix("﻿")]), [])
    if [h.lower() for h in found] != [h.lower() for h in headers]:
        raise ValueError(f"{path} has the header {found}, expected is {list(headers)}")


def read_records(spark: SparkSession, path: str | list[str], parity: DataFrame, headers: Sequence[str]) -> DataFrame:
    """(path, start, kind, record) of all files, without header lines; ``whole_records`` puts the
    parts together. Each block is read by itself, whatever quoted newlines it holds.

    ``parity`` is ``quote_parity`` of the same files, stored; its prefix sums over a file tell which
    blocks begin in a quoted field. One row per block is broadcast. Quotes stand around fields or
    are doubled in them; a line may end in ``\\r\\n``. Records of nothing but blanks are left out. A
    file with another header than ``headers`` stops the read.
    """
    if parity.count() > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks, load fewer files at a time")
    lines = _lines(spark, path).drop("_name").join(F.broadcast(_open_blocks(parity)), ["_path", "_start"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None

        def part(rows: list[tuple[_Block, int, str]]) -> pa.RecordBatch:
            rows = [(b.path, b.start, k, r.removesuffix("\r") if k in (WHOLE, END) else r) for b, k, r in rows]
            rows = [r for r in rows if r[2] != WHOLE or r[3].strip()]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "start", "kind", "record"]
            )

        for batch in batches:
            values, paths, starts, opens = (batch.column(k) for k in range(4))
            odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
            where = starts.to_numpy(zero_copy_only=False)
            named = paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((where[1:] != where[:-1]) | (named[1:] != named[:-1])) + 1
            for low, high in zip([0, *new], [*new, batch.num_rows]):
                if low == high:
                    continue
                out: list[tuple[_Block, int, str]] = []
                key = paths[low].as_py(), starts[low].as_py()
                if block is None or key != (block.path, block.start):
                    out += [(block, *r) for r in block.rest()] if block else []
                    block = _Block(*key, opens[low].as_py())
                after = (block.open + np.cumsum(odd[low:high])) % 2
                inside = after.astype(bool) | np.concatenate([[block.open], after[:-1]]).astype(bool)
                block.open = int(after[-1])
                for at in range(low, high, 4096):
                    own = slice(at - low, min(at + 4096, high) - low)
                    for line, held, is_open in zip(
                        values.slice(at, own.stop - own.start).to_pylist(), inside[own].tolist(), after[own].tolist()
                    ):
                        if is_open:
                            block.lines.append(line)
                            continue
                        kind, record = block.close(line) if held else (WHOLE, line)
                        if block.header:
                            block.header = False
                            _check_header(block.path, record, headers)
                        else:
                            out.append((block, kind, record))
                    yield part(out)
                    out = []
        if block is not None:
            yield part([(block, *r) for r in block.rest()])

    lines = lines.select("value", "_path", "_start", "_open")
    return lines.mapInArrow(run, "path string, start long, kind int, record string")


def whole_records(parts: DataFrame) -> DataFrame:
    """(path, record): the records of ``read_records``, stored, with those that cross blocks put
    together. Only their parts, at most two a block, are shuffled."""
    order = Window.partitionBy("path").orderBy("start", F.col("kind") == BEGIN)
    cut = parts.filter(F.col("kind") != WHOLE).withColumn(
        "_record", F.sum((F.col("kind") == BEGIN).cast("int")).over(order)
    )
    joined = cut.groupBy("path", "_record").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("_parts")
    )
    across = joined.select("path", F.array_join("_parts.record", "\n").alias("record"))
    return parts.filter(F.col("kind") == WHOLE).select("path", "record").unionByName(across)
