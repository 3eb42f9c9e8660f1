"""Windows over preceding rows that survive a hot key.

A window hands a whole key to one task. Keys beyond ``HOT_ROWS`` are therefore cut into
pieces along the sort order, and each piece is given copies of the last ``reach`` rows before
it, which is all its window columns can see. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from tollguard.operators.search import piece_of
from tollguard.operators.skew import HOT_ROWS, hot_keys, matching

TIES = ["transaction_id", "source_file"]
GRID = 4096
ID_SPACE = 1 << 24
BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Lookback:
    """Window columns that read at most ``reach`` preceding rows.

    ``position`` is a non-null bigint, the first sort key; ties go by ``TIES``. ``derived``
    columns are made from the window columns; those starting with ``_`` are dropped after.
    """

    position: Callable[[], Column]
    reach: int
    reads: list[str]
    columns: Callable[[WindowSpec], dict[str, Column]]
    derived: Callable[[], dict[str, Column]] = dict

    def add(self, df: DataFrame, window: WindowSpec) -> DataFrame:
        columns = self.columns(window)
        helpers = [name for name in columns if name.startswith("_")]
        return df.withColumns(columns).withColumns(self.derived()).drop(*helpers)


def split_hot(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None, list[Row]]:
    """``df`` without its hot keys, the rows of the hot keys (None if there are none), the keys."""
    hot = hot_keys(df, key, hot_rows)
    if not hot:
        return df, None, hot
    keys = df.sparkSession.createDataFrame(
        [(row[key],) for row in hot], f"_hot {df.schema[key].dataType.simpleString()}"
    )
    on = matching(df, {key: "_hot"}, null_safe=True)
    return (
        df.join(F.broadcast(keys), on, "left_anti"),
        df.join(F.broadcast(keys), on, "left_semi"),
        hot,
    )


def plain(df: DataFrame, key: str, lookback: Lookback) -> DataFrame:
    """One window per key."""
    window = Window.partitionBy(key).orderBy("_at", *TIES)
    placed = df.withColumn("_at", lookback.position())
    return lookback.add(placed, window).drop("_at")


def _edges(hot: DataFrame, key: str, hot_rows: int) -> list[Row]:
    """Cut points per hot key: about two per ``hot_rows`` rows, so bounded by the row count."""
    grid = F.percentile_approx("_at", [i / GRID for i in range(GRID)], 20 * GRID)
    pieces = F.least(F.lit(GRID), F.ceil(2 * F.count(F.lit(1)) / hot_rows)).cast("int")
    sized = hot.groupBy(key).agg(grid.alias("grid"), pieces.alias("pieces"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("pieces") - 1, F.lit(1))),
        lambda i: F.get("grid", F.floor(i * GRID / F.col("pieces")).cast("int")),
    )
    return sized.select(key, cuts.alias("cuts")).collect()


def _spread_ties(cuts: list[int]) -> list[tuple[int, int]]:
    """A position cut m times (many equal times) is cut m ways along the transaction id."""
    edges = []
    for at, run in groupby(sorted(cuts)):
        times = len(list(run))
        edges += [(at, part * ID_SPACE // times) for part in range(times)]
    return edges


def fold_copies(hot: DataFrame, reach: int, hot_rows: int) -> tuple[DataFrame, bool]:
    """Replace very many equal rows by ``reach + 1`` of them, the last one counting the rest.

    Behind ``reach`` copies every further copy sees only copies, so they all get the same window
    values, and so does any later row that looks back. ``_more`` is the number of rows left out,
    ``_same`` keeps equal rows next to each other in the order.
    """
    none = {"_more": F.lit(0).cast("bigint"), "_same": F.lit(0).cast("bigint")}
    ids = hot_keys(hot, "transaction_id", hot_rows)
    if not ids:
        return hot.withColumns(none), False
    keys = F.broadcast(
        hot.sparkSession.createDataFrame([(row["transaction_id"],) for row in ids], "_hot_id string")
    )
    on = matching(hot, {"transaction_id": "_hot_id"}, null_safe=True)
    rows = hot.join(keys, on, "left_semi").groupBy(*hot.columns).agg(F.count(F.lit(1)).alias("_n"))
    kept = F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(reach + 1)))).alias("_copy")
    rest = F.when(F.col("_copy") == reach + 1, F.col("_n") - F.col("_copy")).otherwise(0)
    copies = rows.select("*", kept).withColumns({
        "_more": rest.cast("bigint"), "_same": F.xxhash64(*hot.columns),
    })
    others = hot.join(keys, on, "left_anti").withColumns(none)
    return others.unionByName(copies.drop("_n", "_copy")), True


def unfold_copies(df: DataFrame) -> DataFrame:
    """Undo :func:`fold_copies`, a million rows per block, blocks spread over tasks."""
    block = F.explode(F.sequence(F.lit(0), F.floor(F.col("_more") / BLOCK_ROWS).cast("int")))
    spread = df.withColumn("_block", block).repartition("transaction_id", "_block")
    size = F.least(F.lit(BLOCK_ROWS), F.col("_more") + 1 - F.col("_block") * BLOCK_ROWS)
    row = F.explode(F.sequence(F.lit(1), size.cast("int")))
    return spread.withColumn("_row", row).drop("_block", "_row")


def in_pieces(hot: DataFrame, key: str, lookback: Lookback, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same columns as :func:`plain`, for keys too large for one task."""
    spark = hot.sparkSession
    folded, has_copies = fold_copies(hot, lookback.reach, hot_rows)
    placed = folded.withColumn("_at", lookback.position())
    ties = [*TIES, "_same"]
    edges = [(row[key], _spread_ties(row["cuts"])) for row in _edges(placed, key, hot_rows)]
    table = spark.createDataFrame(
        edges,
        f"_hot {hot.schema[key].dataType.simpleString()}, "
        "_edges array<struct<at:bigint,part:int>>",
    )
    part = F.conv(F.substring("transaction_id", 1, 6), 16, 10).cast("int")
    here = F.struct(F.col("_at").alias("at"), part.alias("part"))
    longest = max(len(cuts) for _, cuts in edges)
    pieced = (
        placed.join(F.broadcast(table), matching(placed, {key: "_hot"}, null_safe=True))
        .withColumn("_piece", piece_of(F.col("_edges"), here, longest))
        .drop("_hot", "_edges")
    )

    # The last `reach` rows of every piece, and from them the last `reach` rows before each
    # next piece, also when the pieces in between are shorter than `reach`.
    seen = list(dict.fromkeys([key, "_at", *ties, *lookback.reads]))
    latest = Window.partitionBy(key, "_piece").orderBy(F.desc("_at"), *map(F.desc, ties))
    tails = (
        pieced.select("_piece", *seen)
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= lookback.reach)
    )
    by_key = Window.partitionBy(key).orderBy("_piece", F.desc("_rank"))
    ends = tails.withColumn(
        "_before",
        F.collect_list(F.struct(*seen)).over(by_key.rowsBetween(1 - lookback.reach, 0)),
    ).filter(F.col("_rank") == 1)
    halo = (
        ends.select(
            F.lead("_piece").over(Window.partitionBy(key).orderBy("_piece")).alias("_piece"),
            "_before",
        )
        .filter(F.col("_piece").isNotNull())
        .select("_piece", F.inline("_before"), F.lit(True).alias("_halo"))
    )

    window = Window.partitionBy(key, "_piece").orderBy("_at", *ties)
    rows = pieced.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    done = lookback.add(rows, window).filter(~F.col("_halo")).drop("_halo", "_piece", "_at")
    return (unfold_copies(done) if has_copies else done).drop("_more", "_same")


def add_lookback(
    df: DataFrame, key: str, lookback: Lookback, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add one set of lookback columns, whatever the size of the largest key."""
    cold, hot, _ = split_hot(df, key, hot_rows)
    result = plain(cold, key, lookback)
    if hot is None:
        return result
    return result.unionByName(in_pieces(hot, key, lookback, hot_rows))
