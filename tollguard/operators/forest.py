"""Isolation forest on Spark: all trees grown level by level, rows scored in parallel.

Draws go by digests of the seed with the row id, the tree or the node, so the forest depends on the
seed and the data but not on partitioning, and SQL can state it. A tree sees at most 256 rows; the
data is only read to draw the samples and to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollguard.session import materialize

TREES = 100
SAMPLE_ROWS = 256
SEED = 42
#: A digest is read as that many hexadecimal digits.
DIGITS = 13
#: Rows that enter a tree, as a multiple of those it takes.
ENTER = 4
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
_SPAN = "struct<feature: int, low: double, high: double>"


@dataclass(frozen=True)
class Forest:
    """Node table as arrays of shape (trees, nodes); a leaf points at itself."""

    features: list[str]
    sample_rows: int
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray


def expected_path(rows: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree over ``rows`` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (log(rows - 1) + EULER_GAMMA) - 2.0 * (rows - 1) / rows


def _digest(*parts: Column, first: int = 1, digits: int = DIGITS) -> Column:
    """Hexadecimal digits of the MD5 of the parts, joined by colons, as a long."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def draw_samples(
    df: DataFrame,
    id_column: str,
    features: list[str],
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> tuple[DataFrame, int]:
    """``sample_rows`` rows per tree (fewer if there are fewer), and that number. Ids are unique.

    One rule and one digest per row at every size: the rows are to enter a tree ``ENTER`` times as
    often as it takes them, so each row enters the whole number of trees that its share and a random
    part add up to, in a row from a random tree on. Each tree takes the smallest digests of what
    entered it. The pass over the data is map-only; what travels depends on the trees alone.
    """
    total = df.count()
    taken = min(sample_rows, total)
    share = min(float(trees), ENTER * sample_rows * trees / max(total, 1))
    rows = df.select(F.col(id_column).alias("_id"), *[F.col(f).cast("double") for f in features])
    mine = F.lit("draw"), F.lit(seed), F.col("_id")
    entered = F.floor(F.lit(share) + _digest(*mine) / F.lit(float(1 << 4 * DIGITS)))
    start = _digest(*mine, first=DIGITS + 1, digits=8)
    drawn = rows.withColumn("_times", F.least(entered, F.lit(trees)).cast("int")).filter("_times > 0")
    drawn = drawn.withColumn("_start", start).select(
        "_id", *features,
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), lambda j: ((F.col("_start") + j) % trees).cast("int"))).alias("tree"),
    )
    order = Window.partitionBy("tree").orderBy(_digest(F.lit("pick"), F.lit(seed), F.col("tree"), F.col("_id")), "_id")
    picked = drawn.withColumn("_rank", F.row_number().over(order))
    return picked.filter(F.col("_rank") <= taken), taken


def grow_trees(samples: DataFrame, features: list[str], max_depth: int, seed: int = SEED) -> DataFrame:
    """The node table (``NODE_SCHEMA``) of all trees over ``samples`` (tree, features).

    All trees grow one level per round: the least and greatest values of the features are grouped by
    tree and node, digests of (seed, tree, node) choose one of the features that vary and a threshold
    between its ends, and the rows of split nodes move to their children. Nodes are numbered as in a
    heap from 0. A level has no more nodes than the samples have rows (256 a tree): it passes through
    the driver, where the forest goes in any case, and is broadcast to the rows.
    """
    spark = samples.sparkSession
    rows = samples.select("tree", *[F.col(f) for f in features], F.lit(0).alias("_node"))
    place = F.lit(seed), F.col("tree"), F.col("_node")
    spans = F.array(*[
        F.struct(F.lit(k).alias("feature"), F.min(f).alias("low"), F.max(f).alias("high")) for k, f in enumerate(features)
    ])
    at = F.pmod(_digest(F.lit("feature"), *place), F.greatest(F.size("_spans"), F.lit(1))).cast("int")
    low, high = F.col("_split.low"), F.col("_split.high")
    threshold = low + _digest(F.lit("threshold"), *place) / F.lit(float(1 << 4 * DIGITS)) * (high - low)
    value = F.element_at(F.array(*features), F.col("_feature") + 1)
    levels = []
    for depth in range(max_depth + 1):
        level = rows.groupBy("tree", "_node").agg(
            F.count(F.lit(1)).cast("int").alias("size"), F.filter(spans, lambda s: s["high"] > s["low"]).alias("_spans")
        )
        split = F.get("_spans", at) if depth < max_depth else F.lit(None).cast(_SPAN)
        level = level.select("tree", "_node", "size", split.alias("_split")).select(
            "tree", "_node", "size", F.lit(depth).alias("depth"), F.col("_split.feature").alias("_feature"),
            # rounding may reach the upper end, for values one bit apart
            F.when(threshold >= high, low).otherwise(threshold).alias("_threshold"),
        )
        level = spark.createDataFrame(level.toArrow(), level.schema)
        levels.append(level)
        inner = level.filter("_feature IS NOT NULL").select("tree", "_node", "_feature", "_threshold")
        if depth == max_depth or inner.isEmpty():
            break
        moved = F.col("_node") * 2 + F.when(value <= F.col("_threshold"), 1).otherwise(2)
        rows = rows.join(F.broadcast(inner), ["tree", "_node"]).select("tree", *features, moved.alias("_node"))
    nodes = reduce(DataFrame.unionByName, levels)
    nodes = nodes.withColumnsRenamed({"_node": "node", "_feature": "feature", "_threshold": "threshold"})
    is_leaf, node = F.col("feature").isNull(), F.col("node")
    usual = F.when(F.col("size") <= 1, 0.0).when(F.col("size") == 2, 1.0).otherwise(
        2.0 * (F.log(F.col("size") - 1) + EULER_GAMMA) - 2.0 * (F.col("size") - 1) / F.col("size")
    )
    return nodes.select(
        "tree", "node", F.coalesce("feature", F.lit(0)).alias("feature"),
        F.when(is_leaf, float("inf")).otherwise(F.col("threshold")).alias("threshold"),
        F.when(is_leaf, node).otherwise(2 * node + 1).alias("left"), F.when(is_leaf, node).otherwise(2 * node + 2).alias("right"),
        F.when(is_leaf, F.col("depth") + usual).otherwise(0.0).alias("path"),
    )


def fit_forest(
    df: DataFrame,
    id_column: str,
    features: list[str],
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> Forest:
    """Grow ``trees`` trees. At most 2 * sample_rows nodes per tree come back."""
    samples, taken = draw_samples(df, id_column, features, trees, sample_rows, seed)
    max_depth = ceil(log2(max(taken, 2)))
    nodes = grow_trees(materialize(samples), features, max_depth, seed)
    return pack(nodes.toPandas(), features, taken, max_depth)


def pack(nodes: pd.DataFrame, features: list[str], taken: int, depth: int) -> Forest:
    """A forest from its node table."""
    shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
    at = nodes["tree"].to_numpy(), nodes["node"].to_numpy()

    def grid(column: str, dtype: type) -> np.ndarray:
        values = np.zeros(shape, dtype=dtype)
        values[at] = nodes[column].to_numpy()
        return values

    return Forest(
        features, taken, depth, grid("feature", np.int64), grid("threshold", float),
        grid("left", np.int64), grid("right", np.int64), grid("path", float),
    )


def raw_scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Minus 2 to the minus relative path length: -1 is most isolated, near -0.5 is ordinary."""
    depths = np.zeros(len(x))
    values = np.ascontiguousarray(x).ravel()
    start = np.arange(len(x)) * x.shape[1]
    for tree in range(len(forest.path)):
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold = forest.feature[tree], forest.threshold[tree]
        # the children of a node side by side, the left one second
        child = np.stack([forest.right[tree], forest.left[tree]], axis=1).ravel()
        for _ in range(forest.depth):
            goes_left = values.take(start + feature.take(node)) <= threshold.take(node)
            node = child.take(2 * node + goes_left)
        depths += forest.path[tree].take(node)
    usual = expected_path(forest.sample_rows) or 1.0
    return -np.exp2(-depths / (len(forest.path) * usual))


def score_forest(df: DataFrame, forest: Forest, output: str = "raw_score") -> DataFrame:
    """Add the raw score, in Arrow batches; the forest (about 50,000 nodes) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(raw_scores(shared.value, batch.to_numpy(dtype=float)))

    inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in forest.features])
    return df.withColumn(output, score(inputs))
