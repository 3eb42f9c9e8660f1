"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollguard.llm.base import n_words, ranked
from tollguard.session import materialize

#: The columns that ``plan_mix`` adds after the row itself.
ADDED = ("size", "source_size", "target", "copies", "taken")


def _level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight when targets stop at their cap and the excess is shared again.

    Each round sends a few sums to the driver. The level only rises, and a round that caps no
    further source ends the loop.
    """
    level = -1.0
    while True:
        capped = F.col("_cap") <= F.lit(level) * F.col("_weight")
        spent, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("_weight"))),
        ).first()
        if not open_weight:
            return float("inf")
        new = (budget - spent) / open_weight
        if new <= level:
            return level
        level = new


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 10,
    size: Column | None = None,
) -> DataFrame:
    """How often the mix takes each row of ``docs``: columns ``row`` (the whole input row as a
    struct, so no name can clash), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Sources in code-point order, NULL last, get the ``weights`` in turn. They share ``share`` times
    all words by weight; a target stops at ``max_copies`` times its source's words, and the excess
    is shared again. Within a source every document expects the same number of copies, target over
    source size. Documents stand in the order of (size, md5 of the id, id); expected copies are
    summed along it, one random offset per source is added, and a document is emitted once per
    integer crossed, so it gets the floor or the ceiling of its expectation. As sizes rise along
    the order, the words taken miss the target by about one longest document at most.

    ``size`` replaces the count of words by an expression of ``docs``, a long that is never NULL.

    Any column may be NULL: a NULL text has size 0, NULL sources are one source, NULL ids sort
    first. A source without words has target 0 and gives no copies. An empty table gives no rows.
    Equal rows share the copies that fall to their places. Nothing depends on the partitioning, so
    reruns agree. A hot source spreads over many ranges (``base.ranked``); the sources table is
    joined without a hint.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("_source"),
        (n_words(F.col(f"`{text}`")) if size is None else size).alias("size"),
        F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).alias("_mixed"),
        F.col(f"`{doc_id}`").alias("_id"),
    )
    placed = ranked(
        rows, F.col("_source").asc_nulls_last(), F.col("size").asc(), F.col("_mixed").asc(),
        F.col("_id").asc(),
    ).drop("_mixed", "_id")
    sources = placed.groupBy("_source").agg(
        F.sum("size").alias("source_size"), F.min("_rank").alias("_first")
    )
    nth = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        (F.col("_nth") % F.lit(len(weights)) + 1).cast("int"),
    )
    sources = materialize(
        ranked(sources, F.col("_source").asc_nulls_last(), name="_nth")
        .withColumn("_weight", nth)
        .withColumn("_cap", F.col("source_size") * F.lit(max_copies))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = F.lit(_level(sources, share * total) if total else 0.0) * F.col("_weight")
    digits = F.substring(
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))), 1, 8
    )
    sources = sources.select(
        F.col("_source").alias("_of"), "source_size", "_first",
        F.least(F.col("_cap").cast("double"), level).alias("target"),
        (F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)).alias("_offset"),
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_rank") - F.col("_first")
    crossed = F.floor((place + 1) * F.col("_each") + F.col("_offset")) - F.floor(
        place * F.col("_each") + F.col("_offset")
    )
    copies = F.least(F.lit(max_copies).cast("long"), crossed.cast("long"))
    return (
        placed.join(sources, F.col("_source").eqNullSafe(F.col("_of")))
        .withColumn("_each", each)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row", *ADDED)
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``plan_mix`` says, same columns."""
    planned = plan_mix(docs, **options).filter("copies > 0")
    repeated = planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
