"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a candidate block and of a query block, and candidate blocks of one task.
CANDIDATES, QUERIES, BLOCKS = 4096, 512, 8
#: Scores held at a time, in rows of queries.
_ROWS = 128


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(_id, _v): ids and floor(scale * x) of each component, without the vectors that are NULL or
    hold NULL, NaN or infinite components, and without rows whose id is NULL."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.filter(x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & sound).select(
        F.col(f"`{vec_id}`").cast("long").alias("_id"), whole.alias("_v")
    )


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of ``n`` candidates for each query: term by term, the weighted postings of the term
    are added where they stand. Terms without weight in a query add nothing."""
    scores = np.zeros((len(queries), n), dtype=np.int64)
    for term, (places, weights) in enumerate(postings):
        rows = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(places):
            continue
        if len(places) == n and len(rows) == len(queries):
            scores += np.multiply.outer(queries[:, term], weights)
        else:
            scores[np.ix_(rows, places)] += np.multiply.outer(queries[rows, term], weights)
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, equal ones by place: a partition finds the k-th
    score, what is above it is in, and the first that equal it fill up."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    equal = np.flatnonzero(scores == edge)[: k - len(above)]
    return np.concatenate([above, equal])


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of this task for each of its queries."""
    out = {"_q": [], "_query": [], "_id": [], "_score": []}
    if len(queries) and len(candidates):
        candidates = candidates.sort_values("_id", kind="stable")
        for low in range(0, len(candidates), CANDIDATES):
            part = candidates.iloc[low : low + CANDIDATES]
            width = max(map(len, [*part["_v"], *queries["_v"]]))
            table, ids = _matrix(list(part["_v"]), width), part["_id"].to_numpy()
            postings = []
            for term in range(width):
                places = np.flatnonzero(table[:, term])
                postings.append((places, table[places, term]))
            for at in range(0, len(queries), _ROWS):
                rows = queries.iloc[at : at + _ROWS]
                scores = accumulate(_matrix(list(rows["_v"]), width), postings, len(part))
                for q, query, own in zip(rows["_q"], rows["_id"], scores):
                    other = ids != query
                    places = np.flatnonzero(other)[best(own[other], k)] if not other.all() else best(own, k)
                    out["_q"] += [q] * len(places)
                    out["_query"] += [query] * len(places)
                    out["_id"] += ids[places].tolist()
                    out["_score"] += own[places].tolist()
    found = pd.DataFrame(out).astype(np.int64)
    order = found.sort_values(["_q", "_score", "_id"], ascending=[True, False, True], kind="stable")
    return order.groupby("_q", sort=False).head(k)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERIES, slot_rows: int = CANDIDATES * BLOCKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors``
    with the highest integer inner product, all if there are fewer.

    Both are tables of ``quantised``. Equal scores go to the smaller id; rows with the query's own
    id are no candidates. Vectors of different lengths count as padded with zeros. Equal query rows
    are answered one by one; equal candidate rows each take a rank. Empty tables give no rows.
    Scores must fit a long, as components of up to 2^28 in 128 terms do.

    Queries come in blocks and candidates in slots of a bounded size; each block meets each slot in
    a task of its own, which holds one slot, a block and a few rows of dense scores, and sends
    back ``k`` rows a query. The shuffle carries a candidate once per query block.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    blocks, slots = max(1, -(-n_queries // query_block)), max(1, -(-n_vectors // slot_rows))
    asked = queries.withColumn("_q", F.monotonically_increasing_id())
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )
    given = vectors.withColumn(
        "_slot", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    ).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    found = asked.groupBy("_block", "_slot").cogroup(given.groupBy("_block", "_slot")).applyInPandas(
        search, "_q long, _query long, _id long, _score long"
    )
    order = Window.partitionBy("_q").orderBy(F.desc("_score"), F.asc("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("_query").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_score").alias("score")
    )
