"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tollguard.session import materialize

#: Postings of a slot of documents, documents of a slot at most, and queries of a block.
POSTINGS, DOCUMENTS, QUERIES = 1 << 20, 1 << 16, 512
#: Postings of the short lists of a query that are summed term by term.
SHORT = 4096
#: Neighbouring documents that are skipped or scored together.
WINDOW = 4096
#: Bytes of the queries' vocabulary that are sent to the tasks; a larger one is joined by shuffle.
VOCABULARY = 16 << 20
_PIECE = 1 << 20

#: Bytes of terms, A-Z in lower case; all others blank.
_TERM_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)
)


def term_counts(text: str) -> Counter[bytes]:
    """The terms of a whole text in UTF-8 with their occurrences."""
    raw, terms, at = text.encode().translate(_TERM_BYTES), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        terms.update(raw[at:end].split())
        at = end
    return terms


def _asked(queries: DataFrame) -> DataFrame:
    """(_q, _item, _term, _times) of the query rows (_item, _text); ``_q`` numbers the rows."""
    rows = queries.withColumn("_q", F.monotonically_increasing_id())
    fields = [T.StructField("_q", T.LongType()), rows.schema["_item"]]
    schema = T.StructType([*fields, T.StructField("_term", T.StringType()), T.StructField("_times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("_text")):
                terms = term_counts(t.as_py() or "")
                row = np.full(len(terms), i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_q").take(row), batch.column("_item").take(row),
                     pa.array([k.decode() for k in terms], pa.string()), pa.array(terms.values(), pa.int64())],
                    names=schema.names,
                )

    return materialize(rows.mapInArrow(run, schema))


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, _row, _length, _terms, _tfs) of each row of (_id, _text) that has a term: the numbers
    of the wanted terms that it holds, and how often. ``terms`` is (_term, _number)."""
    rows = docs.filter(F.col("_text").isNotNull())
    size = terms.agg(F.sum(F.octet_length("_term") + 64)).first()[0] or 0
    small = size <= VOCABULARY
    numbers = {r["_term"].encode(): r["_number"] for r in terms.toLocalIterator()} if small else None
    value = pa.int64() if small else pa.string()
    fields = [rows.schema["_id"], T.StructField("_length", T.LongType())]
    fields += [
        T.StructField("_terms", T.ArrayType(T.LongType() if small else T.StringType())),
        T.StructField("_tfs", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                lengths, terms, tfs = [], [], []
                for t in batch.column(1):
                    counts = term_counts(t.as_py())
                    lengths.append(counts.total())
                    if numbers is None:
                        held = {k.decode(): n for k, n in counts.items()}
                    else:
                        held = {numbers[k]: n for k, n in counts.items() if k in numbers}
                    terms.append(list(held))
                    tfs.append(list(held.values()))
                some = pa.array(np.flatnonzero(lengths))
                columns = [batch.column(0), pa.array(lengths, pa.int64())]
                columns += [pa.array(terms, pa.list_(value)), pa.array(tfs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], names=schema.names)

    found = rows.select("_id", "_text").mapInArrow(run, schema)
    stored = materialize(found.withColumn("_row", F.monotonically_increasing_id()))
    if small:
        return stored
    pairs = stored.select("_row", F.inline(F.arrays_zip(F.col("_terms").alias("_term"), F.col("_tfs").alias("_tf"))))
    numbered = pairs.join(terms, "_term").groupBy("_row").agg(
        F.collect_list(F.struct("_number", "_tf")).alias("_held")
    )
    kept = stored.select("_id", "_row", "_length").join(numbered, "_row", "left")
    held = F.coalesce("_held", F.array().cast("array<struct<_number: bigint, _tf: bigint>>"))
    return materialize(
        kept.select("_id", "_row", "_length", held["_number"].alias("_terms"), held["_tf"].alias("_tfs"))
    )


class Slot:
    """Posting lists over a slot's documents, which stand in the order of their ids, NULL last."""

    def __init__(self, ids: pa.Array, m: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray) -> None:
        self.order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        self.size, self.n_windows = len(ids), -(-len(ids) // WINDOW)
        place = np.empty(self.size, dtype=np.int64)
        place[self.order] = np.arange(self.size)
        owner = np.repeat(np.arange(self.size), pa.compute.list_value_length(terms).to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        by = np.lexsort((place[owner], term))
        owner, term, tf = owner[by], term[by], tf[by]
        self.places, self.parts = place[owner], (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
        self.terms, number = np.unique(term, return_inverse=True)
        key = number * self.n_windows + self.places // WINDOW
        #: Where the postings of each term begin in each window, and the greatest part of them.
        self.begin = np.searchsorted(key, np.arange(len(self.terms) * self.n_windows + 1))
        self.most = np.zeros(len(self.terms) * self.n_windows, dtype=np.int64)
        np.maximum.at(self.most, key, self.parts)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lists of those of the sorted or unsorted ``terms`` that have one, and
        which of the terms these are."""
        at = np.searchsorted(self.terms, terms)
        held = np.flatnonzero(at < len(self.terms))
        held = held[self.terms[at[held]] == terms[held]]
        return at[held], held

    def span(self, number: int, window: int, windows: int = 1) -> slice:
        low = number * self.n_windows + window
        return slice(self.begin[low], self.begin[low + windows])


class _Best:
    """The ``k`` highest scores so far, equal ones by place; places come in ascending order."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.places = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """A document must score more than this."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        above = scores > self.least
        scores, places = (np.concatenate(x) for x in ((self.scores, scores[above]), (self.places, places[above])))
        order = np.lexsort((places, -scores))[: self.k]
        self.scores, self.places = scores[order], places[order]


def search(slot: Slot, terms: np.ndarray, weights: np.ndarray, k: int, short: int = SHORT) -> _Best:
    """The ``k`` best documents of a slot for a query's terms and their weights.

    The shortest lists, of ``short`` postings together, are summed term by term. Their sums then
    are one list among the long ones, bounded by its greatest sum. Documents follow window by
    window: where the bounds of all lists together do not exceed the k-th score, the window is
    skipped; else the lists of the least bounds, which cannot lift a document above that score by
    themselves, are only looked up for documents that the others hold and that can still reach it.
    """
    numbers, held = slot.lists(terms)
    weights, best = weights[held], _Best(k)
    lengths = slot.begin[(numbers + 1) * slot.n_windows] - slot.begin[numbers * slot.n_windows]
    order = np.argsort(lengths, kind="stable")
    n_short = int(np.searchsorted(np.cumsum(lengths[order]), short, side="right"))
    summed, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if n_short:
        spans = [slot.span(numbers[i], 0, slot.n_windows) for i in order[:n_short]]
        summed, at = np.unique(np.concatenate([slot.places[s] for s in spans]), return_inverse=True)
        sums, low = np.zeros(len(summed), dtype=np.int64), 0
        for i, s in zip(order[:n_short], spans):
            n = s.stop - s.start
            sums[at[low : low + n]] += slot.parts[s] * weights[i]
            low += n
    long, weight = numbers[order[n_short:]], weights[order[n_short:]]
    most = slot.most.reshape(-1, slot.n_windows)[long] * weight[:, None]
    edges = np.searchsorted(summed, np.arange(slot.n_windows + 1) * WINDOW)
    for w in range(slot.n_windows):
        a, b = edges[w], edges[w + 1]
        bounds = np.append(most[:, w], sums[a:b].max() if b > a else 0)
        if bounds.sum() <= best.least:
            continue
        by = np.argsort(bounds, kind="stable")
        under = np.cumsum(bounds[by])
        n_looked_up = int(np.searchsorted(under, best.least, side="right"))
        scores, seen = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW, dtype=bool)

        def postings(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i == len(long):
                return summed[a:b] - w * WINDOW, sums[a:b]
            s = slot.span(long[i], w)
            return slot.places[s] - w * WINDOW, slot.parts[s] * weight[i]

        for i in by[n_looked_up:]:
            places, parts = postings(i)
            scores[places] += parts
            seen[places] = True
        left = np.flatnonzero(seen)
        for i in range(n_looked_up - 1, -1, -1):
            left = left[scores[left] + under[i] > best.least]
            places, parts = postings(by[i])
            if not len(left) or not len(places):
                continue
            at = np.minimum(np.searchsorted(places, left), len(places) - 1)
            hit = places[at] == left
            scores[left[hit]] += parts[at[hit]]
        best.add(left + w * WINDOW, scores[left])
    return best


def _search_block(asked: pa.Table, given: pa.Table, k: int, total: int, n_terms: int) -> pa.Table:
    """(_q, _id, _score): the best documents of a slot for every query of a block."""
    found: dict[str, list] = {"_q": [], "_place": [], "_score": []}
    ids = given["_id"].combine_chunks()
    if asked.num_rows and given.num_rows:
        n = given["_length"].to_numpy()
        m = 25 + (75 * n * total) // n_terms
        slot = Slot(ids, m, given["_terms"].combine_chunks(), given["_tfs"].combine_chunks())
        for q, terms, weights in zip(asked["_q"].to_numpy(), asked["_terms"], asked["_weights"]):
            best = search(slot, terms.values.to_numpy(), weights.values.to_numpy(), k)
            found["_q"].append(np.full(len(best.places), q))
            found["_place"].append(slot.order[best.places])
            found["_score"].append(best.scores)
    q, place, score = (np.concatenate([*v, np.zeros(0, dtype=np.int64)]).astype(np.int64) for v in found.values())
    return pa.table({"_q": q, "_id": ids.take(pa.array(place)), "_score": score})


def rank(
    docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", query_block: int = QUERIES, slot_postings: int = POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` its ``k`` highest documents.

    Terms are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z
    lower-cased. N counts the documents with a term, L their terms, df a term's documents; with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + 75 n N div L, a document of n terms
    scores the sum of w * (1000000000 tf div (1000 tf + 8 m)) over the query's terms, repeats
    included. Only scores above 0 count; equal ones go by ascending id, NULL last.

    NULL and empty texts have no term: such documents are not found, such queries have no rows.
    Repeated documents each take a rank, repeated queries each get their rows. Empty tables give no
    rows. Other columns do not matter, in either table. Long texts are read in pieces.

    Documents are read once: only the query terms they hold go on, in slots of bounded size. Each
    block of queries meets each slot in a task of its own, which sends back ``k`` rows a query.
    """
    spark = docs.sparkSession
    asked = _asked(queries.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{item_text}`").alias("_text")))
    terms = materialize(asked.select("_term").distinct().withColumn("_number", F.monotonically_increasing_id()))
    held = _postings(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")), terms)
    n, length, n_postings = held.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("_length"), F.lit(0)), F.coalesce(F.sum(F.size("_terms")), F.lit(0))
    ).first()
    df = held.select(F.explode("_terms").alias("_number")).groupBy("_number").agg(F.count(F.lit(1)).alias("_df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("_df") + 1).cast("double")))
    weighted = asked.join(terms, "_term").join(df, "_number").withColumn("_weight", F.col("_times") * weight)
    blocks = max(1, -(-queries.count() // query_block))
    slots = max(-(-n_postings // slot_postings), -(-n // DOCUMENTS), 1)
    # small tables are cut further, so that all tasks of the cluster have work
    slots = max(slots, min(spark.sparkContext.defaultParallelism, -(-n // WINDOW)))
    sets = weighted.groupBy("_q").agg(
        F.collect_list("_number").alias("_terms"), F.collect_list("_weight").alias("_weights")
    )
    sets = sets.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )
    given = held.filter(F.size("_terms") > 0).withColumn(
        "_slot", F.pmod(F.xxhash64("_row"), F.lit(slots)).cast("int")
    ).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = T.StructType([
        T.StructField("_q", T.LongType()), held.schema["_id"], T.StructField("_score", T.LongType())
    ])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_block(left, right, k, n, length)

    found = sets.groupBy("_block", "_slot").cogroup(given.groupBy("_block", "_slot")).applyInArrow(run, schema)
    order = Window.partitionBy("_q").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    items = asked.select("_q", "_item").distinct()
    return ranked.join(items, "_q").select(
        F.col("_item").alias("item_id"), "rank", F.col("_id").alias("doc_id"), F.col("_score").alias("score")
    )
