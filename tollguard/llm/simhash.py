"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.llm.jaccard import components
from tollguard.session import materialize

#: Words of a shingle, and the bits in which linked fingerprints may differ.
SHINGLE, BITS = 3, 2
#: Seed of the shingles' XXH64.
SEED = 42
#: Fingerprints of a list whose pairs are tallied; larger lists are cut by two more bytes.
SMALL = 32
_BYTES = 8
#: At most ``BITS`` bytes of a linked pair differ, so it shares this many positional bytes.
_LEAST = _BYTES - BITS
_PIECE = 1 << 18
#: The two halfwords of a list's key, and the bytes that the key leaves open.
_KEYS = [(a, b, [p for p in range(_BYTES) if p // 2 not in (a, b)]) for a, b in itertools.combinations(range(4), 2)]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(text: str) -> Iterator[list[bytes]]:
    """The words of a text in runs, each run beginning with the last words of the one before."""
    raw, at, carry = text.encode().translate(_LOWER), 0, []
    while at < len(raw):
        blank = _BLANK.search(raw, at + _PIECE)
        end = blank.start() if blank else len(raw)
        words = carry + raw[at:end].split()
        yield words
        at, carry = end, words[-(SHINGLE - 1):]


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's shingles, 0 without words: a bit is set if it is in over half of
    the hashes."""
    ones, n, short = np.zeros(64, dtype=np.int64), 0, []
    for words in _words(text or ""):
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
        spans = zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
        short = words if not n and not hashes else []
        ones += _ones(hashes)
        n += len(hashes)
    if short:
        n, ones = 1, _ones([xxhash.xxh64_intdigest(b" ".join(short), SEED)])
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 8192):
        part = np.array(hashes[low : low + 8192], dtype=np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _fp): the fingerprint of every row's whole text as a signed long."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _halfword(fp: Column, place: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * place).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _postings(nodes: DataFrame) -> DataFrame:
    """(_fp, _key, _kind): the fingerprint in each of the six lists that hold it.

    A linked pair differs in at most two bytes, so two of its four halfwords are equal: it shares
    the postings of four positional bytes at once, in at least one of the six lists.
    """
    fp = F.col("_fp")
    entries = [
        F.struct(
            F.lit(kind).alias("_kind"),
            F.shiftleft(F.lit(kind).cast("long"), 32)
            .bitwiseOR(F.shiftleft(_halfword(fp, a), 16)).bitwiseOR(_halfword(fp, b)).alias("_key"),
        )
        for kind, (a, b, _) in enumerate(_KEYS)
    ]
    return nodes.select("_fp", F.inline(F.array(*entries)))


def _tallied(lists: DataFrame) -> DataFrame:
    """Linked pairs of the lists: the shared positional bytes of a pair are tallied, pairs with the
    least number go on, and their differing bits are counted."""
    differ = F.col("_fp").bitwiseXOR(F.col("_with"))
    shared = sum(
        (F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255).cast("long")) == 0).cast("int")
        for p in range(_BYTES)
    )
    right = lists.select("_key", F.col("_fp").alias("_with"))
    pairs = lists.join(right, "_key").filter(
        (F.col("_fp") < F.col("_with")) & (shared >= _LEAST) & (F.bit_count(differ) <= BITS)
    )
    return pairs.select(F.col("_fp").alias("_node"), "_with")


def _joined(values: np.ndarray) -> np.ndarray:
    """The least of ``values``, different halfwords, that links connect with each of them."""
    ones = np.unpackbits(np.arange(1 << 16, dtype=np.uint16).view(np.uint8).reshape(-1, 2), axis=1).sum(axis=1)
    place = np.full(1 << 16, -1)
    place[values] = np.arange(len(values))
    label = values.copy()
    masks = np.flatnonzero((ones > 0) & (ones <= BITS))
    while True:
        before = label.copy()
        for mask in masks:
            other = place[values ^ mask]
            own = np.flatnonzero(other >= 0)
            label[own] = np.minimum(label[own], label[other[own]])
        label = np.minimum(label, label[place[label]])
        if (label == before).all():
            return label


def _cut(lists: DataFrame) -> DataFrame:
    """Links of the large lists, as (fingerprint, one that links connect it with).

    Two more shared bytes cut a list into groups of equal six bytes, which hold 65,536 different
    fingerprints at most. A group's linked pairs are found by flipping one or two of the open bits,
    so the work grows with its members and not with their square.
    """
    open_bytes = F.array(*[
        F.array(*[F.struct(F.lit(p).alias("_p"), F.lit(q).alias("_q")) for p, q in itertools.combinations(left, 2)])
        for *_, left in _KEYS
    ])
    rows = lists.select("_fp", F.inline(F.element_at(open_bytes, F.col("_kind") + 1))).distinct()
    low, high = F.expr("shiftrightunsigned(_fp, 8 * _p) & 255L"), F.expr("shiftrightunsigned(_fp, 8 * _q) & 255L")
    rows = rows.select(
        "_p", "_q", F.expr("_fp & ~(shiftleft(255L, 8 * _p) | shiftleft(255L, 8 * _q))").alias("_base"),
        (high * 256 + low).cast("int").alias("_open"),
    )
    groups = rows.groupBy("_p", "_q", "_base").agg(F.collect_list("_open").alias("_in")).filter(F.size("_in") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [], []
            for p, q, base, held in zip(*(batch.column(k) for k in range(4))):
                p, q = np.uint64(8 * p.as_py()), np.uint64(8 * q.as_py())
                values = held.values.to_numpy()
                near = _joined(values)
                moved = np.flatnonzero(near != values)
                for out, v in ((nodes, values[moved]), (roots, near[moved])):
                    v = v.astype(np.uint64)
                    whole = ((v & np.uint64(255)) << p) | ((v >> np.uint64(8)) << q)
                    out.append(whole.view(np.int64) | np.int64(base.as_py()))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], names=["_node", "_with"]
                )

    return groups.mapInArrow(run, "_node long, _with long")


def links(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(_node, _with): pairs of the different fingerprints ``_fp`` that connect all that are linked.

    Lists of up to ``small`` give all their linked pairs, larger ones a pair per fingerprint.
    """
    postings = materialize(_postings(nodes))
    sizes = postings.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    lists = materialize(postings.join(sizes, "_key"))
    few, many = lists.filter(F.col("_size") <= small), lists.filter(F.col("_size") > small)
    return _tallied(few.select("_key", "_fp")).unionByName(_cut(many))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", small: int = SMALL
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    A-Z are lower-cased; shingles are three words joined by a space, repeats included; a text of
    one or two words has one, of all of them. Documents link if their fingerprints differ in two
    bits or fewer; ``component_id`` is the smallest id that links reach, the own one included.

    NULL, empty and blank texts have fingerprint 0 and link like any other. Rows with equal id are
    documents of their own. NULL ids count for a component only if it has no other. An empty table
    gives no rows. Other columns do not matter. Long texts are hashed in pieces.

    Documents of one fingerprint are one node, so groups of copies of any size cost one.
    """
    prints = materialize(fingerprints(docs, text, doc_id))
    nodes = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(nodes.select("_fp"), small))
    known = nodes.join(roots.withColumnRenamed("_node", "_fp"), "_fp", "left")
    known = known.withColumn("_root", F.coalesce("_root", "_fp"))
    least = known.groupBy("_root").agg(F.min("_least").alias("_component"))
    known = materialize(known.join(least, "_root").select(F.col("_fp").alias("_of"), "_component"))
    return prints.join(known, F.col("_fp") == F.col("_of")).select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
