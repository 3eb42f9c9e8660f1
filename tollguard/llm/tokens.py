"""Byte-level BPE encoding by overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.llm.base import free_name
from tollguard.session import materialize

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters from which the chunks of a text are spread over tasks.
SPREAD = 16 * CHUNK


@cache
def _codec(path: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern, list[bytes]]:
    """The encoder, the pre-tokeniser, and the bytes of each id; built once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return encoder, regex.compile(pattern), raw


def boundaries(text: str, pattern: regex.Pattern, start: int) -> list[int]:
    """Where the pre-tokens of a chunk end, as places in the whole text that begins ``start``
    characters before it."""
    return [start + m.end() for m in pattern.finditer(text)]


def zone(part: str, ends: list[int], start: int, low: int, high: int) -> list[int]:
    """The boundaries of a chunk in an overlap (low, high) at which its neighbour may take over.

    The last pre-token of a chunk, which its end may have cut, has none, and the character before
    is no white space, so that no look-ahead of the pattern reaches over the place.
    """
    return [p for p in ends[:-1] if low < p < high and not part[p - start - 1].isspace()]


def meeting(left: list[int], right: list[int]) -> int | None:
    """Where two chunks resynchronise: the first place that both ``zone`` lists hold. From there on
    the right chunk's pre-tokens are those of the text."""
    return min(set(left).intersection(right), default=None)


def pieces(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
    """The text in pieces that can be encoded one by one: cut only where chunks meet.

    Where two chunks find no meeting place (a very long pre-token), the piece grows by the next
    chunk and the whole of it is pre-tokenised again.
    """
    if len(text) <= chunk:
        yield text
        return
    begin, low = 0, 0
    left = boundaries(text[:chunk + overlap], pattern, 0)
    while low + chunk + overlap < len(text):
        start = low + chunk
        end = start + overlap
        part = text[start : start + chunk + overlap]
        right = boundaries(part, pattern, start)
        place = meeting(zone(text, left, 0, start, end), zone(part, right, start, start, end))
        if place is None:
            left = boundaries(text[begin : start + chunk + overlap], pattern, begin)
        else:
            yield text[begin:place]
            begin, left = place, right
        low = start
    yield text[begin:]


def encode(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text, as the plain encoder gives them on the whole."""
    encoder, matcher, _ = _codec(path, pattern)
    ids: list[int] = []
    for piece in pieces(text, matcher, chunk, overlap):
        if len(piece) <= 4 * chunk:
            ids += encoder.encode_ordinary(piece)
        else:  # pre-tokens of this length overflow the encoder's own matcher
            for m in matcher.finditer(piece):
                ids += encoder._core_bpe.encode_single_piece(m.group().encode())
    return ids


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, joined."""
    raw = _codec(path, pattern)[2]
    return b"".join([raw[i] for i in ids])


def _spread_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_t1, _t2, _pieces) of the distinct long texts (_t1, _t2, _long): the ids piece by piece in
    order, or NULL if two chunks of the text do not meet.

    Chunks are rows. Each is pre-tokenised by itself and joined with the next one, whose overlap
    it shares; the first place where both have a boundary cuts the text, and the pieces between
    cuts are encoded where the chunks are.
    """
    size = F.length("_long")
    last = F.greatest(F.lit(0), F.ceil((size - overlap) / F.lit(chunk)).cast("int") - 1)
    chunks = texts.withColumn("_last", last).select(
        "_t1", "_t2", "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_no"), "_long"
    )
    part = F.substr("_long", F.col("_no") * chunk + 1, F.lit(chunk + overlap))
    chunks = chunks.select("_t1", "_t2", "_last", "_no", part.alias("_part")).repartition("_t1", "_t2", "_no")
    schema = T.StructType([*chunks.schema.fields, *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("_head", "_tail"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _codec(path, pattern)[1]
        for batch in batches:
            heads, tails = [], []
            for no, value in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                start = no * chunk
                ends = boundaries(value, matcher, start)
                heads.append(zone(value, ends, start, start, start + overlap))
                tails.append(zone(value, ends, start, start + chunk, start + chunk + overlap))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=schema.names,
            )

    chunks = materialize(chunks.mapInArrow(cut, schema))
    heads = chunks.select("_t1", "_t2", (F.col("_no") - 1).alias("_no"), "_head")
    meets = chunks.select("_t1", "_t2", "_no", "_tail").join(heads, ["_t1", "_t2", "_no"]).select(
        "_t1", "_t2", "_no", F.array_min(F.array_intersect("_tail", "_head")).alias("_cut")
    )
    starts = meets.select("_t1", "_t2", (F.col("_no") + 1).alias("_no"), F.col("_cut").alias("_begin"))
    placed = chunks.drop("_head", "_tail").join(meets, ["_t1", "_t2", "_no"], "left").join(
        starts, ["_t1", "_t2", "_no"], "left"
    )
    begin = F.when(F.col("_no") == 0, F.lit(0)).otherwise(F.col("_begin")) - F.col("_no") * chunk
    end = F.when(F.col("_no") == F.col("_last"), F.length("_part")).otherwise(F.col("_cut") - F.col("_no") * chunk)
    placed = placed.select(
        "_t1", "_t2", "_no", F.substr("_part", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_piece")
    )
    piece_schema = "_t1 long, _t2 long, _no int, _ids array<int>"

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else encode(p, path, pattern) for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["_t1", "_t2", "_no", "_ids"]
            )

    coded = placed.mapInArrow(ids, piece_schema).groupBy("_t1", "_t2").agg(
        F.array_sort(F.collect_list(F.struct("_no", "_ids"))).alias("_all"),
        F.max(F.col("_ids").isNull()).alias("_apart"),
    )
    return coded.select("_t1", "_t2", F.when(~F.col("_apart"), F.flatten(F.col("_all._ids"))).alias("_pieces"))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True,
    spread: int = SPREAD, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (32-bit integers, unless ``keep_ids`` is off),
    ``ids_sha256`` and ``decoded_sha256`` of every whole text.

    ``path`` names a rank file that every executor has under that name. A NULL or empty text has
    no ids. Texts are encoded chunk by chunk (``pieces``), those above ``spread`` characters with
    their chunks spread over tasks (``_spread_ids``), each distinct long text once; a task holds a
    batch of rows and the ids of one text. Only long texts are shuffled. Columns of the added names
    are replaced, all others kept, and equal rows give equal results.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    place = len(docs.columns)
    value = F.col(f"`{text}`")
    is_long = F.coalesce(F.length(value) > spread, F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    long_rows = docs.filter(is_long).select(
        row.alias("_row"), value.alias("_long"), F.xxhash64(value).alias("_t1"), F.xxhash64(F.lit(1), value).alias("_t2")
    )
    texts = long_rows.select("_t1", "_t2", "_long").dropDuplicates(["_t1", "_t2"])
    spread_ids = _spread_ids(texts, path, pattern, chunk, overlap)
    pieces = free_name("_pieces", docs)
    long_rows = long_rows.join(spread_ids, ["_t1", "_t2"]).select("_row.*", F.col("_pieces").alias(pieces))
    kept = docs.filter(~is_long).withColumn(pieces, F.lit(None).cast("array<int>")).unionByName(long_rows)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                counts, arrays, digests, decoded = [], [], [], []
                for value, known in zip(part.column(at), part.column(place)):
                    ids = known.as_py() if known.is_valid else encode(value.as_py() or "", path, pattern)
                    packed = np.array(ids, dtype="<u4")
                    counts.append(len(ids))
                    if keep_ids:
                        arrays.append(packed.astype(np.int32))
                    digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
                columns = [pa.array(counts, pa.int64())]
                columns += [pa.array(arrays, pa.list_(pa.int32()))] if keep_ids else []
                columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:place], *columns], names=schema.names
                )

    return kept.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids as a binary column; NULL ids give NULL."""
    kept = encoded.drop(out)
    place = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                values = [None if v is None else decode(v, path, pattern) for v in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values, pa.binary())], names=[*part.schema.names, out]
                )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trips(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``round_trip``: whether the decoded bytes are those of the text."""
    return docs.withColumn(
        "round_trip",
        F.col("decoded_sha256") == F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256),
    )
