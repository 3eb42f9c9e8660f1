"""Spelling variants: PartEnum signatures of letter multisets, an equi-join, verification."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollguard.llm.rolling import mixed, odd_numbers
from tollguard.session import materialize

#: Code points of a word, and its occurrences, at least; how many times as frequent a form is.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: A run is misspelt where this divides its checksum.
EVERY = 199
#: One edit changes a letter multiset, as a binary vector, in at most so many places.
HAMMING = 2
#: Parts of the vectors. A signature leaves out ``HAMMING`` of them.
PARTS = 6
#: Words of a bucket that meet each other; larger buckets are cut by halves of the words.
SMALL = 32
#: Characters read at a time, and words counted by a task before they are sent.
_PIECE, _HELD = 1 << 20, 100_000
_LEFT_OUT = list(itertools.combinations(range(PARTS), HAMMING))


def _is_letter(b: int) -> bool:
    return 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0


#: Letters up to U+00FF as one byte, A-Z in lower case, all else blank.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if _is_letter(b) else 32 for b in range(256))


def spelt(text: str, doc: str, least: int = LENGTH, every: int = EVERY) -> Counter[bytes]:
    """The words of a document in Latin-1 with their counts, misspelt where ``every`` divides."""
    raw, words, at = text.encode("latin-1", "replace").translate(_LETTERS), Counter(), 0
    prefix = zlib.crc32(f"{doc}:".encode())
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        for run, n in Counter(raw[at:end].split()).items():
            if len(run) < least:
                continue
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                words[run] += n
        at = end
    return words


def vocabulary(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
    occurrences: int = OCCURRENCES, every: int = EVERY,
) -> DataFrame:
    """(word, n): the words of all whole texts, long and frequent enough, with their occurrences.

    Tasks count before they send, so a frequent word leaves a task in a few rows.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`").alias("_text")
    )
    rows = rows.filter(F.col("_text").isNotNull())

    def batch_of(words: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(words.values(), pa.int64())],
            names=["word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1)):
                held.update(spelt(t.as_py(), doc.as_py(), length, every))
                if len(held) > _HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def signatures(words: list[str]) -> np.ndarray:
    """A row per word: a hash for each way to leave out ``HAMMING`` of the vector's parts.

    The vector has a place for the i-th occurrence of each letter. One edit changes at most two
    places, in at most two parts, so words one edit apart share the signature that leaves these out.
    """
    lengths = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    order = np.lexsort((letters, owner))
    owner, letters = owner[order], letters[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (letters[1:] != letters[:-1])
    starts = np.flatnonzero(first)
    occurrence = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    place = mixed((letters + (occurrence << 21)).astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), PARTS), dtype=np.uint64)
    np.add.at(sums, (owner, ((place >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int64)), mixed(place))
    whole, salt = sums.sum(axis=1, dtype=np.uint64), odd_numbers(len(_LEFT_OUT), 13)
    return np.stack(
        [mixed((whole - sums[:, a] - sums[:, b]) * salt[k] + salt[k]) for k, (a, b) in enumerate(_LEFT_OUT)], axis=1
    )


def _signed(words: DataFrame) -> DataFrame:
    """(word, n, _keys) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = signatures(batch.column(0).to_pylist()).view(np.int64)
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["word", "n", "_keys"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, _keys array<long>")


def _halves(word: Column, key: Column) -> Column:
    """Keys of a large bucket's words: of two words one edit apart, the shorter (or either) having
    m code points, the first m / 2 or the last m - m / 2 are equal."""
    n = F.length(word)
    keys = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(key, m, F.lit(0), F.left(word, half)))
        keys.append(F.xxhash64(key, m, F.lit(1), F.right(word, m - half)))
    return F.array(*keys)


def near_words(words: DataFrame, small: int = SMALL) -> DataFrame:
    """(word, near, n): both ways, the words of (word, n) exactly one edit apart, ``n`` of ``near``.

    A pair meets in every bucket that both are in, which are all verified; it counts once. Buckets
    above ``small`` words, of words with nearly the same letters, are cut by halves first.
    """
    entries = _signed(words).select("word", "n", F.explode("_keys").alias("_key"))
    entries = materialize(entries)
    sizes = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    shared = materialize(entries.join(sizes, "_key"))
    few = shared.filter(F.col("_size") <= small).select("word", "n", "_key")
    many = shared.filter(F.col("_size") > small)
    many = many.select("word", "n", F.explode(_halves(F.col("word"), F.col("_key"))).alias("_key"))
    left = few.unionByName(many)
    right = left.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "_key")
    pairs = left.join(right, "_key").filter(
        (F.col("word") < F.col("near")) & (F.abs(F.length("word") - F.length("near")) <= 1)
        & (F.levenshtein("word", "near", 1) == 1)
    )
    pairs = pairs.select("word", "n", "near", "near_n").distinct()
    ends = F.array(
        F.struct("word", "near", F.col("near_n").alias("n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), "n"),
    )
    return pairs.select(F.inline(ends))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends. A form is several times as frequent as
    its word, so chains are short; each round doubles the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = materialize(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))


def group_variants(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
    occurrences: int = OCCURRENCES, times: int = TIMES, every: int = EVERY, small: int = SMALL,
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased; where
    ``every`` divides the CRC-32 of ``<doc_id>:<run>`` one letter is taken out first. Those of at
    least ``length`` code points and ``occurrences`` count. Words are near if exactly one code
    point is inserted, deleted or replaced. The form is the near word of the largest ``n``, of
    equal ones the first in code-point order, if it is ``times`` as frequent, else NULL; the root
    is where the forms lead, the word itself without one.

    NULL and empty texts have no words; a NULL id is written as nothing. Repeated rows count each
    time. An empty table gives no rows. Other columns do not matter. Long texts are read in pieces.
    """
    words = materialize(vocabulary(docs, text, doc_id, length, occurrences, every))
    best = near_words(words, small).groupBy(F.col("word").alias("_word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("_n"), "near")).alias("_best")
    )
    found = words.join(best, F.col("word") == F.col("_word"), "left")
    most = -F.col("_best._n")
    taken = most >= times * F.col("n")
    found = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("_best.near")).alias("form"), F.when(taken, most).alias("form_n"),
    ))
    roots = _roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "_word")
    joined = found.join(roots, F.col("word") == F.col("_word"), "left")
    return joined.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
