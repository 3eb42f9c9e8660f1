"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.llm.base import portions

#: Length of a hypervector, and the seed of the letters' random vectors.
DIMENSIONS, SEED = 1024, 2
#: The language of texts without a letter.
UNDETERMINED = "und"
#: Random texts that tell what no language scores: words, and texts of so many.
RANDOM_TEXTS = [(5, 400), (20, 300), (50, 200), (200, 100), (1000, 40), (5000, 10)]
#: What is vectorised at a time: documents, characters, distinct n-grams.
_DOCS, _CHARS, _GRAMS = 256, 1 << 17, 1024


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)


@lru_cache(maxsize=8192)
def _letter_vector(code: int) -> np.ndarray:
    """The random signs of a letter; 0 is the word boundary. They depend on nothing else."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS)
    return (2 * bits - 1).astype(np.int8)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter trigrams: number of the text, number of the trigram, and its letters by number.

    A trigram is a letter with the characters beside it; what is not a letter counts as boundary.
    """
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le"), dtype=np.uint32)
    codes = _letters()[codes]
    at = np.flatnonzero(codes)
    doc = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])[at - 1]
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n = len(alphabet)
    left, mid, right = (number[codes[at + d]] for d in (-1, 0, 1))
    gram = (left * n + mid) * n + right
    if n**3 <= 1 << 18:
        found = np.zeros(n**3, dtype=bool)
        found[gram] = True
        distinct = np.flatnonzero(found)
        rank = np.cumsum(found) - 1
        gram = rank[gram]
    else:
        distinct, gram = np.unique(gram, return_inverse=True)
    parts = np.stack([distinct // (n * n), distinct // n % n, distinct % n])
    return doc, gram, alphabet[parts] if len(distinct) else parts


def _bound(letters: np.ndarray) -> np.ndarray:
    """Trigram vectors: the first letter permuted twice, times the second permuted once, times the
    third."""
    alphabet, at = np.unique(letters, return_inverse=True)
    at = at.reshape(letters.shape)
    signs = np.stack([_letter_vector(int(c)) for c in alphabet])
    return np.roll(signs, 2, axis=1)[at[0]] * np.roll(signs, 1, axis=1)[at[1]] * signs[at[2]]


def _bundles(owner: np.ndarray, gram: np.ndarray, letters: np.ndarray, n: int, kind) -> np.ndarray:
    """For each of ``n`` owners the sum of the vectors of its trigrams."""
    total = np.zeros((n, DIMENSIONS), dtype=np.float64)
    for low in range(0, letters.shape[1], _GRAMS):
        width = min(_GRAMS, letters.shape[1] - low)
        here = (gram >= low) & (gram < low + width)
        counts = np.bincount(owner[here] * width + gram[here] - low, minlength=n * width)
        total += counts.reshape(n, width).astype(kind) @ _bound(letters[:, low : low + width]).astype(kind)
    return total


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in pieces of bounded size, with their numbers. A long text is cut only where a
    word ends, so its trigrams are those of the whole."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while low < len(text):
            end = min(low + _CHARS, len(text))
            while end < len(text) and text[end].isalpha():
                end += 1
            part = text if end - low == len(text) else text[low:end]
            low = end
            if parts and (size + len(part) > _CHARS or len(parts) >= _DOCS):
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, parts


def hypervectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text."""
    out = np.zeros((len(texts), DIMENSIONS))
    for numbers, parts in _pieces(texts):
        doc, gram, letters = _grams(parts)
        np.add.at(out, numbers, _bundles(doc, gram, letters, len(parts), np.float32))
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all trigrams of all texts with that label.

    Rows with a NULL text or label teach nothing; a label whose texts hold no letter gives no
    prototype; an empty table gives none at all. Sums are whole numbers, so the order of rows and
    lost tasks change nothing. The driver receives one vector per label.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in portions(batches, 0):
            langs = batch.column(1).to_pylist()
            for numbers, texts in _pieces(batch.column(0).to_pylist()):
                doc, gram, letters = _grams(texts)
                names = sorted({langs[i] for i in numbers})
                of = np.array([names.index(langs[i]) for i in numbers])
                for name, v in zip(names, _bundles(of[doc], gram, letters, len(names), np.float64)):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            columns = [pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "dim", "value"])

    labelled = docs.select(
        F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang")
    ).dropna()
    sums = labelled.mapInArrow(partial, "lang string, dim int, value long")
    rows = sums.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    prototypes: dict[str, np.ndarray] = {}
    for r in rows:
        prototypes.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    return {k: v for k, v in sorted(prototypes.items()) if v.any()}


def predict(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    """The nearest prototype by cosine, and the cosine cut to 0..1; equal cosines go to the
    smaller name."""
    names = sorted(prototypes)
    bundles = hypervectors([t or "" for t in texts])
    norms = np.sqrt((bundles * bundles).sum(axis=1))
    if not names:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    models = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names])
    cosines = (bundles @ models.T) / np.where(norms > 0, norms, 1)[:, None]
    best = cosines.argmax(axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
    lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
    return (
        [names[b] if x else UNDETERMINED for b, x in zip(best, lettered)],
        [float(s) if x else 0.0 for s, x in zip(score, lettered)],
    )


def noise(prototypes: dict[str, np.ndarray]) -> list[tuple[int, float]]:
    """(letters, score): what texts of random letters a to z score at most from so many letters on.

    Words have two to nine letters; the same texts are drawn each time. A length counts up to the
    next but one, as scores rise with it, and a twentieth is added to the highest of the sample.
    """
    draw = np.random.Generator(np.random.PCG64(SEED))
    tops = []
    for words, texts in RANDOM_TEXTS:
        sample = []
        for _ in range(texts):
            sizes = draw.integers(2, 10, words)
            letters = "".join(map(chr, draw.integers(97, 123, sizes.sum())))
            ends = np.cumsum(sizes)
            sample.append(" ".join(letters[e - n : e] for n, e in zip(sizes, ends)))
        tops.append(1.05 * max(predict(sample, prototypes)[1]))
    return [(3 * words, max(tops[i : i + 2])) for i, (words, _) in enumerate(RANDOM_TEXTS)]


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
    lang_pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """``docs`` with the predicted language of every whole text and the cosine to its prototype.

    Each text becomes the bundle of its letter trigrams, whatever its length. NULL texts and texts
    without a letter give ``und`` and 0. Columns of the names to add are replaced; all others are
    kept as they are. A text depends on no other, so ties and repeated rows need no rule.
    """
    kept = docs.drop(lang_pred, score)
    place = kept.columns.index(text)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, place, _DOCS):
            names, scores = predict(batch.column(place).to_pylist(), prototypes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, lang_pred, score],
            )

    return kept.mapInArrow(run, schema)
