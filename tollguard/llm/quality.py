"""Quality rules under weak supervision: votes, estimated accuracies, posterior quality."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.session import materialize

SYMBOLS = "#*$%&|<>"
#: What is measured on every whole text, in this order, all longs.
SIGNALS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
    "n_capitals", "n_stops",
)
GOOD, BAD, ABSTAIN = 1, 0, 2


def measure(text: str | None) -> tuple[int, ...]:
    """The ``SIGNALS`` of a text; all 0 for NULL, empty and blank texts.

    Words are split at space and tab to carriage return only. Lines are split at ``\\n`` and count
    if they hold a word; an equal earlier line makes one a duplicate. A word is repeated if one of
    the three-word windows over it is found twice or more in the text.
    """
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0,) * len(SIGNALS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeated = 0
    if len(found) < len(windows):
        end = 0  # one past the last word counted
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    letters = sum(map(str.isalpha, text))
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        letters,
        sum(map(str.isupper, text)),
        sum(w.endswith((b".", b"!", b"?")) for w in words),
    )


def signals(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, unless named) and the ``SIGNALS`` of every text.

    Nothing is shuffled; columns named like a signal are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in SIGNALS]
    rows = docs.select(F.col(f"`{text}`").alias("_measured"), *[F.col(f"`{c}`") for c in kept])
    fields = [*rows.schema.fields[1:], *(T.StructField(s, T.LongType()) for s in SIGNALS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [measure(t.as_py()) for t in batch.column(0)]
            columns = [pa.array(v, pa.int64()) for v in zip(*values)] if values else []
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], *columns], names=[f.name for f in fields]
                )

    return rows.mapInArrow(run, T.StructType(fields))


def _vote(share: Column, bad: Column, good: Column) -> Column:
    vote = F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))
    return F.when(share.isNull(), F.lit(ABSTAIN)).otherwise(vote)


def rules() -> dict[str, Column]:
    """The votes, from the ``SIGNALS``; what cannot be measured (no word, no letter) abstains."""
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    symbols, dup, repeat = per("n_symbols", "word_chars"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words")
    length, letters = per("word_chars", "n_words"), per("n_letters", "word_chars")
    capitals, stops = per("n_capitals", "n_letters"), per("n_stops", "n_words")
    return {
        "symbols": _vote(symbols, symbols > 0.05, symbols < 0.01),
        "dup_lines": _vote(dup, dup > 0.3, dup == 0),
        "repeats": _vote(repeat, repeat > 0.3, repeat < 0.1),
        "word_length": _vote(length, (length < 3) | (length > 10), length.between(3.5, 7.0)),
        "letters": _vote(letters, letters < 0.8, letters > 0.92),
        "capitals": _vote(capitals, capitals > 0.4, capitals < 0.15),
        "stops": _vote(stops, stops > 0.5, stops.between(0.01, 0.3)),
    }


def base_failed() -> Column:
    """Too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def expectation_maximisation(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.7, trust: float = 0.02,
) -> np.ndarray:
    """The posterior probability of good for each distinct vote pattern.

    ``votes`` holds a row per pattern, ``counts`` how many documents have it. For both classes the
    estimate is the chance of each rule to vote good, bad or abstain, and the share of good
    documents. ``trust`` times all documents are added as pseudo-counts, which fix the meaning of
    the classes: a rule seldom votes bad on a good document and finds each fault in one bad
    document of four, so a good vote says little. The estimate starts from them.
    """
    n_rules, total = votes.shape[1], counts.sum()
    shown = np.stack([votes == v for v in (BAD, GOOD, ABSTAIN)], axis=2).astype(float)
    pseudo = np.empty((2, n_rules, 3))
    pseudo[0], pseudo[1] = (0.25, 0.5, 0.25), (0.005, 0.745, 0.25)
    pseudo *= max(1.0, trust * total)
    chance, share = pseudo / pseudo.sum(axis=2, keepdims=True), prior
    good = np.full(len(votes), prior)
    for _ in range(rounds):
        fit = np.stack([np.einsum("prv,rv->p", shown, np.log(chance[c])) for c in (0, 1)])
        fit += np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(fit[0] - fit[1], -500, 500)))
        weight = np.stack([(1 - new) * counts, new * counts])
        chance = np.einsum("cp,prv->crv", weight, shown) + pseudo
        chance /= chance.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 2 * prior) / (total + 2)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, least: float = 0.5) -> DataFrame:
    """``keep`` columns (all, unless named), ``SIGNALS``, ``votes``, ``base_failed``, ``quality``
    (posterior probability) and ``kept`` (passes the base, quality at least ``least``).

    Rules vote on measured signals. A pattern of votes is one of 3^7, so their counts over all
    documents, combined before the shuffle, are all that the driver sees; the estimate runs on
    them, and the posteriors come back as a broadcast table of that bounded size. NULL, empty and
    blank texts fail the base. Repeated rows count as often as they stand; ties of a posterior
    with ``least`` are kept. An empty table gives no rows. Columns of the added names are replaced.
    """
    named = rules()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"votes", "base_failed", "quality", "kept"}]
    digits = F.concat(*[v.cast("string") for v in named.values()])
    voted = materialize(signals(docs, text, kept).withColumn("votes", digits))
    patterns = sorted(tuple(r) for r in voted.groupBy("votes").count().collect())
    table = np.array([[int(c) for c in p] for p, _ in patterns]).reshape(-1, len(named))
    good = expectation_maximisation(table, np.array([n for _, n in patterns], dtype=float)) if patterns else []
    posterior = voted.sparkSession.createDataFrame(
        [(p, float(g)) for (p, _), g in zip(patterns, good)], "votes string, quality double"
    )
    return (
        voted.join(F.broadcast(posterior), "votes")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )
