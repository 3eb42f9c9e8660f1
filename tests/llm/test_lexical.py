"""Ranked lexical search against a plain scorer: pruning, ties, odd texts, the shuffled vocabulary."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tollguard.llm import lexical

DOCS = "doc_id long, text string, _id int, _row int, item_id int"
ITEMS = "item_id long, text string, doc_id int, _q int, _term int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """(item, rank, id, score) by scoring every document for every item."""
    counted = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counted:
            m = 25 + 75 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms_of(text) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    items = spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEMS)
    ranked = lexical.rank(docs, items, **options)
    assert ranked.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in ranked.collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " .,\n"), (4, "Éa Straße _x_ 12"), (5, "the cat the cat"), (6, "the cat the cat"),
    (6, "the cat the cat"), (None, "the cat the cat"), (7, "THE dog. " * 200_000), (8, "x" * 300_000), (9, "émile É"),
]
ASKED = [(0, "The cat"), (1, None), (2, "..."), (3, "straße É éa 12 12"), (3, "dog x"), (4, "absent"), (None, "cat")]


@pytest.mark.parametrize("vocabulary", [lexical.VOCABULARY, 0])
def test_odd_texts_ties_and_repeats(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    for k in (2, 10):
        assert found(spark, ODD, ASKED, k=k) == plain(ODD, ASKED, k)


def test_many_slots_and_blocks(spark):
    draw = random.Random(5)
    words = [f"w{min(int(draw.paretovariate(0.6)), 500)}" for _ in range(60_000)]
    docs = [(i, " ".join(words[draw.randrange(59_000) :][: draw.randrange(60)])) for i in range(700)]
    docs += [(900 + i, docs[3][1]) for i in range(50)]
    items = [(i, " ".join(draw.choices(words, k=8))) for i in range(30)]
    assert found(spark, docs, items, query_block=7, slot_postings=1000) == plain(docs, items)


@pytest.mark.parametrize("short", [0, 20, 400, 10**9])
def test_windows_and_bounds_lose_nothing(monkeypatch, short):
    monkeypatch.setattr(lexical, "WINDOW", 16)
    draw = np.random.default_rng(short)
    held = [np.flatnonzero(draw.random(40) < draw.random(40) ** 3) for _ in range(500)]
    tfs = [draw.integers(1, 4, len(h)) for h in held]
    ids, m = draw.permutation(500), draw.integers(25, 300, 500)
    slot = lexical.Slot(pa.array(ids), m, pa.array(held, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64())))
    for _ in range(40):
        terms, weights = draw.permutation(50)[:9], draw.integers(0, 3000, 9)
        full = np.zeros(500, dtype=np.int64)
        for i, (h, tf) in enumerate(zip(held, tfs)):
            for t, w in zip(terms, weights):
                for f in tf[h == t]:
                    full[i] += w * (10**9 * f // (1000 * f + 8 * m[i]))
        best = lexical.search(slot, terms, weights, 5, short)
        want = sorted((-s, d) for s, d in zip(full, ids) if s > 0)[:5]
        assert [(-s, ids[slot.order[p]]) for s, p in zip(best.scores, best.places)] == want


def test_skipping_reads_less():
    """Once k documents score high, windows that cannot beat them are not read."""
    n = 40 * lexical.WINDOW
    held = [[0, 1]] * 10 + [[1]] * (n - 10)
    lists = pa.array(held, pa.list_(pa.int64()))
    ones = pa.array([[1] * len(h) for h in held], pa.list_(pa.int64()))
    slot = lexical.Slot(pa.array(range(n)), np.full(n, 100), lists, ones)
    read = []
    whole = slot.span
    slot.span = lambda *a: read.append(a) or whole(*a)
    best = lexical.search(slot, np.array([0, 1]), np.array([5000, 1]), 10)
    assert best.places.tolist() == list(range(10)) and len(read) <= 3


def test_empty_tables(spark):
    assert found(spark, [], ASKED) == [] and found(spark, ODD, []) == [] and found(spark, [(1, None)], ASKED) == []
