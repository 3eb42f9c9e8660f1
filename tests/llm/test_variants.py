"""Spelling variants against all pairs of words: short and cut buckets, odd texts, chains of forms."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tollguard.llm import variants

SCHEMA = "doc_id long, text string, word int, n int, _key int, root int"


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def plain(rows, every=199):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run if h % every else run[:k] + run[k + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    mates = collections.defaultdict(list)
    for a, b in itertools.permutations(n, 2):
        if near(a, b):
            mates[a].append(b)
    form = {}
    for w, others in mates.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(mates[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    grouped = variants.group_variants(docs, **options)
    assert grouped.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in grouped.collect())


@pytest.mark.parametrize("small", [1, 4, 32])
def test_dense_words(spark, small):
    """Words of few letters: many anagrams, shared halves, ties of the best form, long chains."""
    draw = random.Random(3)
    base = ["".join(draw.choices("abé", k=draw.randrange(6, 8))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(base, [1 / (k + 1) for k in range(300)], k=200))) for i in range(40)]
    rows += [(100, "chainabcde " * 3125 + "chainabcdx " * 625 + "chainabcyx " * 125 + "chainabzyx " * 25 + "chainawzyx " * 5)]
    want = plain(rows, 7)
    assert found(spark, rows, every=7, small=small) == want
    assert sum(r[2] > 3 for r in want) > 20
    if small == 4:
        assert found(spark, rows) == plain(rows)
        assert ("chainawzyx", 5, 1, "chainabzyx", 25, "chainabcde") in plain(rows, 10**9)


def test_odd_texts_and_repeated_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "12 .. \n"), (4, "ÉTÉétés " * 6), (4, "ÉTÉétés " * 6), (5, "Strasse-STRASSE strasse Ωmega " * 5),
        (None, "nameless Nameless " * 3), (6, "letters×÷ÿ letters " * 120_000), (7, "z" * 500_000 + " "), (8, ("z" * 7000 + " ") * 5),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, every=1) == plain(rows, 1)
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "")]) == []


def test_signatures_of_near_words_meet():
    draw = random.Random(2)
    letters = "aabcdeé"
    for _ in range(400):
        word = "".join(draw.choices(letters, k=draw.randrange(6, 14)))
        i, c = draw.randrange(len(word)), draw.choice(letters)
        other = draw.choice((word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]))
        a, b = variants.signatures([word, other])
        assert len(a) == 15 and len(np.intersect1d(a, b)) >= 1
