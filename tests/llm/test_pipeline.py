"""The pipeline against a brute-force version of its five stages, and its stages on odd tables."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tollguard.llm import language, queries, tokens

SF_DIR = "/root/testdata/sf0.001"


def near(a, b):
    """At most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def known_languages(docs):
    sums = {}
    for _, text, lang, _ in docs:
        sums[lang] = sums.get(lang, 0) + language.hypervectors([text])[0]
    names, scores = language.predict([d[1] for d in docs], sums)
    return [d for d, n, s in zip(docs, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_SCORE]


def without_repeated_lines(docs):
    seen, out = {}, []
    for doc_id, text, lang, source in docs:
        kept = []
        for line in text.split("\n"):
            key = line.strip(" \t\r\f\v")
            alike = (s for n in (-1, 0, 1) for s in seen.get(len(key) + n, ()))
            if len(key) < 20 or not any(near(key, s) for s in alike):
                kept.append(line)
            if len(key) >= 20:
                seen.setdefault(len(key), set()).add(key)
        out.append((doc_id, "\n".join(kept), lang, source))
    return out


def without_near_copies(docs):
    sets = []
    for _, text, _, _ in docs:
        w = tuple(text.encode().split())
        sets.append({w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [d for i, d in enumerate(docs) if root(i) == i]


def mixed(docs):
    size = lambda text: len(text.encode().split())
    totals = collections.Counter()
    for _, text, _, source in docs:
        totals[source] += size(text)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(totals))}
    targets, open_sources, budget = {}, set(totals), 1.5 * sum(totals.values())
    while True:
        level = budget / sum(weights[s] for s in open_sources)
        full = {s for s in open_sources if 2 * totals[s] <= level * weights[s]}
        if not full:
            break
        for s in full:
            targets[s] = 2.0 * totals[s]
            budget -= 2 * totals[s]
        open_sources -= full
    targets |= {s: level * weights[s] for s in open_sources}
    out = []
    for source in totals:
        digest = lambda d: hashlib.md5(str(d).encode()).hexdigest()
        rows = sorted((d for d in docs if d[3] == source), key=lambda d: (size(d[1]), digest(d[0]), d[0]))
        each = targets[source] / totals[source] if totals[source] else 0
        offset = int(hashlib.md5(f"10:{source}".encode()).hexdigest()[:8], 16) / 2**32
        for i, d in enumerate(rows):
            out += [d] * (math.floor((i + 1) * each + offset) - math.floor(i * each + offset))
    return out


def test_run_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()
    encoder = tokens._codec(*queries.BPE)[0]
    want = collections.Counter()
    for doc_id, text, _, _ in mixed(without_near_copies(without_repeated_lines(known_languages(docs)))):
        want[doc_id, tuple(encoder.encode_ordinary(text))] += 1
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in found)


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_duplicates", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [0, 6])
def test_stages_bear_nulls_repeats_and_empty_tables(spark, rows):
    text = "the quick brown fox jumps over the lazy dog and runs away "
    given = [(1, text * 3, "en", "a", 1), (1, text * 3, "en", "a", 1), (None, None, None, None, None),
             (2, "", "en", "b", 0), (3, "12", None, "b", 2), (4, "Ja.", "de", None, 3)][:rows]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF_DIR)
        if name != "byte_bpe":
            assert docs.columns == columns, name
    assert {r.doc_id for r in docs.collect()} <= {1, 4}


def test_clean_documents_pass_the_language_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert corpus_pipeline.identify_language(spark, docs, SF_DIR).count() == docs.count()


def test_random_letters_do_not_pass_the_language_stage(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    rows = [(-i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 20, 50, 200, 1000, 5000] * 5, 1)]
    noise = spark.createDataFrame(rows, "doc_id long, text string")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(noise, allowMissingColumns=True)
    left = corpus_pipeline.identify_language(spark, docs, SF_DIR)
    assert left.filter("doc_id < 0").count() == 0 and left.count() == docs.count() - len(rows)
