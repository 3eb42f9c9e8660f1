"""SimHash near-duplicates against all pairs: short and large lists, odd texts, components."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tollguard.llm import queries, simhash

SCHEMA = "doc_id long, text string, _id int, _fp int, fingerprint int"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The component of each of a list of fingerprints, as the least place."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(prints))]


def test_query_equals_all_pairs(spark):
    rows = sorted(tuple(r) for r in queries.op12_simhash(spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d.text) for d in docs]
    least = plain_components(prints)
    want = [(d.doc_id, f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, least)]
    assert rows == want


@pytest.mark.parametrize("small", [0, 2, 32])
def test_links_of_close_fingerprints(spark, small):
    """Random fingerprints, balls around a few of them, and one ball within two bytes."""
    draw = random.Random(small)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for centre in [*list(prints)[:6], 0]:
        for _ in range(40):
            bits = draw.sample(range(64), draw.choice((1, 2, 3)))
            prints.add(centre ^ sum(1 << b for b in bits))
    prints |= {b << 24 for b in draw.sample(range(1 << 16), 60)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "_fp long")
    edges = [tuple(r) for r in simhash.links(nodes, small).collect()]
    place = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(place[a]), root(place[b])))
        parent[y] = x
    assert [root(i) for i in range(len(prints))] == plain_components(prints)


def test_odd_texts_and_repeated_rows(spark):
    long = "one two\tthree\nfour five six " * 60_000
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A "), (6, "a b"), (7, "é b c"), (7, "é b c"), (8, "É b c"),
        (None, "a"), (None, "lone words of its own kind here"), (9, long), (10, long.upper() + "\n"), (11, "x" * 400_000),
        (12, "q w e r t y u i o p " * 50_000 + "z"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    prints = sorted((str(r.doc_id), r.fingerprint) for r in found.collect())
    assert prints == sorted((str(d), f"{plain_print(t):016x}") for d, t in rows)
    of = {r.doc_id: r.component_id for r in found.filter(F.col("doc_id").isNotNull()).collect()}
    assert (of[1], of[2], of[3], of[5], of[9], of[10]) == (1, 1, 1, 4, 9, 9)
    nulls = sorted(str(r.component_id) for r in found.filter(F.col("doc_id").isNull()).collect())
    assert nulls == ["4", "None"] and found.count() == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_text_pieces(monkeypatch):
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab \n", k=n)) for n in range(40) for _ in range(5)]
    for piece in (1, 3, 7, 1 << 18):
        monkeypatch.setattr(simhash, "_PIECE", piece)
        assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
