"""Long texts are read in pieces: the same results, and memory that does not grow with a text's work."""

import random
import tracemalloc

import numpy as np
import pytest

from tollguard.llm import jaccard, language, repeats

DRAW = random.Random(8)
WORDS = ["".join(DRAW.choices("abcdefg", k=DRAW.randrange(1, 9))) for _ in range(3000)]
LONG = " ".join(DRAW.choices(WORDS, k=1_700_000))


def peak_of(call, *args):
    tracemalloc.start()
    call(*args)
    top = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return top


@pytest.mark.parametrize("call, args, megabytes", [
    (repeats.anchors, ([LONG.encode()[:9_000_000]],), 30),
    (repeats._context_hashes, ([LONG.encode()[:9_000_000]], [np.arange(0, 8_999_000, 97)]), 60),
    (jaccard.shingles, ([LONG[:9_000_000]],), 100),
    (language.hypervectors, ([LONG[: 1 << 20]],), 40),
])
def test_peak_of_a_long_text(call, args, megabytes):
    call(args[0][:0] or [args[0][0][:1000]], *[[a[0][:5]] for a in args[1:]])  # tables made once
    assert peak_of(call, *args) < megabytes


@pytest.mark.parametrize("window", [101, 256, 999])
def test_windows_choose_the_same_suffixes(monkeypatch, window):
    raws = [LONG[i * 700 : i * 700 + n].encode() for i, n in enumerate((0, 50, 199, 200, 201, 450, 3000, 120, 1300))]
    whole = repeats.anchors(raws)
    wanted = [whole[1][whole[0] == i] for i in range(len(raws))]
    contexts = repeats._context_hashes(raws, wanted)
    monkeypatch.setattr(repeats, "_WINDOW", window)
    assert len(whole[0]) > 60
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(raws), strict=True))
    assert all((a == b).all() for a, b in zip(contexts, repeats._context_hashes(raws, wanted), strict=True))


@pytest.mark.parametrize("piece", [1, 5, 40, 1000])
def test_pieces_have_the_shingles_of_the_whole(monkeypatch, piece):
    texts = ["".join(DRAW.choices("aé \n ", k=n)) for n in (3, 8, 20, 60, 400) for _ in range(8)] + ["a " * 3, LONG[:5000]]
    whole = [jaccard._shingles([t.encode()]) for t in texts]
    monkeypatch.setattr(jaccard, "_PIECE", piece)
    for t, (values, counts) in zip(texts, whole):
        again, n = jaccard.shingles([t])
        assert (again == values).all() and n.tolist() == counts.tolist()
