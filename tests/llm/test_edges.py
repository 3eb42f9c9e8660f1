"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tollguard.llm import (
    jaccard, language, linededup, mixing, quality, queries, repeats, tokens, topk, warc, wrappers,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _row int, _id int, row int, kept int"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here "
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "x", "en", "b", 1),
    (5, PROSE * 3, "en", None, 9), (5, PROSE * 3, "en", None, 9), (6, PROSE * 3, None, "a", 9),
    (None, PROSE + "once more", "en", "a", 7), (7, PROSE * 20_000, "en", "b", 8),
    (8, "".join(chr(97 + i * i % 23) for i in range(300_000)), "xx", "b", 8), (9, "12 34 56", "en", "c", 8),
    (10, "der schnelle braune fuchs springt über den faulen hund und läuft weit weg " * 2, "de", "c", 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(docs, none):
    found = quality.judge(docs)
    assert set(found.columns) == {*docs.columns, *quality.SIGNALS, "votes", "base_failed", "quality", "kept"}
    rows = by_id(found)
    assert found.count() == len(ROWS)
    assert all(rows[k].n_words == 0 and rows[k].base_failed and not rows[k].kept for k in (1, 2, 3))
    assert rows[7].n_words == 300_000 and rows[7].base_failed
    assert rows[5]._row == 1 and rows[4].word_chars == 1
    assert quality.judge(none).count() == 0


def test_language(docs, none):
    prototypes = language.learn(docs)
    assert set(prototypes) == {"en", "de", "xx"}
    rows = by_id(language.identify(docs.withColumn("score", F.lit("clash")), prototypes))
    assert {k: rows[k].lang_pred for k in (1, 2, 3, 9)} == dict.fromkeys((1, 2, 3, 9), "und")
    assert (rows[1].score, rows[10].lang_pred, rows[7].lang_pred, rows[8].lang_pred) == (0.0, "de", "en", "xx")
    assert language.learn(none) == {}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(none, prototypes).count() == 0


def test_cutting_long_texts_changes_no_bundle(monkeypatch):
    texts = [PROSE * 50, "ünïcödé Wörter, ИЛИ слова! 12 " * 40, ""]
    whole = language.hypervectors(texts)
    monkeypatch.setattr(language, "_CHARS", 50)
    monkeypatch.setattr(language, "_GRAMS", 7)
    assert (language.hypervectors(texts) == whole).all()


def test_tokens(docs, none):
    path, pattern = queries.BPE
    encoded = tokens.encode_documents(docs.withColumn("ids", F.lit(1)), path, pattern)
    rows = by_id(encoded)
    assert (rows[1].n_tokens, rows[1].ids, rows[2].ids) == (0, [], [])
    assert rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert tokens.round_trips(encoded).filter("not round_trip").count() == 0
    decoded = by_id(tokens.decode_documents(encoded, path, pattern))
    assert bytes(decoded[10].decoded).decode() == ROWS[-1][1]
    assert tokens.encode_documents(none, path, pattern).count() == 0


def test_long_texts_are_spread_over_tasks(spark):
    path, pattern = queries.BPE
    encoder = tokens._codec(path, pattern)[0]
    draw = random.Random(2)
    parts = ["word", "b", " ", "\n", "'s", "1", "é", "  ", "!", "中", "😀", " " * 30, "x" * 45]
    rows = [(i, "".join(draw.choice(parts) for _ in range(n)), 0) for i, n in enumerate([0, 5, 40, 41, 80, 200, 200, 900])]
    rows += [(20, rows[-1][1], 0), (21, "y" * 700, 0), (22, None, 0), (23, " " * 400, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    found = tokens.encode_documents(docs, path, pattern, spread=60, chunk=25, overlap=10).collect()
    assert len(found) == len(rows) and {r.doc_id: r.ids for r in found} == {i: encoder.encode_ordinary(t or "") for i, t, _ in rows}
    assert found[0]._row == 0


def test_chunks_meet_where_the_whole_text_is_cut():
    path, pattern = queries.BPE
    encoder = tokens._codec(path, pattern)[0]
    draw = random.Random(1)
    parts = ["a", "b", " ", "\n", "'s", "'ll", "1", "é", "  ", "\t", "!", "中", "　", "\xa0", "Z", " " * 60, "x" * 90]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 200)))
        ids = tokens.encode(text, path, pattern, chunk=draw.choice([10, 20, 40]), overlap=draw.choice([3, 8, 10]))
        assert ids == encoder.encode_ordinary(text)
        assert tokens.decode(ids, path, pattern) == text.encode()
    for text in (" \t" * 300_000 + "a b", "y" * 400_000):  # longer than the encoder's matcher bears
        assert tokens.decode(tokens.encode(text, path, pattern), path, pattern) == text.encode()


def test_repeats(docs, none):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert bytes(found[1].kept) == b"" and found[1].spans == [] and found[1].n_bytes == 0
    assert bytes(found[5].kept) == b"" and found[7].spans == [(0, len(PROSE) * 20_000)]
    assert found[8].n_bytes == 300_000 and bytes(found[4].kept) == b"x"
    assert found[10].spans == [] and found[5]._row == 1
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_repeats_at_all_offsets(spark, bucket):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [text(260), text(199), text(205), text(700)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(shared)
            parts += [text(draw.randint(0, 150)), p[draw.randint(0, 20) : len(p) - draw.randint(0, 20)]]
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 450), (201, "ab" * 300), (206, "z" * 200), (207, "z" * 199), (208, shared[3])]
    raws = [t.encode() for _, t in rows]
    count = collections.Counter(x[i : i + 200] for x in raws for i in range(len(x) - 199))
    want = collections.Counter()
    for (doc, _), raw in zip(rows, raws):
        marks = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                marks[i : i + 200] = b"\1" * 200
        want[doc, bytes(b for b, m in zip(raw, marks) if not m)] += 1
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket)
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in found.collect()) == want


def test_copies_of_a_text_take_part_once(spark, monkeypatch):
    draw = random.Random(7)
    text = lambda n: "".join(draw.choice("abcdefgh \n") for _ in range(n))
    passage, first, last = text(600), text(300), text(300)
    rows = [(i, first + passage) for i in range(200)] + [(200, passage + last), (201, text(500))]
    merged, arrays = repeats._merged_spans, []

    def seen(spans):
        arrays.extend(r[0] for r in spans.select(F.size("_starts")).collect())
        return merged(spans)

    monkeypatch.setattr(repeats, "_merged_spans", seen)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in found}
    assert kept == {**dict.fromkeys(range(200), ""), 200: last, 201: rows[-1][1]}
    assert len(arrays) == 1 and arrays[0] <= 600


def test_jaccard(docs, none):
    rows = jaccard.jaccard_join(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert all(found[k].class_id == k and found[k].n_links == 0 for k in (1, 2, 3, 4))
    assert (found[6].class_id, found[6].n_links, found[6].n_texts) == (5, 3, 1)  # with 5 twice, and 7
    assert jaccard.jaccard_join(none).count() == 0
    left = sorted((r.doc_id or 0) for r in jaccard.drop_near_duplicates(docs).collect())
    assert left == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert jaccard.drop_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize(("small", "block"), [(16, 128), (3, 10)])
def test_jaccard_equals_brute_force(spark, small, block):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(120)]
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for i in range(40)]
    rows += [(300 + i, draw.choice(rows)[1].replace(" ", "\n")) for i in range(20)]
    rows += [(400, "a b"), (401, "a b"), (402, "a b c")]

    def shingles(text):
        w = tuple(text.split())
        return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w}

    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = sorted((d, rows[root(i)][0], links[i]) for i, (d, _) in enumerate(rows))
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=small, block=block)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == want


def test_prefixes_are_shortened_until_the_recall():
    assert jaccard.prefix_length(0.8) == 5
    assert jaccard.prefix_length(0.95) > 5 > jaccard.prefix_length(0.6) >= 1
    assert 1 - (1 - 0.8**5) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8**6) ** jaccard.TREES


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "_node long, _with long")
    found = {r._node: r._root for r in jaccard.components(edges).collect()}
    assert {found[i] for i in range(1, 101)} == {0} and found[501] == 500


def test_top_k(spark):
    rows = [
        (50, [1.0, 0.5]), (51, [1.0, 0.5]), (52, [1.0, 0.5]), (53, [-1.0]), (54, None), (55, [1.0, None]),
        (56, [float("nan"), 1.0]), (57, [float("inf")]), (58, []), (100, [0.0, 2.0]), (100, [0.0, 2.0]), (None, [1.0]),
    ]
    given = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.top_k(given, given.filter(F.col("_id") % 50 == 0), k=3, query_block=2, slot_rows=3).collect()
    fifty = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 50)
    assert fifty == [(1, 51, 81920), (2, 52, 81920), (3, 100, 65536)]
    hundred = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 100)
    assert hundred == sorted(2 * [(1, 50, 65536), (2, 51, 65536), (3, 52, 65536)])
    assert topk.top_k(given, given.filter("_id < 0")).count() == 0
    assert topk.top_k(given.filter("_id < 0"), given).count() == 0


def test_warc(spark, tmp_path):
    large = "é<p>\r\n\r\nWARC/1.1\r\n" * 400
    rows = [
        (1, "http://a/\r\nx", large, 0), (2, None, large, 0), (3, "http://b/", large, 0), (4, "u", "small", 0),
        (5, "u", "small", 0), (6, "u", None, 0), (7, "u", "", 0), (8, "u", "x" * 50_000, 0), (None, "u", "x" * 50_000, 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _bytes int")
    folder = warc.write_archives(pages, str(tmp_path / "a"), segment=1000)
    found = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(found) == len(rows) and all(r.sound for r in found.values())
    for page_id, url, html, _ in rows:
        raw = (html or "").encode()
        got = found[None if page_id is None else str(page_id)]
        assert (got.payload_bytes, got.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(found[k].record_type, found[k].refers_to) for k in "123"] == [
        ("revisit", "3"), ("revisit", "3"), ("response", None)]
    assert {found[k].record_type for k in "45678"} == {"response"} and found[None].refers_to == "8"
    assert found["8"].n_segments == 50 and found["1"].url == "http://a/ x" and found["2"].url is None
    empty = warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, empty).count() == 0


def test_line_dedup(docs, none):
    found = linededup.dedupe_lines(docs, n_lines="n_lines", n_removed="n_removed")
    rows = by_id(found)
    assert found.count() == len(ROWS) and set(found.columns) == {*docs.columns, "n_lines", "n_removed"}
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == " \n\t " and rows[4].text == "x"
    assert rows[5].text == PROSE * 3 and rows[6].text == "" and rows[6].n_removed == 1
    assert rows[7].text == PROSE * 20_000 and rows[5]._row == 1
    assert linededup.dedupe_lines(none).count() == 0


@pytest.mark.parametrize("bucket", [2, 32])
def test_line_dedup_equals_brute_force(spark, bucket):
    draw = random.Random(3)
    base, lines = "the quick brown fox jumps over 😀 lazy dogs", []
    for i in range(150):
        own = []
        for _ in range(draw.randint(0, 5)):
            chars = list(base)
            for _ in range(draw.randint(0, 2)):
                j = draw.randrange(len(chars))
                chars[j : j + draw.randint(0, 1)] = draw.choice(["", "x", "é"])
            own.append("".join(chars) + draw.choice(["", " ", "\r"]) if draw.random() < 0.8 else "short")
        lines.append((i, own))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    seen, want = [], {}
    for i, own in lines:
        kept = []
        for line in own:
            key = line.strip(" \t\r\f\v")
            if len(key) < 20 or not any(near(key, s) for s in seen):
                kept.append(line)
            if len(key) >= 20:
                seen.append(key)
        want[i] = "\n".join(kept)
    rows = spark.createDataFrame([(i, "\n".join(own)) for i, own in lines], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedupe_lines(rows, bucket=bucket).collect()} == want


def test_line_dedup_takes_exact_copies_of_short_lines(spark):
    texts = ["Read more\nx\n Read more\r\n\nRead More\nx\n\n" + "a line of more than twenty\n" * 2 + "Read more", "Read more", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(linededup.dedupe_lines(docs, short_copies=False, n_removed="n_removed"))
    assert found[0].text == "Read more\nx\n\nRead More\n\na line of more than twenty"
    assert found[0].n_removed == 4 and found[1].text == "Read more" and found[2].text is None and found[3].text == ""


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("edits", [(0, 25), (0, 0, 30, 45), (30,)])
def test_line_dedup_with_more_edits_equals_brute_force(spark, edits, block):
    draw = random.Random(5)
    bases = ["the quick brown fox jumps over 😀", "a line that holds quite a few more words than the other one"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    def edited():
        chars = list(draw.choice(bases)[draw.randint(0, 2) :])
        for _ in range(draw.randint(0, 6)):
            j = draw.randrange(len(chars))
            chars[j : j + draw.randint(0, 1)] = draw.choice(["", "x", "é", "t"])
        return "".join(chars)

    docs = [(i, [edited() for _ in range(draw.randint(0, 4))]) for i in range(60)]
    seen, want = [], {}
    for i, own in docs:
        kept = []
        for line in own:
            key = line.strip()
            alike = any(distance(key, s) <= sum(min(len(key), len(s)) >= least for least in edits) for s in seen)
            if len(key) < 20 or not alike:
                kept.append(line)
            if len(key) >= 20:
                seen.append(key)
        want[i] = "\n".join(kept)
    rows = spark.createDataFrame([(i, "\n".join(own)) for i, own in docs], "doc_id long, text string")
    found = linededup.dedupe_lines(rows, edits=edits, block=block).collect()
    assert {r.doc_id: r.text for r in found} == want


def test_bits_equal_the_edit_distance(spark):
    draw = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    word = lambda: "".join(draw.choice("ab😀é") for _ in range(draw.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(800)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (0, 1, 2):
        found = df.withColumn("near", linededup.bit_parallel_within(F.col("a"), F.col("b"), edits)).collect()
        assert all(bool(r.near) == (distance(r.a, r.b) <= edits) for r in found)


def test_mixing(docs, none):
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(ROWS)
    sizes = {r.row.doc_id: r["size"] for r in planned}
    assert (sizes[1], sizes[2], sizes[3], sizes[7]) == (0, 0, 0, 300_000)
    assert all(r.taken <= 2 * r["size"] and r.copies <= 2 for r in planned)
    again = mixing.plan_mix(docs.repartition(5)).collect()
    key = lambda r: (r.row.doc_id or 0, r.row.source or "", r.copies)
    assert sorted(map(key, planned)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)
    assert mixing.plan_mix(none).count() == 0 and mixing.plan_mix(docs.filter("doc_id < 4")).count() == 3


def test_targets_share_what_caps_leave(spark):
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(100 + i, "w " * 10, "b") for i in range(100)]
    rows += [(300 + i, "w " * 10, "c") for i in range(100)] + [(500, "w", None)]
    targets = {r.row.source: r.target for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    total = 1.5 * 2101
    assert targets["a"] == 200 and targets[None] == 2  # both capped at twice their words
    assert targets["b"] == pytest.approx((total - 202) * 2 / 3) and targets["c"] == pytest.approx((total - 202) / 3)


def test_main_text(spark):
    page = (
        "<body><header>top</header><nav><ul><li>a<li>b</ul></nav><p class='ad-box'>buy</p><article><h1>T &amp; t</h1>"
        "<p>one <b>two<p>three&nbsp; four<script>x='<p>'</script><ul><li>l1<li>l2</ul><aside>side</aside>"
        "<section id=comments><article><p>me</p></article></section><form>f</form></article><footer>end"
    )
    layout = (
        "<body class=with-sidebar><div class='page nav-left'><article class=post><header><h1>H</h1></header><p>x"
        "<div class=comments>c<article>d</article></div></article><div class=sidebar>s</div></div>"
        "<section id=comments><article class=comment><p>me</article></section>"
    )
    bare = "<html><body><div>Site name</div><div><p>Story {0}</p><p>More {0}</p></div><div class='cookie'>ok?</div></body>"
    rows = [(1, "http://H.example/1", page, 0), (2, None, None, 0), (3, "x", "", 0), (4, "http://b.example/", bare.format(1), 0),
            (5, "http://b.example/2", bare.format(2), 0), (6, "http://c.example/", bare.format(3), 0),
            (7, "http://h.example", "<p>" + "long " * 100_000, 0), (1, "http://h.example/1", page, 0),
            (9, "http://l.example/", layout, 0), (8, "http://h.example/8", "a < b &lt; c &#x4e2d; &am", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int")
    found = {r.page_id: r for r in wrappers.extract(pages).collect()}
    assert found[1].main_text == "T & t\none two\nthree four\nl1\nl2"
    assert found[2].main_text == found[3].main_text == "" and found[2].n_chars == 0
    assert found[4].main_text == "Story 1\nMore 1" and found[6].main_text == "Site name\nStory 3\nMore 3"
    assert found[9].main_text == "H\nx"
    assert found[7].n_chars == 499_999 and found[8].main_text == "a < b < c 中 &am"
    assert wrappers.extract(pages).count() == len(rows) and wrappers.extract(pages.limit(0)).count() == 0


def test_fixed_slots_bear_pages_that_cannot_have_them(spark):
    bare = "<body><div>Site name</div><div><ul><li>Home<li>News</ul></div><div><p>Story {0}</p><p>More {0}</p></div></body>"
    rows = [(i, "http://b.example/", bare.format(i)) for i in range(5)]
    rows += [(5, "http://b.example/", None), (6, "http://b.example/", ""), (7, "http://b.example/", bare.format(7).replace("<div>Site name</div>", ""))]
    rows += [(8, "http://b.example/", "<article><p>Own</article>"), (9, "http://b.example/", "<main><p>Own</main>")]
    rows += [(i, "http://c.example/", bare.format(min(i, 18))) for i in range(10, 30)]  # mostly copies
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.main_text for r in wrappers.extract(pages).collect()}
    assert all(found[i] == f"Story {i}\nMore {i}" for i in (0, 1, 2, 3, 4, 7, *range(10, 18)))
    assert all(found[i] == "Story 18\nMore 18" for i in range(18, 30))
    assert found[5] == found[6] == "" and found[8] == found[9] == "Own"


def test_wrappers_have_optional_and_repeated_groups(spark):
    item = lambda n, ad: f"<body>{'<div>ad</div>' * ad}<ul>{'<li>x</li>' * n}</ul><p>t</p></body>"
    rows = [(i, "http://a.example/", item(n, ad)) for i, (n, ad) in enumerate([(1, 0), (3, 1), (5, 0)])]
    found = wrappers.infer(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 1 and found[0].n_pages == 3
    wrapper = json.loads(found[0].wrapper)
    assert wrapper == [["body", [["?", [["div", ["#"]]]], ["ul", [["+", [["li", ["#"]]]]]], ["p", ["#"]]]]]
    assert wrappers.slot_paths(wrapper) == {"body>div", "body>ul>li", "body>p"}


@pytest.mark.parametrize("page, text", [
    ('<article class="social-story"><p>Body</p></article>', "Body"),
    ('<article class="related"><p>All of it</p></article>', "All of it"),
    ('<article><p>a</p><section class="notice-of-motion">b</section></article>', "a\nb"),
    ('<article><p>a</p><div class="ad-slot-3">ad</div><div class="related-links">r</div></article>', "a"),
    ('<body><form id="aspnetForm"><article><p>x</p></article></form></body>', "x"),
    ('<body><form id="f"><div><p>a longer text</p></div></form><nav>n</nav></body>', "a longer text"),
    ('<body><p>a longer text</p><form>Name <input></form></body>', "a longer text"),
    ('<div class="page with-sidebar"><article>k</article><div class="sidebar">s s s s</div></div>', "k"),
    ('<div class="layout-with-sidebar"><p>a longer text</p><div id="sidebar">s</div></div>', "a longer text"),
    ('<body><article><p>A</p></article><section id="comments"><article>c c c c c</article></section></body>', "A"),
    ('<body><div class="comment-list">long long long</div><p>s</p></body>', "s"),
    ('<article><p>one <span class="note">two</span> <span class="top-alert-x">three</span></p></article>', "one two three"),
    ('<p title="x>Hello</p><p>World</p>', "Hello\nWorld"),
    ("<p title='a>b' id=c>It's</p><p lang=\"d>e</p>", "It's\ne"),
    ("<p>a</b></p></div><p>b<table><tr><td>c<td>d<tr><td>e</table>f", "a\nb\nc\nd\ne\nf"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a\nb\nc\nd"),
])
def test_words_and_broken_markup_lose_no_text(page, text):
    assert "\n".join(wrappers.choose(page, frozenset())) == text


def test_deep_pages_are_read_in_linear_time(spark):
    seconds = []
    for n in (4_000, 32_000):
        started = time.perf_counter()
        found = wrappers.choose("<div>a" * n, frozenset())
        seconds.append(time.perf_counter() - started)
        assert found == ["a"] * n
    assert seconds[1] < 40 * max(seconds[0], 0.02)
    deep = spark.createDataFrame([(1, "http://a.example/", "<div>a" * 3_000), (2, "http://b.example/", "<div>a" * 1_500)],
                                 "page_id long, url string, html string")
    assert wrappers.infer(deep).count() == 2
    assert {r.n_chars for r in wrappers.extract(deep).collect()} == {5_999, 2_999}


CLASHING = ("_rows", "_kid", "_khash", "_linked", "_pieces", "_PIECES", "_score", "_lang_pred", "_row", "_t1", "_ids", "_text")


def test_no_column_name_clashes(spark):
    from corpus_pipeline import BPE

    text = " ".join(f"w{i}" for i in range(60))
    plain = spark.createDataFrame(
        [(1, text), (2, text + " x"), (3, None), (4, "other " * 30), (1, text)], "doc_id long, text string"
    )
    docs = plain.select("*", *[F.lit(c).alias(c) for c in CLASHING if c != "_PIECES"])
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert all(r["_rows"] == "_rows" for r in kept.collect())
    coded = tokens.encode_documents(docs, *BPE, spread=100, chunk=64, overlap=32)
    assert coded.columns[: len(docs.columns)] == docs.columns
    got, want = ({(r.doc_id, r.ids_sha256) for r in x.collect()} for x in (coded, tokens.encode_documents(plain, *BPE)))
    assert got == want and all(r["_pieces"] == "_pieces" for r in coded.collect())
    upper = plain.select("*", F.lit(1).alias("_PIECES"))
    assert tokens.encode_documents(upper, *BPE).count() == 5


def test_pages_are_matched_with_the_wrapper_of_their_host(spark):
    # same path and same words: only the place in the wrapper tells the site's line from the story's
    page = "<body><div>{0}</div><ul><li>x</ul><div>{1}</div>{2}</body>"
    lines = [("Site", f"Story {i}", "<table><tr><td>t</table>" * (i % 2)) for i in range(9)] + [("Site", "Site", "")]
    rows = [(i, "http://a.example/", page.format(*line)) for i, line in enumerate(lines)]
    found = {r.page_id: r.main_text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "Site"
    assert all(found[i] == f"Story {i}" for i in range(9))  # "t" stands on all pages that have the table


def test_match_finds_optional_and_repeated_slots():
    def read(page):
        elements, blocks = wrappers.slots(page)
        found = {b: slot for slot, _, held in wrappers.match(wrapper, wrappers._nodes(elements)) for b in held}
        return {text: found[b] for b, (_, text) in enumerate(blocks)}

    wrapper = json.dumps([["body", [["?", [["div", ["#"]]]], ["ul", [["+", [["li", ["#"]]]]]], ["+", [["h2", ["#"]], ["?", [["p", ["#"]]]]]], ["div", ["#"]]]]])
    one = read("<body><div>a</div><ul><li>b<li>c</ul><h2>d</h2><p>e</p><h2>f</h2><h2>g</h2><p>h</p><div>i</div>")
    assert one["b"] == one["c"] and one["d"] == one["f"] == one["g"] and one["e"] == one["h"] and one["a"] != one["i"]
    two = read("<body><ul><li>b</ul><section>s</section><h2>d</h2><div>i</div>")
    assert {k: one[k] for k in "bdi"} == {k: two[k] for k in "bdi"} and two["s"] not in one.values()


def test_wrappers_choose_within_articles_too(spark):
    story = "<body><article><h1>Title {0}</h1><p>Story {0}</p><p class=x7>Subscribe now</p></article><article><p>Read also</p></article></body>"
    inner = "<body><main><div class=x7>Our motto</div><p>Story {0}</p></main></body>"
    teaser = "<body><article><p>Join us</p></article><div><p>A story told at length, number {0}</p></div></body>"
    copied = "<body><article><p>One article that all of these pages show</p></article><div>{0} views</div></body>"
    rows = [(i, "http://a.example/", story.format(i)) for i in range(6)]
    rows += [(6, "http://a.example/", story.format(6).replace("<p class=x7>Subscribe now</p>", "")), (7, "http://a.example/", None)]
    rows += [(8, "http://a.example/", "<body><article><p>Read also</p></article></body>")]  # the template alone
    rows += [(i, "http://b.example/", inner.format(i)) for i in range(10, 13)]
    rows += [(i, "http://c.example/", teaser.format(i)) for i in range(20, 23)]
    rows += [(i, "http://d.example/", copied.format(i)) for i in range(30, 33)]
    rows += [(i, "http://e.example/", story.format(1)) for i in range(40, 43)]  # copies of one page
    # pages of another kind on the host are no evidence
    rows += [(i, "http://f.example/", f"<body><div>Site</div><p>Story {i}</p></body>") for i in range(50, 53)]
    rows += [(i, "http://f.example/", f"<body><div>Topic {i}</div><article><p>Story {i}</p></article></body>") for i in range(60, 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.main_text for r in wrappers.extract(pages).collect()}
    assert [found[i] for i in range(7)] == [f"Title {i}\nStory {i}" for i in range(7)]
    assert found[7] == "" and found[8] == "Read also"
    assert [found[i] for i in range(10, 13)] == [f"Story {i}" for i in range(10, 13)]
    assert [found[i] for i in range(20, 23)] == [f"A story told at length, number {i}" for i in range(20, 23)]
    assert all(found[i] == "One article that all of these pages show" for i in range(30, 33))
    assert all(found[i] == "Title 1\nStory 1\nSubscribe now\nRead also" for i in range(40, 43))
    assert [found[i] for i in (*range(50, 53), *range(60, 80))] == [f"Story {i}" for i in (*range(50, 53), *range(60, 80))]
