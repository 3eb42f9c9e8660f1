"""One registered query per operator, on its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tollguard.llm import (
    jaccard, language, lexical, linededup, mixing, quality, repeats, simhash, tokens, topk, variants, warc, wrappers,
)
from tollguard.llm.base import n_words
from tollguard.session import materialize, scratch_path

#: The rank file and pattern of the byte-level tokenizer in production.
BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "votes", "quality",
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _held_out().alias("held_out"))
    prototypes = language.learn(docs.filter(~F.col("held_out")))
    return language.identify(docs.drop("lang"), prototypes).drop("text")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_join(_table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "n_texts")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_documents(docs, *BPE, keep_ids=False).drop("text")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("_id") % 50 == 0))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(spark, folder).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = linededup.dedupe_lines(docs, n_lines="n_lines", n_removed="n_removed")
    return left.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrappers.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the size of a text is asked for: it is counted once, and the text itself does not travel
    docs = materialize(_table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words")))
    return mixing.plan_mix(docs, size=F.col("words")).select("row.doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


OP3 = r"""
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
starts AS (
  SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM raw WHERE n >= 200),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM starts),
repeated AS (SELECT doc_id, i FROM strings QUALIFY count(*) OVER (PARTITION BY s) > 1),
marked AS (
  SELECT *, coalesce(i > lag(i) OVER w + 200, true) AS new FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY ALL),
cut AS (
  SELECT r.doc_id, h, n, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before
  FROM raw r JOIN spans s ON s.doc_id = r.doc_id),
kept AS (
  SELECT doc_id, any_value(n) AS n, sum(b - a) AS removed, count(*) AS runs,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
      || any_value(substr(h, 2 * last + 1)) AS left_hex
  FROM (SELECT *, max(b) OVER (PARTITION BY doc_id) AS last FROM cut) GROUP BY doc_id)
SELECT r.doc_id, r.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM raw r LEFT JOIN kept k ON r.doc_id = k.doc_id
"""

OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
joined AS (SELECT array_to_string(w, ' ') AS whole, doc_id FROM words),
counts AS (
  SELECT a, count(*) AS n_links,
    count(DISTINCT y.whole) FILTER (WHERE y.whole <> x.whole) AS n_texts
  FROM links JOIN joined x ON x.doc_id = a JOIN joined y ON y.doc_id = b GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(least, d.doc_id)) AS class_id,
  coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_texts
FROM documents d LEFT JOIN classes ON classes.a = d.doc_id LEFT JOIN counts ON counts.a = d.doc_id
"""

OP6 = r"""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM placed WHERE rank <= 5
"""

OP7 = r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
answered AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest)
    ELSE page_id END AS response
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM answered
"""

OP8 = r"""
WITH parts AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS no,
    unnest(string_split(text, chr(10))) AS raw
  FROM documents),
trimmed AS (
  SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM parts),
lines AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS first_at
  FROM trimmed WHERE length(line) >= 20 GROUP BY line),
pairs AS (
  SELECT a.line AS a, b.line AS b, b.n, a.first_at AS a_at, b.first_at AS b_at
  FROM lines a JOIN lines b ON a.n = b.n AND a.line < b.line
  WHERE left(a.line, b.n // 2) = left(b.line, b.n // 2)
    OR right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2)
  UNION ALL
  SELECT a.line, b.line, b.n, a.first_at, b.first_at
  FROM lines a JOIN lines b ON a.n = b.n + 1
  WHERE left(a.line, b.n // 2) = left(b.line, b.n // 2)
    OR right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2)),
same AS (
  SELECT *, coalesce(list_position(
      list_transform(range(1, n + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)), false), n + 1) AS differs
  FROM pairs),
near AS (
  SELECT CASE WHEN a_at < b_at THEN b ELSE a END AS line FROM same
  WHERE substr(a, differs + 1) = substr(b, differs + CASE WHEN length(a) = n THEN 1 ELSE 0 END)),
kept AS (
  SELECT t.doc_id, t.no, t.raw
  FROM trimmed t LEFT JOIN lines l ON t.line = l.line
  WHERE l.line IS NULL
    OR (l.first_at = (t.doc_id, t.no) AND l.line NOT IN (SELECT line FROM near))),
rebuilt AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(raw, chr(10) ORDER BY no) AS left_text
  FROM kept GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - coalesce(n_kept, 0) END::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN md5(coalesce(left_text, '')) END AS kept_md5
FROM documents LEFT JOIN rebuilt USING (doc_id)
"""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY size, mixed, doc_id NULLS FIRST) - 1 AS place
  FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::BIGINT AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
stepped AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER below, 0)::DOUBLE AS budget,
    sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open_weight
  FROM sources
  WINDOW below AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(budget / open_weight) AS level FROM stepped),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 0) * weight) AS target,
    ('0x' || substr(md5('10:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM sources, level),
each AS (
  SELECT placed.doc_id, placed.size, targets.source_size, targets.target, place, shift,
    CASE WHEN targets.source_size > 0 THEN targets.target / targets.source_size ELSE 0 END AS f
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (least(2, floor((place + 1) * f + shift) - floor(place * f + shift)) * size)::BIGINT AS taken
FROM each
"""

OP11 = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
totals AS (
  SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM terms WHERE len(t) > 0),
held AS (
  SELECT doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms) GROUP BY doc_id, term),
frequent AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighted AS (
  SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM asked JOIN frequent USING (term), totals),
scored AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total)))))::BIGINT AS score
  FROM weighted JOIN held USING (term), totals GROUP BY item_id, doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

OP13 = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL HAVING length(any_value(run)) >= 6),
bytes AS (
  SELECT doc_id, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
summed AS (
  SELECT doc_id, run, c, xor(4294967295, list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)),
    4294967295::BIGINT)) AS crc
  FROM bytes),
spelt AS (
  SELECT CASE WHEN crc % 199 = 0
      THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c
  FROM summed),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM cut a JOIN cut b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.part = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.part = w.word),
best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chains AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT formed.word, n, n_near, form, form_n, root
FROM formed JOIN (
  SELECT c.word, c.root FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NULL) USING (word)
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_repeats": op3_repeats,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_main_text": op9_main_text,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_simhash": op12_simhash,
    "op13_variants": op13_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_repeats": OP3,
    "op4_ngram_jaccard": OP4,
    "op6_exact_top_k": OP6,
    "op7_warc": OP7,
    "op8_line_dedup": OP8,
    "op10_mixing": OP10,
    "op11_lexical_search": OP11,
    "op13_variants": OP13,
}
