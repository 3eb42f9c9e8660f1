"""N-gram Jaccard join: MinHash bands of a fixed depth and exact verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.llm.base import free_name, portions
from tollguard.llm.rolling import Rolling, mixed, odd_numbers
from tollguard.session import materialize

#: Words of a shingle, and the least similarity of a link as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Bands, the most rows of a band, and the share of links to be found.
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Texts of a bucket whose pairs are listed; larger buckets are compared in blocks of ``BLOCK``.
SMALL, BLOCK = 16, 128
#: Rows of (id, hash) that are broadcast to fetch texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_PIECE = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity shares one in some tree often enough.

    Two texts agree in a value of the signature with the chance of their similarity. The matched
    prefix is shortened from ``depth`` until the chance of a match reaches ``recall``.
    """
    for length in range(depth, 0, -1):
        if 1 - (1 - similarity**length) ** trees >= recall:
            return length
    return 1


@cache
def _constants() -> dict[str, np.ndarray]:
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return {"join": odd_numbers(SHINGLE, 41), "minhash": odd_numbers(TREES * DEPTH, 42),
            "label": odd_numbers(DEPTH, 43), "blank": blank}


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a buffer."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], ~_constants()["blank"][data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return Rolling(data).ranges(start, end), start


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and how many each text has.

    A text of fewer words than a shingle has one, of all its words; one without words has none.
    Long texts are read in pieces that repeat the last words of the piece before.
    """
    if len(texts) == 1 and len(texts[0]) > _PIECE:
        found = [_shingles([raw])[0] for raw in _overlapping(texts[0].encode())]
        whole = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
        return whole, np.array([len(whole)])
    return _shingles([t.encode() for t in texts])


def _overlapping(raw: bytes) -> Iterator[bytes]:
    """The words of a text in pieces of a shingle or more, each with the last words of the piece
    before; a text of fewer words is one piece."""
    at, carry, first = 0, [], True
    while at < len(raw):
        blank = _BLANK.search(raw, at + _PIECE)
        end = blank.start() if blank else len(raw)
        words, at = carry + raw[at:end].split(), end
        if len(words) >= SHINGLE:
            yield b" ".join(words)
            words, first = words[1 - SHINGLE :], False
        carry = words
    if first and carry:
        yield b" ".join(carry)


def _shingles(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of texts read whole."""
    c = _constants()
    words, start = _word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    upto = np.searchsorted(start, ends)
    n = np.diff(upto, prepend=0)
    padded = np.concatenate([words, np.zeros(SHINGLE, dtype=np.uint64)])
    joined = np.zeros(len(words), dtype=np.uint64)
    for j, factor in enumerate(c["join"]):
        joined += padded[j : j + len(words)] * factor
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = upto - n
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = words[first[i] : upto[i]]
        joined[first[i]] = (own * c["join"][: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    keep = np.arange(len(words)) < np.repeat(first + counts, n)
    return mixed(joined[keep]), counts


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a piece in total, with the number of the first."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _PIECE:
            yield low, texts[low:i]
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, texts[low:]


def _labels(values: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """A row per text with shingles: the hash of its prefix in every tree."""
    c = _constants()
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    out = np.empty((len(some), TREES), dtype=np.uint64)
    for tree in range(TREES):
        label = np.full(len(some), tree, dtype=np.uint64)
        for k in range(length):
            least = np.minimum.reduceat((values * c["minhash"][tree * DEPTH + k]) >> np.uint64(32), starts)
            label = mixed(label * c["label"][k] + least)
        out[:, tree] = label
    return out


def _signatures(docs: DataFrame, length: int) -> DataFrame:
    """(_id, _hash, _c1, _c2, _n, _labels) of each row of (_id, _hash, _text) that has a word.

    (_c1, _c2) is the digest of the words: rows that share it have the same words in order.
    """
    fields = [*docs.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in ("_c1", "_c2", "_n"))]
    schema = T.StructType([*fields, T.StructField("_labels", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, 512):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for low, part in _groups(texts):
                values, counts = shingles(part)
                if not len(values):
                    continue
                digests = [hashlib.md5(b" ".join(t.encode().split())).digest() for t in part]
                some = np.flatnonzero(counts)
                halves = np.frombuffer(b"".join(digests[i] for i in some), dtype=np.int64).reshape(-1, 2)
                labels = _labels(values, counts, length).astype(np.int64)
                columns = [batch.column(k).take(pa.array(some + low)) for k in (0, 1)]
                columns += [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(counts[some])]
                columns.append(
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, labels.size + 1, TREES), pa.int32()), pa.array(labels.ravel())
                    )
                )
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(_node, _set): the distinct shingles of the nodes' texts, sorted."""
    places = materialize(nodes.select("_node", F.col("_at._id").alias("_aid"), F.col("_at._hash").alias("_ahash")))
    small = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.join(
        F.broadcast(places) if small else places,
        F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_hash") == F.col("_ahash")),
    ).select("_node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, 512):
            for low, part in _groups(batch.column(1).to_pylist()):
                values, counts = shingles(part)
                sets = [np.unique(v).astype(np.int64) for v in np.split(values, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(part)), pa.array(sets, pa.list_(pa.int64()))],
                    names=["_node", "_set"],
                )

    return found.mapInArrow(run, "_node long, _set array<long>").dropDuplicates(["_node"])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``; in strips of bounded width."""
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    every, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    numbers = number[: len(owners[0])], number[len(owners[0]) :]
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for low in range(0, len(every), 4096):
        strips = []
        for x, owner, own in zip((a, b), owners, numbers):
            here = (own >= low) & (own < low + 4096)
            strip = np.zeros((len(x), 4096), dtype=np.float32)
            strip[owner[here], own[here] - low] = 1
            strips.append(strip)
        total += strips[0] @ strips[1].T
    return total.astype(np.int64)


def _compare_block(group: pa.Table) -> pa.Table:
    """All pairs of one block, or between two blocks, of a bucket: for each text its links (texts
    and documents) and one of the texts that its links connect it with.

    A pair is taken in the first of the large buckets that both are in, and nowhere else.
    """
    label, i, j = (group[c][0].as_py() for c in ("_label", "_i", "_j"))
    group = group.sort_by("_node")
    block = group["_block"].to_numpy()
    a, b = (group.filter(pa.array(block == k)) for k in (i, j))
    out = {"_node": [], "_with": [], "_texts": [], "_docs": []}
    if a.num_rows and b.num_rows:
        sets = [[v.values.to_numpy() for v in x["_set"]] for x in (a, b)]
        n_a, n_b = (np.array([len(v) for v in x]) for x in sets)
        common = _common(*sets)
        a_nodes, b_nodes = a["_node"].to_numpy(), b["_node"].to_numpy()
        num, den = SIMILARITY
        linked = den * common >= num * (n_a[:, None] + n_b[None, :] - common)
        if i == j:
            np.fill_diagonal(linked, False)
        hot_b = [set(h) for h in b["_hot"].to_pylist()]
        for x, hot in enumerate(a["_hot"].to_pylist()):
            before = [h for h in hot if h < label]
            for y in np.flatnonzero(linked[x]):
                if any(h in hot_b[y] for h in before):
                    linked[x, y] = False
        parent = {n: n for n in [*a_nodes, *b_nodes]}

        def root(n):
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for x, y in zip(*np.nonzero(linked)):
            p, q = sorted((root(a_nodes[x]), root(b_nodes[y])))
            parent[q] = p
        sides = [(a_nodes, linked, b), (b_nodes, linked.T, a)]
        for own, links, other in sides[: 1 if i == j else 2]:
            texts, docs = links.sum(axis=1), links @ other["_copies"].to_numpy()
            for k in np.flatnonzero(texts):
                node = own[k]
                for name, v in zip(out, (node, root(node), texts[k], docs[k])):
                    out[name].append(v)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _large(entries: DataFrame, block: int) -> DataFrame:
    """Links within the large buckets; each pair of blocks is a task of its own."""
    n_blocks = F.ceil(F.col("_size") / block).cast("int")
    rows = entries.withColumn("_block", F.pmod(F.xxhash64("_node", "_label"), n_blocks).cast("int"))
    mates = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda k: F.struct(F.least(k, F.col("_block")).alias("_i"), F.greatest(k, F.col("_block")).alias("_j")),
    )
    rows = rows.select("_label", "_node", "_block", "_set", "_copies", "_hot", F.inline(mates))
    return rows.groupBy("_label", "_i", "_j").applyInArrow(
        _compare_block, "_node long, _with long, _texts long, _docs long"
    )


def _small(entries: DataFrame, payload: DataFrame) -> DataFrame:
    """Links within the small buckets: distinct pairs, then the exact similarity."""
    right = entries.select("_label", *[F.col(c).alias(f"{c}_b") for c in ("_node", "_n", "_hot")])
    num, den = (F.lit(v) for v in SIMILARITY)
    pairs = entries.join(right, "_label").filter(
        (F.col("_node") < F.col("_node_b"))
        & (den * F.least("_n", "_n_b") >= num * F.greatest("_n", "_n_b"))
        & ~F.arrays_overlap("_hot", "_hot_b")
    )
    pairs = pairs.select("_node", "_node_b").distinct()
    other = payload.select(*[F.col(c).alias(f"{c}_b") for c in ("_node", "_set", "_copies")])
    pairs = pairs.join(payload, "_node").join(other, "_node_b")
    common = F.size(F.array_intersect("_set", "_set_b"))
    either = F.size("_set") + F.size("_set_b") - common
    pairs = pairs.filter(den * common >= num * either)
    ends = F.array(
        F.struct("_node", F.col("_node_b").alias("_with"), F.col("_copies_b").alias("_docs")),
        F.struct(F.col("_node_b").alias("_node"), F.col("_node").alias("_with"), F.col("_copies").alias("_docs")),
    )
    return pairs.select(F.inline(ends)).select("_node", "_with", F.lit(1).cast("long").alias("_texts"), "_docs")


def components(edges: DataFrame) -> DataFrame:
    """(_node, _root): the smallest node of each connected component of (_node, _with).

    Alternating large and small stars: every node's larger, then smaller neighbours are moved to
    its smallest one, until nothing moves. Each round is a table of at most as many edges.
    """
    edges = materialize(
        edges.filter("_node <> _with")
        .select(F.greatest("_node", "_with").alias("_node"), F.least("_node", "_with").alias("_with")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("_with").alias("_node"), F.col("_node").alias("_with")))
        least = both.groupBy("_node").agg(F.least(F.min("_with"), F.col("_node")).alias("_least"))
        large = (
            both.join(least, "_node").filter("_with > _node")
            .select(F.col("_with").alias("_node"), F.col("_least").alias("_with")).filter("_node <> _with").distinct()
        )
        large = materialize(large)
        least = large.groupBy("_node").agg(F.min("_with").alias("_least"))
        moved = large.join(least, "_node")
        ends = F.array(F.struct("_node", F.col("_least").alias("_with")), F.struct(F.col("_with").alias("_node"), F.col("_least").alias("_with")))
        small = materialize(moved.select(F.inline(ends)).filter("_node <> _with").distinct())
        same = small.count() == edges.count() and small.join(edges, ["_node", "_with"], "left_anti").isEmpty()
        if same:
            return small.select("_node", F.col("_with").alias("_root"))
        edges = small


def jaccard_join(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", small: int = SMALL, block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``class_id``, ``n_links``, ``n_texts``,
    ``keeper``.

    Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of
    0.8 or more. Words are runs of other characters than space and tab to carriage return; a text
    of one to four words has one shingle, of all of them. ``class_id`` is the smallest id of all
    documents that links connect, ``n_links`` counts the linked documents, ``n_texts`` the linked
    different texts, and ``keeper`` marks the row with the smallest (id, text hash) of a class.

    NULL, empty and blank texts have no links, stand alone and are keepers. Rows with equal id and
    text are documents of their own but for ``keeper``, which marks all of them. NULL ids come
    last. An empty table gives no rows. Other columns do not matter.

    Documents of equal words are one node, so groups of copies of any size cost one. Signatures
    are cut into bands of ``prefix_length`` rows; nodes that share a band are candidates. Pairs of
    small buckets are listed and verified, large ones are compared block by block inside tasks that
    send back a row per text, so no group emits all its pairs. Verification is exact.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_text")
    )
    length = prefix_length(SIMILARITY[0] / SIMILARITY[1])
    signed = materialize(_signatures(rows, length))
    nodes = signed.groupBy("_c1", "_c2").agg(
        F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")).alias("_at"),
        F.count(F.lit(1)).alias("_copies"), F.first("_n").alias("_n"), F.first("_labels").alias("_labels"),
    )
    nodes = materialize(nodes.withColumn("_node", F.monotonically_increasing_id()))
    entries = nodes.select("_node", F.explode("_labels").alias("_label"))
    sizes = entries.groupBy("_label").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    entries = entries.join(sizes, "_label")
    hot = F.collect_list(F.when(F.col("_size") > small, F.col("_label"))).alias("_hot")
    found = entries.groupBy("_node").agg(hot, F.collect_list(F.struct("_label", "_size")).alias("_in"))
    found = materialize(found.join(nodes.select("_node", "_at", "_copies", "_n"), "_node"))
    payload = materialize(found.join(_sets(found, rows), "_node").select("_node", "_set", "_copies", F.size("_set").alias("_size_set"), "_hot", "_in"))
    slim = payload.select("_node", F.col("_size_set").alias("_n"), "_hot", F.inline("_in")).filter(F.col("_size") <= small)
    slim = slim.select("_label", "_node", "_n", "_hot")
    large = payload.select("_node", "_set", "_copies", "_hot", F.inline("_in")).filter(F.col("_size") > small)
    links = materialize(_small(slim, payload.select("_node", "_set", "_copies")).unionByName(_large(large, block)))
    counts = links.groupBy("_node").agg(F.sum("_texts").alias("_texts"), F.sum("_docs").alias("_docs"))
    roots = components(links.select("_node", "_with"))
    known = nodes.select("_node", "_c1", "_c2", "_at", "_copies").join(counts, "_node", "left").join(roots, "_node", "left")
    known = known.withColumn("_root", F.coalesce("_root", "_node"))
    classes = known.groupBy("_root").agg(F.min("_at").alias("_first"))
    known = materialize(known.join(classes, "_root"))
    member = signed.select("_id", "_hash", "_c1", "_c2").join(
        known.select("_c1", "_c2", "_first", "_copies", "_texts", "_docs"), ["_c1", "_c2"]
    )
    linked = F.coalesce(F.col("_docs"), F.lit(0)) + F.col("_copies") - 1
    with_words = member.select(
        F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.col("_first._id").alias("class_id"),
        linked.alias("n_links"), F.coalesce("_texts", F.lit(0)).cast("long").alias("n_texts"),
        (F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_hash") == F.col("_first._hash"))).alias("keeper"),
    )
    blank = F.col("_text").isNull() | ~F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    none = F.lit(0).cast("long")
    without = rows.filter(blank).select(
        F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.col("_id").alias("class_id"),
        none.alias("n_links"), none.alias("n_texts"), F.lit(True).alias("keeper"),
    )
    return with_words.unionByName(without)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest (id, text hash).

    Texts without words all stay. Of rows equal in id and text one stays. Columns may have any names.
    """
    joined = materialize(jaccard_join(docs, text, doc_id))
    kid, khash, n_rows, linked = (free_name(c, docs) for c in ("_kid", "_khash", "_rows", "_linked"))
    keepers = joined.filter("keeper").groupBy(F.col("doc_id").alias(kid), F.col("text_hash").alias(khash)).agg(
        F.count(F.lit(1)).alias(n_rows), F.max((F.col("n_links") > 0).cast("int")).alias(linked)
    )
    row_hash = F.xxhash64(F.col(f"`{text}`"))
    kept = docs.join(keepers, F.col(f"`{doc_id}`").eqNullSafe(F.col(kid)) & (row_hash == F.col(khash)))
    again = (F.col(n_rows) > 1) & (F.col(linked) == 1)
    once = kept.filter(~again).select(*[F.col(f"`{c}`") for c in docs.columns])
    if keepers.filter(again).isEmpty():
        return once
    repeated = kept.filter(again).dropDuplicates([kid, khash])
    return once.unionByName(repeated.select(*[F.col(f"`{c}`") for c in docs.columns]))
