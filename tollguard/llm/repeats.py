"""Removal of repeated byte strings with a sparse, range-partitioned suffix array."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.llm.base import portions
from tollguard.llm.rolling import Rolling, mixed
from tollguard.session import materialize

#: Bytes of a repeated string, and of the leading bytes by which suffixes are partitioned. Every
#: string of ``LENGTH`` bytes holds ``LENGTH - LEAD + 1`` strings of ``LEAD`` bytes.
LENGTH, LEAD = 200, 100
_ROOM = LENGTH - LEAD
#: Rows of small tables that are broadcast, ``_PER_ROW`` numbers of an array counting as one more;
#: larger tables are joined by shuffle.
BROADCAST_ROWS = 500_000
_PER_ROW = 32
#: Suffixes of a bucket that are compared in one task; larger buckets are compared by shuffle.
BUCKET = 50_000
#: Bytes read at a time, and contexts compared at a time.
_WINDOW, _ROWS = 1 << 16, 4096


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of ``width`` values from each place on, by doubling."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which suffixes stand for the others: number of the text, start, and hash of the lead.

    In each string of ``LENGTH`` bytes the leads with the smallest hash are chosen, so two equal
    strings hold chosen suffixes at the same places. About one suffix in fifty is. What decides on
    a lead is less than ``LENGTH`` bytes away, so the texts are read in windows with that margin.
    """
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, none)]
    if len(sizes) and sizes.max() >= LENGTH:
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ends = np.cumsum(sizes)
        for low in range(0, len(data) - LEAD + 1, _WINDOW):
            found.append(_anchors_between(data, ends, sizes, low, low + _WINDOW))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors_between(
    data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, low: int, high: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``anchors`` that start from ``low`` on and before ``high``."""
    first = max(0, low - _ROOM)
    part = data[first : high + LENGTH]
    n = len(part) - LEAD + 1
    lead = Rolling(part).ranges(slice(0, n), slice(LEAD, LEAD + n))
    place = np.arange(first, first + n)
    doc = np.searchsorted(ends, place, side="right")
    left = ends[doc] - place  # bytes up to the end of the text
    if n <= _ROOM:
        least = np.zeros(0, dtype=np.uint64)
    else:
        least = _sliding(lead, _ROOM + 1, np.minimum)
        least[left[: len(least)] < LENGTH] = 0  # no string of that length starts here
    # a lead is chosen if it is the smallest of a string that starts up to _ROOM bytes before it
    padded = np.concatenate([np.zeros(_ROOM, dtype=np.uint64), least, np.zeros(n - len(least), dtype=np.uint64)])
    reached = _sliding(padded, _ROOM + 1, np.maximum)[:n]
    inside = (place >= low) & (place < high)
    at = np.flatnonzero((reached == lead) & (left >= LEAD) & inside)
    return doc[at], place[at] - (ends - sizes)[doc[at]], lead[at].astype(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _chosen(texts: DataFrame) -> DataFrame:
    """(_t1, _t2, _leads, _places) of each row of (_t1, _t2, _bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, _ROWS):
            n = batch.num_rows
            doc, at, lead = anchors(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], _lists(lead, doc, n, pa.int64()), _lists(at, doc, n, pa.int32())],
                names=["_t1", "_t2", "_leads", "_places"],
            )

    return texts.mapInArrow(run, "_t1 long, _t2 long, _leads array<long>, _places array<int>")


def _context_hashes(raws: list[bytes], wanted: list[list[int]]) -> tuple[np.ndarray, ...]:
    """For each chosen suffix: number of the text, start, hash of the lead, hash of its context (up
    to ``_ROOM`` bytes before and ``LENGTH`` from its start), and how many bytes stand before and
    from its start on there."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    doc = np.repeat(np.arange(len(raws)), [len(w) for w in wanted])
    at = np.concatenate([np.zeros(0, dtype=np.int64), *(np.sort(w) for w in wanted)]).astype(np.int64)
    here = (np.cumsum(sizes) - sizes)[doc] + at
    before = np.minimum(at, _ROOM)
    after = np.minimum(sizes[doc] - at, LENGTH)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    lead, context = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    edges = np.searchsorted(here, np.arange(0, len(data) + _WINDOW, _WINDOW))
    for a, b in zip(edges[:-1], edges[1:]):
        if a == b:
            continue
        first = max(0, here[a] - _ROOM)
        rolling = Rolling(data[first : here[b - 1] + LENGTH])
        own = here[a:b] - first
        lead[a:b] = rolling.ranges(own, own + LEAD)
        context[a:b] = mixed(rolling.ranges(own - before[a:b], own + after[a:b]) + before[a:b].astype(np.uint64))
    return doc, at, lead.astype(np.int64), context.astype(np.int64), before, after


def _members(texts: DataFrame) -> DataFrame:
    """(_t1, _t2, _at, _lead, _context, _low, _high) of each suffix of (_t1, _t2, _bytes, _wanted).

    A string of ``LENGTH`` bytes that starts d bytes before the suffix lies in the text, and so in
    the context, for d from ``_low`` to ``_high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, _ROWS):
            raws, wanted = batch.column(2).to_pylist(), [w.values.to_numpy() for w in batch.column(3)]
            doc, at, lead, context, before, after = _context_hashes(raws, wanted)
            owner = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at, pa.int32()), pa.array(lead),
                 pa.array(context), pa.array(LENGTH - after, pa.int32()), pa.array(before, pa.int32())],
                names=["_t1", "_t2", "_at", "_lead", "_context", "_low", "_high"],
            )

    return texts.mapInArrow(
        run, "_t1 long, _t2 long, _at int, _lead long, _context long, _low int, _high int"
    )


def _contexts(texts: DataFrame) -> DataFrame:
    """(_lead, _context, _before, _suffix): the bytes of each suffix of (.., _bytes, _wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, _ROWS):
            raws, wanted = batch.column(2).to_pylist(), [w.values.to_numpy() for w in batch.column(3)]
            doc, at, lead, context, _, _ = _context_hashes(raws, wanted)
            for low in range(0, len(at), _ROWS):
                some = slice(low, low + _ROWS)
                places = list(zip(doc[some].tolist(), at[some].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead[some]), pa.array(context[some]),
                     pa.array([raws[i][max(0, p - _ROOM) : p] for i, p in places], pa.binary()),
                     pa.array([raws[i][p : p + LENGTH] for i, p in places], pa.binary())],
                    names=["_lead", "_context", "_before", "_suffix"],
                )

    return texts.mapInArrow(run, "_lead long, _context long, _before binary, _suffix binary")


def _window_hashes(befores: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """For each suffix and shift d from 0 to ``_ROOM`` the hash of the ``LENGTH`` bytes that start
    d bytes before it; 0 where they reach over the text."""
    n = len(befores)
    table = np.zeros((n, _ROOM + LENGTH), dtype=np.uint8)
    for row, before, suffix in zip(table, befores, suffixes):
        row[_ROOM - len(before) : _ROOM] = np.frombuffer(before, dtype=np.uint8)
        row[_ROOM : _ROOM + len(suffix)] = np.frombuffer(suffix, dtype=np.uint8)
    start = _ROOM - np.arange(_ROOM + 1)
    out = Rolling(table).ranges(start, start + LENGTH)
    room = np.array([len(b) for b in befores])[:, None], np.array([len(s) for s in suffixes])[:, None]
    shift = np.arange(_ROOM + 1)[None, :]
    out[(shift > room[0]) | (LENGTH - shift > room[1])] = 0
    return out


def _runs(flags: np.ndarray) -> list[list[int]]:
    """For each row the first and last number of every run of flags, one after the other."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    out: list[list[int]] = [[] for _ in flags]
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist()):
        out[r] += [a, b]
    return out


def _compare(bucket: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which strings two contexts of a bucket share: for each shift the strings are sorted within
    their bucket; equal neighbours repeat."""
    flags = np.zeros(hashes.shape, dtype=bool)
    for d in range(hashes.shape[1]):
        key = mixed(hashes[:, d] + bucket)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        flags[order[1:][same], d] = True
        flags[order[:-1][same], d] = True
    return flags & (hashes != 0)


def _hashed(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The strings of all contexts, some rows at a time."""
    parts = [rows.slice(low, _ROWS) for low in range(0, rows.num_rows, _ROWS)]
    found = [_window_hashes(p["_before"].to_pylist(), p["_suffix"].to_pylist()) for p in parts]
    return np.concatenate(found) if found else np.zeros((0, _ROOM + 1), dtype=np.uint64)


def _repeated(contexts: DataFrame) -> DataFrame:
    """(_lead, _context, _runs) of contexts in sorted ranges; buckets are compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            flags = _compare(rows["_lead"].to_numpy().astype(np.uint64), _hashed(rows))
            return pa.RecordBatch.from_arrays(
                [rows["_lead"].combine_chunks(), rows["_context"].combine_chunks(), pa.array(_runs(flags), pa.list_(pa.int32()))],
                names=["_lead", "_context", "_runs"],
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            leads = held["_lead"].to_numpy()
            if len(leads) >= 2 * _ROWS and leads[0] != leads[-1]:
                cut = int(np.flatnonzero(leads != leads[-1])[-1]) + 1
                yield done(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield done(held.combine_chunks())

    ordered = contexts.repartitionByRange("_lead").sortWithinPartitions("_lead")
    return ordered.mapInArrow(run, "_lead long, _context long, _runs array<int>")


def _repeated_hot(contexts: DataFrame) -> DataFrame:
    """The same for buckets of any size: every string is a row, counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                hashes = _hashed(part)
                row, shift = np.nonzero(hashes)
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].take(pa.array(row)) for c in ("_lead", "_context")), pa.array(shift, pa.int32()),
                     pa.array(hashes[row, shift].astype(np.int64))],
                    names=["_lead", "_context", "_d", "_string"],
                )

    strings = contexts.mapInArrow(run, "_lead long, _context long, _d int, _string long")
    counts = strings.groupBy("_lead", "_d", "_string").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = strings.join(counts, ["_lead", "_d", "_string"]).groupBy("_lead", "_context").agg(F.collect_set("_d").alias("_ds"))
    pairs = F.flatten(F.transform("_ds", lambda d: F.array(d, d)))
    return found.select("_lead", "_context", pairs.alias("_runs"))


def _merged_spans(spans: DataFrame) -> DataFrame:
    """(_t1, _t2, _edges): the spans of a text joined where they touch, as start, end, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, end in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                edges: list[int] = []
                for a, b in sorted(zip(start, end)):
                    if edges and a <= edges[-1]:
                        edges[-1] = max(b, edges[-1])
                    else:
                        edges += [a, b]
                out.append(edges)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=["_t1", "_t2", "_edges"]
            )

    return spans.mapInArrow(run, "_t1 long, _t2 long, _edges array<int>")


def _attached(rows: DataFrame, table: DataFrame, how: str, places: str | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (_k1, _k2, ...) on the text; broadcast only if it is small,
    the numbers in its array ``places`` counted in."""
    weight = F.lit(1) if places is None else F.size(places) / F.lit(_PER_ROW) + 1
    small = (table.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS
    on = (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2"))
    return rows.join(F.broadcast(table) if small else table, on, how).drop("_k1", "_k2")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"_t1": "_k1", "_t2": "_k2"})


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(_t1, _t2, _bytes, _wanted) of the texts that ``places`` names."""
    found = _attached(rows.select("_t1", "_t2", "_bytes"), _keyed(places), "inner", "_wanted")
    return found.select("_t1", "_t2", "_bytes", "_wanted")


def remove_repeats(
    docs: DataFrame, text: str = "text", bucket: int = BUCKET, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, unless named) with ``n_bytes``, ``spans`` (removed runs, start and end in bytes) and ``kept`` (the
    other bytes, joined).

    Every whole text is a string of UTF-8 bytes, NULL being empty. A byte goes if a string of 200
    bytes covers it that also starts anywhere else, in this or another text; overlaps count, no
    match crosses texts, and the input is judged, not what is left of it. So equal texts of 200
    bytes or more all go whole, shorter texts stay, repeated rows are texts of their own, and an
    empty table gives no rows. Columns of the added names are replaced, others kept.

    Suffixes are sorted sparsely: ``anchors`` picks those whose lead (first 100 bytes) any repeated
    string must share. Leads found once are dropped by count. The context of a suffix (the 100
    bytes before it and 200 from its start) repeats whole if it is found twice. Different contexts
    of one lead are range-partitioned by it with Spark's sampled splitters and sorted; a lead lies
    in one range, so no bucket crosses a boundary. Within a bucket the strings at each shift are
    sorted and equal neighbours marked; buckets above ``bucket`` are compared by shuffle. Only
    these contexts travel as bytes, once each. Strings are compared by 64-bit hashes in a bucket.
    Equal texts are found by 128-bit digests first, and only one of them takes part.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"n_bytes", "spans", "kept"}]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), value.cast("binary").alias("_bytes"),
        F.xxhash64(value).alias("_t1"), F.xxhash64(F.lit(1), value).alias("_t2"),
    )
    long_rows = rows.filter(F.octet_length("_bytes") >= LENGTH)
    copies = materialize(
        long_rows.groupBy("_t1", "_t2").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    )
    single = _attached(long_rows, _keyed(copies), "left")
    once = single.filter("_copies is null").select("_t1", "_t2", "_bytes")
    again = materialize(
        single.filter("_copies is not null").groupBy("_t1", "_t2").agg(F.first("_bytes").alias("_bytes"))
    )
    texts = once.unionByName(again)
    chosen = materialize(_chosen(texts))
    leads = chosen.select(F.explode("_leads").alias("_lead")).groupBy("_lead").agg(F.count(F.lit(1)).alias("_m"))
    leads = materialize(leads.filter("_m > 1"))
    wanted = chosen.select("_t1", "_t2", F.inline(F.arrays_zip(F.col("_leads").alias("_lead"), F.col("_places").alias("_at"))))
    wanted = materialize(
        wanted.join(leads.select("_lead"), "_lead").groupBy("_t1", "_t2").agg(F.collect_list("_at").alias("_wanted"))
    )
    members = materialize(_attached(_members(with_places(texts, wanted)), _keyed(copies), "left"))
    contexts = materialize(
        members.groupBy("_lead", "_context").agg(
            F.sum(F.coalesce("_copies", F.lit(1))).alias("_copies"), F.min(F.struct("_t1", "_t2", "_at")).alias("_one"),
            F.first("_low").alias("_low"), F.first("_high").alias("_high"),
        )
    )
    # a context found twice repeats whole; one found once must share strings with others of its lead
    sizes = contexts.groupBy("_lead").agg(F.count(F.lit(1)).alias("_m"), F.min("_copies").alias("_least"))
    open_leads = sizes.filter("_m > 1 and _least = 1").select("_lead", (F.col("_m") > bucket).alias("_hot"))
    compared = materialize(contexts.join(open_leads, "_lead"))
    places = compared.groupBy(F.col("_one._t1").alias("_t1"), F.col("_one._t2").alias("_t2")).agg(
        F.collect_list("_one._at").alias("_wanted")
    )
    bytes_of = materialize(_contexts(with_places(texts, materialize(places))).dropDuplicates(["_lead", "_context"]))
    hot = compared.filter("_hot").select("_lead", "_context")
    marked = _repeated(bytes_of.join(hot, ["_lead", "_context"], "left_anti"))
    if not hot.isEmpty():
        marked = marked.unionByName(_repeated_hot(bytes_of.join(hot, ["_lead", "_context"], "left_semi")))
    twice = contexts.filter(F.col("_copies") > 1).select("_lead", "_context", F.array("_low", "_high").alias("_runs"))
    single = contexts.filter(F.col("_copies") == 1).select("_lead", "_context")
    marked = marked.filter(F.size("_runs") > 0).join(single, ["_lead", "_context"], "left_semi").unionByName(twice)
    # texts with copies go whole
    spans = members.filter("_copies is null").select("_t1", "_t2", "_at", "_lead", "_context").join(marked, ["_lead", "_context"])
    half = F.sequence(F.lit(0), (F.size("_runs") / 2).cast("int") - 1)
    starts = F.transform(half, lambda k: F.col("_at") - F.get("_runs", 2 * k + 1))
    ends = F.transform(half, lambda k: F.col("_at") - F.get("_runs", 2 * k) + LENGTH)
    spans = spans.groupBy("_t1", "_t2").agg(
        F.flatten(F.collect_list(starts)).alias("_starts"), F.flatten(F.collect_list(ends)).alias("_ends")
    )
    spans = materialize(_merged_spans(spans))
    whole = copies.select("_t1", "_t2", F.lit(True).alias("_whole"))
    ready = _attached(_attached(rows, _keyed(whole), "left"), _keyed(spans), "left", "_edges")
    schema = T.StructType([
        rows.schema["_row"], T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ])
    ready = ready.select("_row", "_bytes", "_whole", "_edges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sizes, spans, left = [], [], []
            for raw, whole, found in zip(*(batch.column(k).to_pylist() for k in range(1, 4))):
                found = [0, len(raw)] if whole else found or []
                merged = list(zip(found[::2], found[1::2]))
                edges = [0, *(x for m in merged for x in m), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in merged])
                left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(left, pa.binary())], names=["_row", "n_bytes", "spans", "kept"],
            )

    return ready.mapInArrow(cut, schema).select("_row.*", "n_bytes", "spans", "kept")
