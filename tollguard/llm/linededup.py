"""Line de-duplication: exact copies, and lines one edit away by a segment-partition join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollguard.session import materialize

#: Characters that do not count at the ends of a line.
BLANK = " \t\r\f\v"
#: A line is compared in ``EDITS`` + 1 segments.
EDITS = 1
#: Candidates of a bucket that are compared pair by pair; larger buckets are split first.
BUCKET = 32
#: Documents with candidate lines that are broadcast; more are joined by shuffle.
BROADCAST_DOCS = 500_000
#: Halvings by equal ends before the bits are run.
HALVINGS = 6
#: Rows of a bucket that one task compares with the others where more than one edit counts.
BLOCK = 1024


def _left(s: Column, n: Column) -> Column:
    return F.substr(s, F.lit(1), n)


def _right(s: Column, n: Column) -> Column:
    return F.substr(s, F.length(s) - n + 1, n)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once per use."""
    return F.get(F.transform(F.array(value), body), 0)


def bit_parallel_within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is ``edits`` at most.

    One bit mask for each number of errors holds the diagonals of the band (2 * ``edits`` + 1 bits)
    that can be reached; a character of ``a`` moves all of them at once.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    chars_b = F.transform(F.sequence(F.lit(1), F.length(b) + 1), lambda i: F.substr(b, i, F.lit(1)))
    names = [f"e{e}" for e in range(edits + 1)]

    def spread(masks: list[Column]) -> list[Column]:
        out = masks[:1]
        for m in masks[1:]:
            out.append(m.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return out

    def packed(masks: list[Column]) -> Column:
        return F.struct(*[m.cast("int").alias(n) for m, n in zip(masks, names)])

    def step(state: Column, i: Column) -> Column:
        char = F.substr(a, i, F.lit(1))
        equal = reduce(
            Column.bitwiseOR,
            [
                F.when(F.get(chars_b, i + F.lit(t - edits - 1)) == char, F.lit(1 << t)).otherwise(F.lit(0))
                for t in range(width)
            ],
        )
        masks = [state[n].bitwiseAND(equal) for n in names]
        moved = masks[:1] + [
            m.bitwiseOR(state[p]).bitwiseOR(F.shiftright(state[p], 1)) for m, p in zip(masks[1:], names)
        ]
        return packed(spread(moved))

    start = packed(spread([F.lit(1 << edits)] + [F.lit(0)] * edits))
    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(rows, start, step)
    diagonal = F.length(b) - F.length(a) + edits
    target = F.get(F.array(*[F.lit(1 << t) for t in range(width)]), diagonal)  # NULL outside the band
    return _let(end, lambda e: reduce(Column.bitwiseOR, [e[n] for n in names]).bitwiseAND(target) > 0)


def keep_within_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of ``pairs`` whose strings are one edit apart at most.

    Strings one edit apart agree in the first or in the last half of the shorter one. Equal halves
    are cut off again and again, which does not change the distance, and pairs without one are
    out; the bits then run over the few characters left.
    """
    def trim(state: Column) -> Column:
        x, y = state["a"], state["b"]
        shorter = F.least(F.length(x), F.length(y))
        front = _half(shorter)
        back = shorter - front
        cut = F.when(_left(x, front) == _left(y, front), front).when(_right(x, back) == _right(y, back), -back)

        def without(s: Column, n: Column) -> Column:
            return F.when(n >= 0, F.substr(s, n + 1, F.length(s))).otherwise(_left(s, F.length(s) + n))

        return _let(cut, lambda n: F.struct(without(x, n).alias("a"), without(y, n).alias("b")))

    start = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(HALVINGS))
    left = F.aggregate(rounds, start, lambda state, _: trim(state))
    return pairs.filter(
        _let(left, lambda s: s["a"].isNotNull() & bit_parallel_within(s["a"], s["b"], EDITS))
    )


def _segment_keys(line: Column, n: Column, edits: Sequence[int]) -> Column:
    """The index of a line for ``edits``: structs of _key, _k (edits) and _long (0 for its own segments).

    A line of length n stands under its k + 1 segments, and probes for lines of lengths n - k to n
    under theirs, at every place the segment can have moved to: with i segments before it and k - i
    behind, one is whole that i edits before and k - i behind it explain.
    """
    keys = []
    for k, least in enumerate(edits, 1):
        for d in range(k + 1):
            base = n - d
            inside = (base >= least) & (base < edits[k] if k < len(edits) else F.lit(True))
            for i in range(k + 1):
                start, end = (F.floor(base * j / (k + 1)).cast("int") for j in (i, i + 1))
                for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                    key = F.xxhash64(F.lit(k), F.lit(i), base, F.substr(line, start + shift + 1, end - start))
                    probe = F.struct(key.alias("_key"), F.lit(k).alias("_k"), F.lit(int(d > 0 or shift != 0)).alias("_long"))
                    keys.append(F.when(inside, probe))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _occurrences(docs: DataFrame, min_chars: int, edits: Sequence[int]) -> DataFrame:
    """Each line of ``min_chars`` or more: its place, its hash, and the hashes of the index.

    For one edit these are four: a line of length n stands under its two segments, and probes for
    lines of length n - 1 under the segments those have.
    """
    lines = docs.select("_id", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("_no", "_raw"))
    lines = lines.withColumn("_line", F.btrim("_raw", F.lit(BLANK))).withColumn("_n", F.length("_line"))
    lines = lines.filter(F.col("_n") >= min_chars)
    line, keys = F.col("_line"), []
    if edits != (0,):
        keys.append(_segment_keys(line, F.col("_n"), edits).alias("_keys"))
    for longer in (0, 1) if edits == (0,) else ():
        base = F.col("_n") - longer
        front = _half(base)
        for side, part in (("p", _left(line, front)), ("s", _right(line, base - front))):
            keys.append(F.xxhash64(F.lit(side), base, part).alias(f"_{side}{longer}"))
    return lines.select(
        F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"),
        F.struct("_id", "_text_hash", "_no").alias("_first"), *keys,
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two lines or more, one of them not a mere probe, with ``_size``."""
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), F.min("_long").alias("_least"))
    return rows.join(sizes.filter("_size > 1 and _least = 0").drop("_least"), "_key")


def _texts(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each of ``lines`` (_h1, _h2, _first), read at its first place."""
    places = lines.groupBy(F.col("_first._id").alias("_id"), F.col("_first._text_hash").alias("_text_hash")).agg(
        F.collect_list(F.struct("_h1", "_h2", "_first._no")).alias("_wanted")
    )
    places = materialize(places)
    small = places.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    places = F.broadcast(places) if small else places
    here = docs.alias("d").join(
        places.alias("p"),
        F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._text_hash") == F.col("p._text_hash")),
    )
    found = here.select(F.split("_text", "\n").alias("_all"), F.explode("_wanted").alias("_w"))
    text = F.btrim(F.get("_all", F.col("_w._no")), F.lit(BLANK))
    return found.select("_w._h1", "_w._h2", text.alias("_line")).dropDuplicates(["_h1", "_h2"])


def _one_edit_later(lines: DataFrame, docs: DataFrame, bucket: int) -> DataFrame:
    """The (_h1, _h2) of lines that are one edit away from a line with an earlier first place."""
    sides = [
        F.struct(F.col(f"_{s}{n}").alias("_key"), F.lit(s).alias("_side"), F.lit(n).alias("_long"))
        for n in (0, 1) for s in "ps"
    ]
    keys = lines.select("_h1", "_h2", "_first", F.inline(F.array(*sides)))
    rows = materialize(_shared(keys).drop("_size"))
    texts = _texts(rows.select("_h1", "_h2", "_first").distinct(), docs)
    base = F.length("_line") - F.col("_long")
    front = _half(base)
    rest = F.when(F.col("_side") == "p", F.substr("_line", front + 1, F.length("_line"))).otherwise(
        _left(F.col("_line"), F.length("_line") - (base - front))
    )
    rows = rows.join(texts, ["_h1", "_h2"]).select("_key", "_long", "_h1", "_h2", "_first", rest.alias("_rest"))
    found = []
    while True:
        rows = materialize(_shared(rows))
        base = F.length("_rest") - F.col("_long")
        hot = (F.col("_size") > bucket) & (base > 1)
        plain = rows.filter(~hot)
        earlier = plain.select(
            "_key", F.col("_long").alias("_long_a"), F.col("_first").alias("_first_a"), F.col("_rest").alias("_rest_a")
        )
        pairs = plain.join(earlier, "_key").filter(
            (F.col("_first_a") < F.col("_first")) & (F.col("_long") + F.col("_long_a") < 2)
        )
        found.append(keep_within_one(pairs, "_rest_a", "_rest").select("_h1", "_h2"))
        rows = rows.filter(hot)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        front = _half(base)
        cuts = F.array(
            F.struct(
                F.xxhash64("_key", F.lit("p"), _left(F.col("_rest"), front)).alias("_k"),
                F.substr("_rest", front + 1, F.length("_rest")).alias("_r"),
            ),
            F.struct(
                F.xxhash64("_key", F.lit("s"), _right(F.col("_rest"), base - front)).alias("_k"),
                _left(F.col("_rest"), F.length("_rest") - (base - front)).alias("_r"),
            ),
        )
        rows = rows.select("_long", "_h1", "_h2", "_first", F.inline(cuts)).withColumnsRenamed(
            {"_k": "_key", "_r": "_rest"}
        )


def _edits_later(lines: DataFrame, docs: DataFrame, edits: Sequence[int], block: int) -> DataFrame:
    """The (_h1, _h2) of lines that are as near as ``edits`` allows to one with an earlier first place."""
    keys = lines.select("_h1", "_h2", "_first", F.inline("_keys"))
    rows = materialize(_shared(keys))
    texts = _texts(rows.select("_h1", "_h2", "_first").distinct(), docs)
    rows = rows.join(texts, ["_h1", "_h2"])
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    later = rows.withColumn("_block", F.pmod(F.xxhash64("_h1", "_h2"), blocks).cast("int"))
    earlier = rows.select(
        "_key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), F.col("_long").alias("_long_a"),
        F.col("_first").alias("_first_a"), F.col("_line").alias("_line_a"), F.col("_k").alias("_k_a"),
    )
    pairs = later.join(earlier, ["_key", "_block"]).filter(
        (F.col("_first_a") < F.col("_first")) & (F.col("_long") + F.col("_long_a") < 2) & (F.col("_k") == F.col("_k_a"))
    )
    near = F.lit(False)
    for k in range(1, len(edits) + 1):  # -1 if the distance, counted over the band, is above k
        near = F.when(F.col("_k") == k, F.levenshtein("_line_a", "_line", k) >= 0).otherwise(near)
    return pairs.filter(near).select("_h1", "_h2").distinct()


def dedupe_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20,
    bucket: int = BUCKET, n_lines: str | None = None, n_removed: str | None = None,
    edits: Sequence[int] = (0,), block: int = BLOCK, short_copies: bool = True,
) -> DataFrame:
    """``docs`` with the lines removed that an earlier line repeats, exactly or but for a few edits.

    Lines are the ``\\n``-parts of the text, compared without blanks at their ends, by code points.
    Lines shorter than ``min_chars`` are no evidence of copying and stay; with ``short_copies=False``
    only the first of those that are equal and not blank stays in each document. Earlier means: in
    the order of (document id, NULL first; hash of the text; line number). A line goes if any
    earlier line, itself kept or not, is equal or k insertions, deletions or substitutions away at
    most. ``edits`` gives k by the length of the shorter line: its j-th number is the least length
    at which j edits count, so (0,) is one edit at any length and (0, 40, 80) two from 40 and three
    from 80 characters; numbers ascend, and lines shorter than the first need to be equal.
    Documents stay even if all of their lines go (empty text); NULL and empty texts stay as they
    are. Rows with equal id and text count as one document and come out alike. An empty table
    gives no rows. ``n_lines`` and ``n_removed`` name columns to add with these counts.

    Each line stands under hashes of its two segments and of those that a line one shorter would
    have (length-aware probes), so any two lines one edit apart share a bucket. Equal lines are
    combined before; buckets beyond ``bucket`` are split again by the halves of what is left, until
    they are small or one character is left, so no bucket emits all its pairs. What is kept goes
    to the documents as lists of line numbers. Only built-in functions run.

    For more than one edit a line stands under k + 1 segments and probes for lengths n - k to n.
    Halves do not split such buckets; they are compared ``block`` rows a task with all their rows,
    so their cost grows with the square of the bucket.
    """
    edits = tuple(edits)
    if not edits or list(edits) != sorted(edits) or len(edits) > 15:
        raise ValueError(f"one to fifteen ascending lengths expected, not {edits}")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(
        own, F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"),
        F.xxhash64(F.col(f"`{text}`")).alias("_text_hash"),
    )
    found = _occurrences(rows, min_chars, edits)
    hashes = [c for c in found.columns if c not in {"_h1", "_h2", "_first"}]
    lines = materialize(
        found.groupBy("_h1", "_h2").agg(F.min("_first").alias("_first"), *[F.min(c).alias(c) for c in hashes])
    )
    gone = _one_edit_later(lines, rows, bucket) if edits == (0,) else _edits_later(lines, rows, edits, block)
    kept = (
        lines.select("_h1", "_h2", "_first").join(gone, ["_h1", "_h2"], "left_anti")
        .groupBy(F.col("_first._id").alias("_kid"), F.col("_first._text_hash").alias("_kept_hash"))
        .agg(F.collect_list("_first._no").alias("_kept"))
    )
    joined = rows.join(
        kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_text_hash") == F.col("_kept_hash")), "left"
    )
    parts = F.split("_text", "\n")
    short = F.filter(
        F.transform(parts, lambda s, i: F.when(F.length(F.btrim(s, F.lit(BLANK))) < min_chars, i)), lambda i: i.isNotNull()
    )
    if not short_copies:
        # sorted, so the first of equal lines is the one after a different line
        lines_at = F.array_sort(F.transform(
            short, lambda i: F.struct(F.btrim(F.get(parts, i), F.lit(BLANK)).alias("line"), i.alias("no"))
        ))
        short = _let(lines_at, lambda all_: F.transform(
            F.filter(all_, lambda s, j: (s["line"] == "") | (j == 0) | (F.get(all_, j - 1)["line"] != s["line"])),
            lambda s: s["no"],
        ))
    stay = F.concat(short, F.coalesce("_kept", F.array().cast("array<int>")))
    joined = joined.withColumn("_parts", parts).withColumn("_stay", stay)
    rebuilt = F.array_join(F.transform(F.array_sort("_stay"), lambda i: F.get("_parts", i)), "\n")
    whole = F.col("_text").isNull() | (F.size("_stay") == F.size("_parts"))
    columns = [
        F.when(whole, F.col("_text")).otherwise(rebuilt).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns if c not in {n_lines, n_removed}
    ]
    counts = [(n_lines, F.size("_parts")), (n_removed, F.size("_parts") - F.size("_stay"))]
    none = F.when(F.col("_text").isNull(), F.lit(0))
    columns += [none.otherwise(v).cast("long").alias(name) for name, v in counts if name]
    return joined.select(*columns)
