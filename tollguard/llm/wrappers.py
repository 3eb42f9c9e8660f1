"""Main text of web pages by wrappers that are inferred from the pages of each host, with words as a prior."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollguard.session import materialize

#: Elements that never have content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas object".split())
#: Elements that start a block of text.
BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr "
    "select option menu dialog hgroup search".split()
)
#: Elements, class or id words and roles of what is not the article.
ASIDE = frozenset("nav header footer aside head select button dialog menu search".split()) | RAW
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup "
    "popup modal overlay widget widgets toolbar pagination pager".split()
)
#: Words beside these in a class or id that do not make it another thing: ``related-links`` is beside
#: the article, ``social-story`` and ``notice-of-motion`` are not.
FILLER_WORDS = frozenset(
    "area articles bar block body bottom box button buttons center col column container content desktop fixed float form "
    "global group head header hidden icon icons inner item items js large last left link links list main media mobile "
    "module outer page panel posts primary right row secondary section site slot small sticky stories text title top "
    "unit wrap wrapper zone".split()
)
#: Words that mark reader comments, however much text they hold.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Of these, words that also name the layout around an article: an article within ends them.
LAYOUT_WORDS = frozenset("sidebar menu nav navbar navigation banner masthead footer alert notice notices widget widgets overlay".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: A paragraph ends where one of these starts; list items and cells end where their like starts.
_ENDS_P = BLOCK - frozenset("html head body option".split())
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
_TOKEN = re.compile(
    # a quote that nothing closes is a character like others
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|[\"'])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: How an element stands to the article: layout that may be around it, by a part of a class (which tells
#: nothing within an article) or by all of it; beside it by words; by element or role.
PART, LAYOUT, WORDS, COMMENTS, HARD = 1, 2, 3, 4, 5
#: Elements below this depth count as content of the one there when structures are aligned.
DEEPEST = 100
#: Distinct page structures that one task aligns.
ALIGNED = 256
#: Pages of ten that a slot stands on, of those that can have it, to be fixed.
FIXED_TENTHS = 8


@lru_cache(maxsize=4096)
def _described(name: str, attributes: str) -> tuple[str, int]:
    """The element as a step of a path (name and class words), and how it stands to the article: not
    beside it (0), or one of ``PART`` (all but an article in it is beside: ``<div class="with-sidebar">``),
    ``LAYOUT`` (the same, and in an article too: forms, ``<div class="sidebar">``), ``WORDS``, ``COMMENTS``
    and ``HARD``."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    tokens = [[w for w in re.split(r"[^a-z]+", t) if w] for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
    words = {w for token in tokens for w in token}
    known = ASIDE_WORDS | FILLER_WORDS
    telling = {w for token in tokens if known.issuperset(token) for w in token} & ASIDE_WORDS
    beside = 0
    if name in ("html", "body"):
        pass
    elif name in ASIDE or found.get("role") in ASIDE_ROLES:
        beside = HARD
    elif telling - LAYOUT_WORDS:
        beside = WORDS if COMMENT_WORDS.isdisjoint(telling) else COMMENTS
    elif telling or name == "form":
        beside = LAYOUT
    elif name in BLOCK and not LAYOUT_WORDS.isdisjoint(words):
        beside = PART
    if found.get("role") == "main":
        words.add("main")
    return ".".join([name, *sorted(words)]), beside


def events(page: str) -> Iterator[tuple[str, str, str, int]]:
    """What a browser would read as (kind, name, step or text, beside), every open element closed.

    Kinds are open, close, text and break. Comments, declarations and the content of scripts,
    styles and the like are left out; end tags without a start tag are ignored; elements that a
    start tag or an outer end tag implies to end are closed. Open elements are found by name, so the
    time does not grow with the depth.
    """
    stack: list[tuple[str, str, int]] = []
    places: dict[str, list[int]] = {}
    at = 0

    def innermost(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(upto: int) -> Iterator[tuple[str, str, str, int]]:
        while len(stack) > upto:
            places[stack[-1][0]].pop()
            yield ("close", *stack.pop())

    while at < len(page):
        found = _TOKEN.search(page, at)
        start = found.start() if found else len(page)
        if start > at:
            yield "text", "", page[at:start], 0
        if not found:
            break
        at = found.end()
        ending, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if ending:
            if places.get(name):
                yield from close(places[name][-1])
            continue
        if found.group().endswith("/>") and name not in BLOCK and name not in RAW or name in VOID:
            if name in ("br", "hr"):
                yield "break", name, "", 0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _ENDS_P and places.get("p"):
            yield from close(places["p"][-1])
        if name in _LIKE:
            like = innermost(_LIKE[name])
            if like > innermost(_SCOPE[name]):
                yield from close(like)
        step, beside = _described(name, attributes.rstrip("/"))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, step, beside))
        yield "open", name, step, beside
    yield from close(0)


@dataclass(slots=True)
class _Element:
    """An element with blocks of text. ``items`` are the places of its elements and, as ``~place``, of its blocks."""

    step: str
    parent: int
    name: str
    mark: int
    kind: str
    n_chars: int = 0
    beside: bool = False
    #: Whether something beside the article stands on the way: at all, since the article or main element.
    ways: tuple[bool, bool, bool] = (False, False, False)
    items: list[int] = field(default_factory=list)


def _digest(*parts: str | int) -> int:
    raw = hashlib.blake2b("\0".join(map(str, parts)).encode(errors="surrogatepass"), digest_size=8)
    return int.from_bytes(raw.digest(), "big", signed=True)


def _read_page(page: str) -> tuple[list[_Element], list[tuple[int, str]]]:
    """The elements in page order, the first one standing for the page, and the blocks of text as (place
    of the element, decoded text)."""
    elements = [_Element("", 0, "", 0, "")]
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    here = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            elements[here].items.append(~len(blocks))
            blocks.append((here, text))
            elements[here].n_chars += len(text)
        pieces.clear()

    for kind, name, value, beside in events(page):
        if kind == "text":
            pieces.append(value)
        elif kind == "break":
            if name == "hr":
                flush()
            pieces.append("\n")
        elif name in BLOCK or beside:
            flush()
            if kind == "close":
                here = elements[here].parent
                continue
            around = elements[here]
            words = value.split(".")[1:]
            if name == "header" and around.kind == "article" and ASIDE_WORDS.isdisjoint(words):
                beside = 0  # the header of an article holds its title
            if beside == PART and around.kind:
                beside = 0
            root = "article" if "article" in (name, around.kind) else "main" if name == "main" or "main" in words else around.kind
            around.items.append(len(elements))
            elements.append(_Element(value, here, name, beside, root))
            here = len(elements) - 1
    flush()
    return elements, blocks


def _mark(elements: list[_Element]) -> None:
    """Tell what lies beside the article: in something marked by words, element or role, or in layout
    that no article within ends."""
    for e in elements[1:]:
        around = elements[e.parent]
        strong = around.ways[0] or e.mark >= WORDS
        same = around.ways[1] if around.kind == e.kind else False
        any_mark = around.ways[2] or e.mark > 0
        e.ways = strong, same or e.mark > 0, any_mark
        e.beside = strong or (e.ways[1] if e.kind else any_mark)


def slots(page: str) -> tuple[list[_Element], list[tuple[int, str]]]:
    """The elements and the blocks of text of a page, with what lies beside the article told.

    Words of classes and ids, and forms, are no proof: where no article or main element is left with
    text, those that hold the larger part of the page's text do not count, but for reader comments.
    """
    elements, blocks = _read_page(page)
    _mark(elements)
    if not any(elements[i].kind and not elements[i].beside for i, _ in blocks):
        held = [e.n_chars for e in elements]
        for i in range(len(elements) - 1, 0, -1):
            if elements[i].mark == HARD:
                held[i] = 0
            held[elements[i].parent] += held[i]
        doubtful = [e for e, n in zip(elements, held) if e.mark in (PART, LAYOUT, WORDS) and 2 * n > held[0]]
        if doubtful:
            for e in doubtful:
                e.mark = 0
            _mark(elements)
    return elements, blocks


#: A node of a page: its step, the places of its blocks and its nodes; ``#`` is a text slot.
Node = tuple[str, list, list]


def _below(elements: list[_Element], place: int) -> list[int]:
    """The blocks of an element and all within it, in page order."""
    found, left = [], [place]
    while left:
        place = left.pop()
        if place < 0:
            found.append(~place)
        else:
            left.extend(reversed(elements[place].items))
    return found


def _nodes(elements: list[_Element], at: int = 0, depth: int = 0) -> list[Node]:
    """What an element holds, blocks side by side being one slot."""
    out: list[Node] = []
    for place in elements[at].items:
        if place >= 0 and depth < DEEPEST:
            out.append((elements[place].step, [], _nodes(elements, place, depth + 1)))
        elif texts := [~place] if place < 0 else _below(elements, place):
            if out and out[-1][0] == "#":
                out[-1][1].extend(texts)
            else:
                out.append(("#", texts, []))
    return out


def _bare(nodes: list[Node]) -> list:
    """The nodes as nested items: ``#`` for a text slot, [step, items] for an element."""
    return ["#" if step == "#" else [step, _bare(within)] for step, _, within in nodes]


def structure(page: str) -> list:
    """The page as nested items, see ``_bare``, repeated ones folded."""
    return fold(_bare(_nodes(_read_page(page)[0])))


def _key(item) -> str:
    """What an item is matched by: a slot, the step of an element, the items of a group."""
    if isinstance(item, str):
        return item
    return " ".join(map(_key, item[1])) if item[0] in ("+", "?") else item[0]


def _merged(left, right):
    """One item for two of the same key."""
    if isinstance(left, str):
        return left
    for sign in ("?", "+"):
        if left[0] == sign or right[0] == sign:
            units = [x[1] if x[0] == sign else [x] for x in (left, right)]
            if len(units[0]) != len(units[1]):  # the unit of a group stands bare in the other group
                units = [u[0][1] if len(u) == 1 and u[0][0] in ("+", "?") else u for u in units]
            return [sign, [_merged(x, y) for x, y in zip(*units)]]
    return [left[0], align(left[1], right[1])]


def fold(items: list, longest: int = 4) -> list:
    """Runs of neighbours of equal keys become a repeated group ["+", items] whose unit matches all
    of them, shortest units first; the same within elements."""
    items = [i if isinstance(i, str) or i[0] in ("+", "?") else [i[0], fold(i[1])] for i in items]
    for width in range(1, longest + 1):
        out: list = []
        i = 0
        while i < len(items):
            unit = items[i : i + width]
            keys = list(map(_key, unit))
            n = 1
            while len(unit) == width and list(map(_key, items[i + n * width : i + (n + 1) * width])) == keys:
                unit = [_merged(x, y) for x, y in zip(unit, items[i + n * width : i + (n + 1) * width])]
                n += 1
            if n > 1 and keys != ["#"]:
                out.append(unit[0] if width == 1 and unit[0][0] == "+" else ["+", unit])
                i += n * width
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(left: list, right: list) -> list:
    """The union-free expression that matches what both match.

    Items of equal keys are merged, elements item by item. What only one side has becomes
    optional, unless it repeats its neighbour: then folding makes a repeated group of both.
    """
    matcher = SequenceMatcher(None, list(map(_key, left)), list(map(_key, right)), autojunk=False)
    out: list = []

    def optional(items: list) -> None:
        for item in items:
            keys = [_key(i) for i in out[-1:]]
            if keys == [_key(item)] and item != "#":
                out[-1] = ["+", [_merged(out[-1], item)]] if "+" not in (out[-1][0], item[0]) else _merged(out[-1], item)
            else:
                out.append(item if item[0] == "?" else ["?", [item]])

    for kind, a, b, c, d in matcher.get_opcodes():
        if kind == "equal":
            out.extend(_merged(x, y) for x, y in zip(left[a:b], right[c:d]))
        else:
            optional(left[a:b])
            optional(right[c:d])
    return out


def slot_paths(wrapper: list, path: tuple[str, ...] = ()) -> set[str]:
    """The paths of all text slots of a wrapper."""
    found: set[str] = set()
    for item in wrapper:
        if item == "#":
            found.add(">".join(path))
        else:
            found |= slot_paths(item[1], path if item[0] in ("+", "?") else (*path, item[0]))
    return found


@dataclass(slots=True)
class _Level:
    """The items of a wrapper side by side, groups opened: their keys, the levels within them, and the last
    item that may stand before each, which is the end of the repeated group around it."""

    keys: list[str] = field(default_factory=list)
    within: list[_Level | None] = field(default_factory=list)
    before: list[int] = field(default_factory=list)


def _level(items: list) -> _Level:
    level = _Level()

    def add(items: list, repeated: bool) -> None:
        for item in items:
            if isinstance(item, str) or item[0] not in ("+", "?"):
                level.keys.append(_key(item))
                level.within.append(None if isinstance(item, str) else _level(item[1]))
                level.before.append(len(level.keys) - 2)
                continue
            start = len(level.keys)
            add(item[1], repeated or item[0] == "+")
            if item[0] == "+" and not repeated:
                level.before[start:] = [len(level.keys) - 1] * (len(level.keys) - start)

    add(items, False)
    return level


@lru_cache(maxsize=64)
def _compiled(wrapper: str) -> _Level:
    return _level(json.loads(wrapper))


def _places(level: _Level, keys: list[str]) -> list[int | None]:
    """The item of the level that each key stands for, None for keys without one: as many as possible stand
    for one, in the order that the level allows, and of equally many the first."""
    n = len(level.keys)
    found: dict[str, list[int]] = {}
    for j, key in enumerate(level.keys):
        found.setdefault(key, []).append(j)
    # matches of the best row that ends at an item, as matches * (n + 1) + n - item; 0 for none
    best = [0] * n
    rows: list[tuple | None] = [None] * n
    for at, key in enumerate(keys):
        if key not in found:
            continue
        upto = list(accumulate(best, max))
        for j in found[key]:
            last = upto[level.before[j]] if level.before[j] >= 0 else 0
            matches, rest = divmod(last, n + 1)
            if matches + 1 > best[j] // (n + 1):
                best[j] = (matches + 1) * (n + 1) + n - j
                rows[j] = (rows[n - rest] if last else None, at, j)
    places: list[int | None] = [None] * len(keys)
    row = rows[best.index(max(best))] if any(best) else None
    while row:
        row, at, j = row
        places[at] = j
    return places


def match(wrapper: str, nodes: list[Node]) -> Iterator[tuple[int, tuple[int, ...], list]]:
    """Match a page with its host's wrapper: (slot, slots of the elements around it, its blocks) of each text
    slot of the page, slots being digests of where they stand in the wrapper.

    Neighbours of equal steps are one repeated item. What the wrapper has no place for is told by its step.
    """

    def walk(level: _Level, nodes: list[Node], around: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, ...], list]]:
        runs = [(key, list(run)) for key, run in groupby(nodes, key=lambda node: node[0])]
        for (key, run), j in zip(runs, _places(level, [key for key, _ in runs])):
            slot = _digest(around[-1], "", key) if j is None else _digest(around[-1], j)
            for _, blocks, within in run:
                if key == "#":
                    yield slot, around, blocks
                else:
                    yield from walk((level.within[j] if j is not None else None) or _Level(), within, (*around, slot))

    return walk(_compiled(wrapper), nodes, (0,))


def _prior(elements: list[_Element], blocks: list[tuple[int, str]]) -> str:
    """Where the page's text is by its elements and words alone: in an article, in main or in neither (``""``)."""
    kinds = {elements[i].kind for i, _ in blocks if not elements[i].beside}
    return next((kind for kind in ("article", "main") if kind in kinds), "")


def _held(prior: str, slot: int, text: int) -> int:
    """The digest of a text in a slot, on pages of this prior."""
    return _digest(prior, slot, text) if prior else _digest(slot, text)


def choose(page: str, fixed: frozenset[int], wrapper: str = "[]") -> list[str]:
    """The blocks of the main text: of those that stand beside nothing and in no slot of the host's wrapper
    that holds this text on nearly all pages, those in articles, else in the main element, else all.

    An article all of whose text is fixed is a template where more text that varies stands outside, and else
    one that several pages show: it stays.
    """
    elements, blocks = slots(page)
    prior = _prior(elements, blocks)
    own = [(elements[i].kind, text, b) for b, (i, text) in enumerate(blocks) if not elements[i].beside]
    first = [text for kind, text, _ in own if not prior or kind == prior]
    if not fixed:
        return first
    placed = {b: slot for slot, _, found in match(wrapper, _nodes(elements)) for b in found}
    varied = [(kind, text) for kind, text, b in own if _held(prior, placed[b], _digest(text)) not in fixed]
    for told in ("article", "main", ""):
        found = [text for kind, text in varied if not told or kind == told]
        if found and told == prior or sum(map(len, found)) > sum(map(len, first)):
            return found
    return first if prior else []


def _read_shape(page: str) -> tuple[str, str, str | None]:
    """The folded structure of a page, where its text is by the prior, and of a page with text its nodes with
    the digests of the blocks beside nothing; structure and nodes as JSON."""
    elements, blocks = slots(page)
    nodes = _nodes(elements)
    own = {b: _digest(text) for b, (i, text) in enumerate(blocks) if not elements[i].beside}
    texts = None
    if own:

        def told(nodes: list[Node]) -> list[Node]:
            return [(step, [own[b] for b in found if b in own], told(within)) for step, found, within in nodes]

        texts = json.dumps(told(nodes))
    return json.dumps(fold(_bare(nodes))), _prior(elements, blocks), texts


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _fixed(read_rows: DataFrame) -> DataFrame:
    """(host, fixed): the slots that nearly all pages of the host hold that can have them.

    A page can have a slot if it has the element around it and its text is in the same place by the prior
    (article, main or neither). Pages of equal slots count once, so copies of a page do not make its
    text fixed. Where all slots of a host's pages of one prior are fixed, these give none.
    """
    own = read_rows.filter(F.size("_slots") > 0).withColumn("_page", F.xxhash64("_slots"))
    slot = own.select("host", "_prior", "_page", F.inline("_slots"))
    held = materialize(slot.groupBy("host", "_prior", "slot", "around").agg(F.count_distinct("_page").alias("_n")))
    branches = own.select("host", "_prior", "_page", F.explode("_arounds").alias("around")).groupBy(
        "host", "_prior", "around"
    ).agg(F.count_distinct("_page").alias("_of"))
    # most texts stand on one page: these are not joined
    repeated = materialize(held.filter("_n > 1").join(branches, ["host", "_prior", "around"]).select(
        "host", "_prior", "slot", (10 * F.col("_n") >= FIXED_TENTHS * F.col("_of")).alias("_same")
    ))
    varied = held.filter("_n = 1").select("host", "_prior").union(repeated.filter(~F.col("_same")).select("host", "_prior"))
    same = repeated.filter("_same").join(varied.distinct(), ["host", "_prior"], "left_semi")
    return same.groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("fixed"))


def _read(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, _structure, _prior, _texts) of each page, see ``_read_shape``."""
    rows = pages.select(_host(f"`{url}`").alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read_shape(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([page[i] for page in found], pa.string()) for i in range(3)]],
                names=["host", "_structure", "_prior", "_texts"],
            )

    return materialize(rows.mapInArrow(read, "host string, _structure string, _prior string, _texts string"))


def _matched(read_rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, _prior, _slots, _arounds) of each page with text: as digests its text in slots of the host's
    wrapper, and the elements around them."""
    rows = read_rows.filter(F.col("_texts").isNotNull()).join(wrappers, "host").select("host", "_prior", "wrapper", "_texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int]] = []
            arounds: list[int] = []
            ends: tuple[list[int], list[int]] = [0], [0]
            for prior, wrapper, texts in zip(*batch.columns[1:]):
                kind = prior.as_py()
                found = [x for x in match(wrapper.as_py(), json.loads(texts.as_py())) if x[2]]
                held += sorted({(_held(kind, slot, text), around[-1]) for slot, around, own in found for text in own})
                arounds += sorted({a for _, around, _ in found for a in around})
                ends[0].append(len(held))
                ends[1].append(len(arounds))
            pairs = [pa.array([pair[i] for pair in held], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.ListArray.from_arrays(pa.array(ends[0], pa.int32()), pa.StructArray.from_arrays(pairs, ["slot", "around"])),
                    pa.ListArray.from_arrays(pa.array(ends[1], pa.int32()), pa.array(arounds, pa.int64())),
                ],
                names=["host", "_prior", "_slots", "_arounds"],
            )

    schema = "host string, _prior string, _slots array<struct<slot:long,around:long>>, _arounds array<long>"
    return materialize(rows.mapInArrow(find, schema))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, n_pages, fixed): for each host the expression that all its pages match, as
    JSON, and the digests of its slots with the text that these hold on nearly all pages that can have them.

    Pages travel as their folded structure, counted before the shuffle, so a hot host costs its
    distinct structures. These are aligned by ``ALIGNED`` at a time, and the results again, until
    one is left for each host; the order is that of digests, so reruns agree. Elements more than
    ``DEEPEST`` deep count as content of the one there. NULL pages are empty, NULL urls and urls without a
    host share the host ''.
    """
    read_rows = _read(pages, url, html)
    counts = read_rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    level = materialize(
        read_rows.groupBy("host", F.col("_structure").alias("wrapper")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["wrapper"], key=lambda s: hashlib.md5(s.encode()).digest())
        whole = json.loads(texts[0])
        for text in texts[1:]:
            whole = align(whole, json.loads(text))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("_m"))
        largest = sizes.agg(F.max("_m")).first()[0] or 0
        groups = F.ceil(F.col("_m") / F.lit(ALIGNED)).cast("int")
        salted = level.join(sizes, "host").withColumn("_part", F.pmod(F.xxhash64("wrapper"), groups))
        level = materialize(salted.groupBy("host", "_part").applyInPandas(merge, "host string, wrapper string"))
        if largest <= ALIGNED:
            break
    wrappers = level.select("host", "wrapper")
    fixed = _fixed(_matched(read_rows, wrappers))
    return wrappers.join(counts, "host").join(fixed, "host", "left")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` and ``n_chars`` (its code points) instead of the html.

    A wrapper is inferred for each host and each page matched with it, see ``infer`` and ``match``. Slots of the
    wrapper that hold the same text on nearly all of the host's pages are its template, within an article too. The
    main text are the blocks in other slots: of the article elements, else of the main element, else all, see ``choose``.
    Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles
    are told by element, role, class and id, wherever they stand; the header of an article itself
    holds its title and stays, and layout words on an element around an article, and forms around one, do
    not count. A class or id is told by all of its words (``social-story`` is no share bar), and where no
    article or main element is left, such words and forms do not count on what holds the larger part of
    the text. An attribute's quote that nothing closes ends at the next ``>``. Character references are decoded,
    white space in a block becomes one space, ends are trimmed, empty blocks left out, and blocks
    joined by one line end. Whole pages of any length count. NULL and empty pages give an empty
    text, repeated rows equal ones, an empty table no rows; columns of the added names are
    replaced and others kept.
    """
    found = infer(pages, url, html).filter(F.col("fixed").isNotNull())
    wrappers = materialize(found.select("host", F.col("fixed").alias("_fixed"), F.col("wrapper").alias("_wrapper")))
    kept = [c for c in pages.columns if c not in {html, "main_text", "n_chars"}]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"),
        _host(f"`{url}`").alias("host"),
    )
    rows = rows.join(wrappers, "host", "left").select("_row", "_html", "_fixed", "_wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n".join(choose(page.as_py(), frozenset(fixed.as_py() or ()), wrapper.as_py() or "[]"))
                for page, fixed, wrapper in zip(batch.column(1), batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["_row", "main_text", "n_chars"],
            )

    schema = T.StructType([rows.schema["_row"], T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).select("_row.*", "main_text", "n_chars")
