"""Splitting oversized texts at natural boundaries by packing their structure tree.

A text is a tree: sections by heading depth, blocks (paragraphs, lists, tables, fenced code), list items and lines, sentences,
words, characters. Sibling subtrees are merged bottom-up as long as they fit; only a node that is itself too large is descended
into. The spans of all nodes tile the text, so pieces put together give it back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import spread

#: Characters after which a cut is natural (fixed values).
BOUNDARY = " \t\n\r.!?。！？"
LIMIT, OVERLAP = 1200, 120

_HEADING = regex.compile(r"^(?:(#{1,6})[ \t]|<h([1-6])\b|(?:[^\n\r]+)\r?\n(=+|-{3,})[ \t]*(?=\r?\n|\Z))", regex.M | regex.I)
_ITEM = regex.compile(r"^[ \t]{0,3}(?:[-*+•]|\d{1,3}[.)])[ \t]", regex.M)
_LINE = regex.compile(r"[^\n\r]*(?:\r\n|\n|\r|\Z)")
_SENTENCE = regex.compile(r"[^.!?。！？]*(?:[。！？]+|[.!?]+(?:[\"'”’»)\]]*[ \t\n\r]+|\Z)|[.!?]+|\Z)")
_WORD = regex.compile(rf"[^{regex.escape(BOUNDARY)}]*(?:[{regex.escape(BOUNDARY)}]+|\Z)")

Span = tuple[int, int]


def _starts(cuts: list[int], a: int, b: int) -> list[Span]:
    edges = [a, *sorted({c for c in cuts if a < c < b}), b]
    return list(zip(edges, edges[1:], strict=False))


def _sections(text: str, a: int, b: int) -> list[Span]:
    """Cuts before the headings of the smallest depth in the span."""
    heads = [(m.start(), len(m[1]) if m[1] else int(m[2]) if m[2] else 1 if m[3][0] == "=" else 2) for m in _HEADING.finditer(text, a, b)]
    inner = [h for h in heads if h[0] > a]
    top = min((d for _, d in inner), default=0)
    return _starts([s for s, d in inner if d == top], a, b)


def _blocks(text: str, a: int, b: int) -> list[Span]:
    """Cuts after blank lines, but not inside fenced code."""
    cuts, fence, blank, at = [], "", False, a
    for m in _LINE.finditer(text, a, b):
        line = m.group()
        if not line:
            continue
        bare = line.strip()
        if blank and bare and not fence:
            cuts.append(m.start())
        if bare[:3] in ("```", "~~~") and (not fence or bare[:3] == fence):
            fence = "" if fence else bare[:3]
        blank, at = not bare, m.end()
    return _starts(cuts, a, b) if at else [(a, b)]


def _items(text: str, a: int, b: int) -> list[Span]:
    return _starts([m.start() for m in _ITEM.finditer(text, a, b)], a, b)


def _by(pattern: regex.Pattern) -> Callable[[str, int, int], list[Span]]:
    return lambda text, a, b: _starts([m.end() for m in pattern.finditer(text, a, b)], a, b)


#: Depths of headings.
SECTIONS = 6
#: Levels of the tree from the top: name of the cut and how a node falls into its children.
LEVELS: tuple[tuple[str, Callable[[str, int, int], list[Span]]], ...] = (
    *((("section"), _sections) for _ in range(SECTIONS)),
    ("block", _blocks),
    ("item", _items),
    ("line", _by(_LINE)),
    ("sentence", _by(_SENTENCE)),
    ("word", _by(_WORD)),
)


def pack(text: str, a: int, b: int, budget: int, level: int = 0, whole: list[Span] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the start) of units of at most ``budget`` characters that tile the span.

    Nodes of the lowest level that have to be descended into, where no natural boundary is left, are added to ``whole``.
    """
    if b - a <= budget:
        return [(a, b, "")]
    if level == len(LEVELS):
        if whole is not None:
            whole.append((a, b))
        return [(s, min(s + budget, b), "forced" if s > a else "") for s in range(a, b, budget)]
    name, fall = LEVELS[level]
    parts = fall(text, a, b)
    if len(parts) == 1:
        return pack(text, a, b, budget, level + 1 if name != "section" else SECTIONS, whole)
    units: list[tuple[int, int, str]] = []
    for s, e in parts:
        for u, v, kind in pack(text, s, e, budget, level + 1, whole):
            if units and v - units[-1][0] <= budget:
                units[-1] = (units[-1][0], v, units[-1][2])
            else:
                units.append((u, v, kind or (name if u > a else "")))
    return units


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut before the new part) of at most ``limit`` characters; see ``split_tree``."""
    return split_tree(text, limit, overlap)[0]


def split_tree(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], bool]:
    """Pieces (start, end, kind of the cut before the new part), and whether the tree has a word of more than ``limit`` characters.

    Each piece begins ``overlap`` characters before the end of the previous one, so it has at most ``limit - overlap`` new
    characters. A text within the limit is one piece. ``kind`` is empty for the first piece and ``forced`` where no boundary
    character stood in reach: in words above ``limit - overlap``. Words above ``limit``, which would not fit a piece of their
    own either, are the lowest nodes that the packing had to descend into.
    """
    if len(text) <= limit:
        return [(0, len(text), "")], False
    whole: list[Span] = []
    units = pack(text, 0, len(text), limit - overlap, 0, whole)
    oversized = any(len(text[a:b].rstrip(BOUNDARY)) > limit for a, b in whole)
    if units[0][1] < overlap:  # the first piece must be able to share its end: it takes what it can of the second
        stop = units[1][1] if units[1][1] <= limit else limit
        cut = max((m.end() for m in regex.finditer(rf"[{regex.escape(BOUNDARY)}]", text[:stop]) if m.end() >= overlap), default=stop)
        rest = [] if cut == units[1][1] else [(cut, units[1][1], "word" if text[cut - 1] in BOUNDARY else "forced")]
        units = [(0, cut, ""), *rest, *units[2:]]
    return [(max(0, s - overlap), e, kind) for s, e, kind in units], oversized


def split_corpus(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, end, cut, forced, body): the pieces of every text above ``limit`` characters.

    ``piece`` counts from 0; ``start`` and ``end`` are code points; ``forced`` is 1 on all pieces of a text whose tree
    has a word, a stretch without a boundary character, of more than ``limit`` characters. Null, empty and short texts have no rows;
    repeated rows stay; further columns are not read. Texts of any length are split whole, in time linear in their length.
    """
    slim = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > limit))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "piece", "start", "end", "cut", "forced", "body"]
        for b in batches:
            for n, t in enumerate(b.column(1).to_pylist()):
                pieces, oversized = split_tree(t, limit, overlap)
                forced = int(oversized)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([n] * len(pieces), pa.int64())),
                        pa.array(range(len(pieces)), pa.int32()),
                        pa.array([p[0] for p in pieces], pa.int32()),
                        pa.array([p[1] for p in pieces], pa.int32()),
                        pa.array([p[2] for p in pieces], pa.string()),
                        pa.array([forced] * len(pieces), pa.int32()),
                        pa.array([t[p[0] : p[1]] for p in pieces], pa.string()),
                    ],
                    names,
                )

    return slim.mapInArrow(run, f"k {kind}, piece int, start int, end int, cut string, forced int, body string").withColumnRenamed("k", key)
