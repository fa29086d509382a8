"""Splitting oversized texts at natural boundaries.

Method: structure-tree packing. A text is read as a tree of sections (a heading with what follows it, down to the next
heading of its depth: hashes, tags, numbering, plain short lines last), paragraphs, list items (an item with the deeper
indented ones below it), lines (table rows), sentences, clauses, words and single characters. Sibling subtrees are merged
bottom-up as long as they fit; only nodes that are too large are opened one level further. Neighbouring pieces share
the last whole units of the earlier piece up to ``overlap`` characters, or where a single unit is larger, its last
``overlap`` characters from a word's start on.

Pieces are given by their places in the text: new content [content_start, end) tiles the text without gaps, and
[start, content_start) is the part shared with the piece before.

Defined cases: null texts and texts within the limit give no pieces; blank texts above it are cut like others; runs
without blanks are cut at characters, not before combining marks; repeated rows are each split; an empty table gives
no rows; further columns are kept apart under the names given.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line that heads what follows, by depth: hashes, a tag, a number of one or more parts, or a short line without a full stop.
_HEADING = re.compile(r"\s*(?:(#{1,6})\s|<[hH]([1-6])\b|(\d+(?:\.\d+)*)[.)]?\s+[A-ZÀ-Þ]|[A-ZÀ-Þ][^|.!?:;\n]{1,70}$)")
_PLAIN = 7
_ITEM = re.compile(r"([^\S\n]*)(?:[-*•–]|\d+[.)]|[a-z][.)])[^\S\n]")
_LINE = re.compile(r"[^\n]*\n?")
#: Places to cut at by level: each pattern matches the separator that stays with the unit before it.
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_ROW = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"”’»)\]]*\s+")
_CLAUSE = re.compile(r"(?<=[;:,])\s+|\s+(?=[–—]\s)|\s*\|\s*")
_WORD = re.compile(r"\s+")


def _depth(line: str) -> int | None:
    """Depth of a heading, None for any other line."""
    if not line.strip() or " | " in line or _ITEM.match(line):
        return None
    m = _HEADING.match(line.rstrip("\n"))
    if not m:
        return None
    return len(m[1]) if m[1] else int(m[2]) if m[2] else m[3].count(".") + 1 if m[3] else _PLAIN


def _indent(line: str) -> int | None:
    """Indentation of a list item, None for any other line."""
    m = _ITEM.match(line)
    return len(m[1].expandtabs(4)) if m else None


def _subtrees(text: str, start: int, end: int, rank: Callable[[str], int | None]) -> list[tuple[int, int]]:
    """The node cut at those of its inner lines that rank highest (have the least number)."""
    ranked = [(start + m.start(), r) for m in _LINE.finditer(text[start:end]) if m.start() and (r := rank(m[0])) is not None]
    least = min((r for _, r in ranked), default=None)
    marks = [start, *(at for at, r in ranked if r == least), end]
    return list(zip(marks, marks[1:]))


def _cut_at(separator: re.Pattern) -> Callable[[str, int, int], list[tuple[int, int]]]:
    def cut(text: str, start: int, end: int) -> list[tuple[int, int]]:
        marks = [start, *(start + m.end() for m in separator.finditer(text[start:end])), end]
        return [(a, b) for a, b in zip(marks, marks[1:]) if b > a]

    return cut


#: How a node is opened at each level, and whether its parts may be opened the same way again.
_LEVELS: tuple[tuple[Callable[[str, int, int], list[tuple[int, int]]], bool], ...] = (
    (partial(_subtrees, rank=_depth), True), (_cut_at(_PARAGRAPH), False), (partial(_subtrees, rank=_indent), True),
    (_cut_at(_ROW), False), (_cut_at(_SENTENCE), False), (_cut_at(_CLAUSE), False), (_cut_at(_WORD), False),
)


def _windows(text: str, start: int, end: int, room: int) -> list[tuple[int, int]]:
    out = []
    while end - start > room:
        cut = start + room
        while cut > start + room // 2 and unicodedata.combining(text[cut]):
            cut -= 1
        out.append((start, cut))
        start = cut
    out.append((start, end))
    return out


def pack(text: str, start: int, end: int, room: int, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``room`` characters which tile [start, end): oversized nodes are opened, siblings merged."""
    while end - start > room:
        if level == len(_LEVELS):
            return _windows(text, start, end, room)
        opened, again = _LEVELS[level]
        parts = opened(text, start, end)
        if len(parts) > 1:
            break
        level += 1
    else:
        return [(start, end)]
    spans: list[tuple[int, int]] = []
    for a, b in parts:
        packed = pack(text, a, b, room, level if again else level + 1)
        if spans and spans[-1][1] - spans[-1][0] + packed[0][1] - packed[0][0] <= room:
            spans[-1] = (spans[-1][0], packed[0][1])
            packed = packed[1:]
        spans += packed
    return spans


def shared_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the part of [start, end) begins that the next piece repeats."""
    floor = max(start, end - overlap)
    if floor == start:
        return start
    for cut in (_ROW, _SENTENCE):
        marks = [start + m.end() for m in cut.finditer(text[start:end])]
        whole = [m for m in marks if floor <= m < end and text[m:end].strip()]
        if whole:
            return whole[0]
    blank = re.search(r"\s+", text[floor:end])
    return floor + blank.end() if blank and blank.end() < (end - floor) // 2 and not text[floor - 1].isspace() else floor


def split(text: str, limit: int = 800, overlap: int = 120) -> list[tuple[int, int, int]]:
    """(start, content_start, end) of each piece of a text above the limit."""
    spans = pack(text, 0, len(text), limit - overlap)
    # the first piece repeats nothing: it may be filled up to the limit with the next span
    if len(spans) > 1 and spans[1][1] - spans[0][0] <= limit:
        spans[:2] = [(spans[0][0], spans[1][1])]
    out = [(spans[0][0], *spans[0])]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        out.append((shared_start(text, a, b, overlap), c, d))
    return out


def pieces(df: DataFrame, key: str, text: str, keep: list[str] | None = None, limit: int = 800, overlap: int = 120, with_text: bool = True) -> DataFrame:
    """One row for each piece of the oversized rows: key, kept columns, piece, n_pieces, start, content_start, end, piece_text."""
    keep = keep or []
    large = df.filter(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    types = dict(large.dtypes)
    kept = [f"kept_{i}" for i in range(len(keep))]
    schema = ", ".join([f"key {types['key']}", *(f"{c} {types[c]}" for c in kept), "piece int, n_pieces int, start int, content_start int, end int, piece_text string"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                spans = split(row[1], limit, overlap)
                for i, (a, c, b) in enumerate(spans):
                    rows.append((row[0], *row[2:], i, len(spans), a, c, b, row[1][a:b] if with_text else None))
            yield pd.DataFrame(rows, columns=["key", *kept, "piece", "n_pieces", "start", "content_start", "end", "piece_text"])

    out = large.mapInPandas(cut, schema)
    return out.select(F.col("key").alias(key), *[F.col(k).alias(c) for k, c in zip(kept, keep)], "piece", "n_pieces", "start", "content_start", "end", "piece_text")
