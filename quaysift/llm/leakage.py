"""Evaluation passages inside a training corpus: which documents hold which items, whole or in part.

Method: greedy string tiling. Word sequences shared by a document and an item are found by Karp-Rabin hashes of
``seed`` words, grown to maximal matches, and marked longest first without overlap until none is left. Tiles which
follow one another in both texts with small gaps make a connected stretch; an item has leaked where a stretch, or
for reordered passages the coverage by long tiles within a narrow window, reaches the threshold.

The items are the query set: they are fixed in number (at most ``block`` are held at once; more are taken in blocks,
each against all documents). Every document is read whole in one pass without a shuffle; candidates of a document
are the items with which it shares a telling word (one that few items hold, if the item has any) and enough word pairs,
looked up in an index of all words and pairs of the items. A stretch must hold three fifths of its item's telling words there.

Words are compared in lower case, without invisible characters, look-alike letters, grouping marks in numbers and
hyphens at line ends. An opening instruction, ending in a colon and shared by several items, is left out of both
the comparison and the count of words.

Defined cases: null or empty texts and items match nothing; items of fewer than ``seed`` words must occur whole
word by word and count only from two words on; repeated documents and items each give their pairs; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysift.session import spread

#: Look-alike letters of other scripts.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαοντρυ", "aeopcyxijsdhkmtbnaovtpu")
_ODD = re.compile("[­​‌‍⁠﻿͏]|[Ѐ-ӿͰ-Ͽ＀-￯ﬀ-ﬆ‐‑]")
_GONE = re.compile("[­​‌‍⁠﻿͏]+")
_BROKEN = re.compile(r"(?<=[a-z])[-­‐]\s*\n[\s>|]*(?=[a-z])")
_GROUPED = re.compile(r"(?<=\d)[,.'’   ](?=\d)")
_WORD = re.compile(r"[^\W_]+")
MASK = (1 << 61) - 1
BASE = 1_000_003
SEED, GAP, THIRD, DENSITY = 2, 5, 1 / 3, 0.68


def words(text: str | None) -> list[str]:
    """The words as compared."""
    if not text:
        return []
    if not text.isascii():
        if _ODD.search(text):
            text = _GONE.sub("", text)
            text = unicodedata.normalize("NFKC", text).lower().translate(LOOKALIKES)
        text = text.replace("’", "").replace("‘", "")
    text = text.lower().replace("'", "")
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(_GROUPED.sub("", text))


def openers(texts: Iterable[str], least: int = 3) -> set[str]:
    """Openings up to a colon which several items share."""
    seen = Counter(m[0].strip().lower() for t in texts if t and (m := re.match(r"[^:\n]{8,160}:\s", t)))
    return {o for o, n in seen.items() if n >= least}


def without_opener(text: str, known: set[str]) -> str:
    m = re.match(r"[^:\n]{8,160}:\s", text)
    return text[m.end() :] if m and m[0].strip().lower() in known else text


#: A word tells an item apart if at most so many of all items hold it.
FEW = 8


def statistics(texts: Callable[[], Iterable[str]]) -> tuple[set[str], set[str]]:
    """(shared openings, telling words) over all items, in two walks; kept are the openings and the items' vocabulary."""
    known = openers(texts())
    held_by = Counter(w for t in texts() for w in set(words(without_opener(t or "", known))))
    return known, {w for w, n in held_by.items() if n <= FEW}


class Items:
    """A block of items with an index of their word pairs; openings and telling words are those of all items."""

    def __init__(self, rows: list[tuple[int, str]], known: set[str], telling: set[str]):
        self.ids, self.tokens = [], []
        self.vocabulary: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for key, text in rows:
            w = words(without_opener(text or "", known))
            if len(w) < 2:
                continue
            coded = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
            at = len(self.ids)
            self.ids.append(key)
            self.tokens.append(coded)
            for pair in set(zip(coded, coded[1:])):
                self.pairs[pair].append(at)
        self.telling = {t for w, t in self.vocabulary.items() if w in telling}
        self.by_telling: dict[int, list[int]] = defaultdict(list)
        self.plain: set[int] = set()
        for at, coded in enumerate(self.tokens):
            own = self.telling.intersection(coded)
            for t in own:
                self.by_telling[t].append(at)
            if not own:
                self.plain.add(at)
        self.need = [max(1, int(len(t) * THIRD * DENSITY / 3)) for t in self.tokens]


def tiles(a: list[int], b: list[int], seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, no word in two tiles."""
    if len(a) < seed or len(b) < seed:
        return [(0, 0, len(a))] if a and a == b else []

    def hashes(x: list[int]) -> list[int]:
        top = pow(BASE, seed - 1, MASK)
        h = 0
        for t in x[:seed]:
            h = (h * BASE + t + 2) % MASK
        out = [h]
        for i in range(seed, len(x)):
            h = ((h - (x[i - seed] + 2) * top) * BASE + x[i] + 2) % MASK
            out.append(h)
        return out

    where = defaultdict(list)
    for i, h in enumerate(hashes(a)):
        where[h].append(i)
    heap, reached = [], {}
    for j, h in enumerate(hashes(b)):
        if b[j] < 0:
            continue
        for i in where.get(h, ()):
            if reached.get(i - j, -1) > j:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            reached[i - j] = j + n - seed + 1
            if n >= seed:
                heapq.heappush(heap, (-n, j, i))
    used_a, used_b, out = bytearray(len(a)), bytearray(len(b)), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = [not (used_a[i + k] or used_b[j + k]) for k in range(n)]
        if all(free):
            out.append((i, j, n))
            used_a[i : i + n] = used_b[j : j + n] = b"\1" * n
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= seed:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return out


def stretch(a: list[int], found: list[tuple[int, int, int]], telling: set[int]) -> tuple[float, float]:
    """(share of a in its longest connected stretch, share of a covered by long tiles in one narrow window)."""
    best, total = 0, len(a)
    order = sorted(found, key=lambda t: t[1])
    best_share = 0.0
    for s in range(len(order)):
        i0, j0, n = order[s]
        end_a, end_b, hit = i0 + n, j0 + n, n
        pending = s + 1
        last = s
        while True:
            span = end_a - i0
            if hit >= DENSITY * span and span > best:
                inside = [k for k in range(i0, end_a) if a[k] in telling]
                held = set()
                for i, j, m in order[s : last + 1]:
                    held.update(range(i, i + m))
                if not telling.intersection(a) or inside and sum(k in held for k in inside) >= 0.6 * len(inside):
                    best, best_share = span, span / total
            nxt = None
            while pending < len(order) and order[pending][1] - end_b <= GAP:
                if order[pending][1] >= end_b and 0 <= order[pending][0] - end_a <= GAP:
                    nxt = pending
                    break
                pending += 1
            if nxt is None:
                break
            i, j, m = order[nxt]
            end_a, end_b, hit, last, pending = i + m, j + m, hit + m, nxt, nxt + 1
    long = [t for t in order if t[2] >= 4]
    cover = 0.0
    for s in range(len(long)):
        inside = [t for t in long[s:] if t[1] + t[2] - long[s][1] <= 1.5 * total + 10]
        marked = [a[k] for i, _, n in inside for k in range(i, i + n)]
        keys = [t for t in a if t in telling]
        if keys and sum(t in telling for t in marked) >= 0.5 * len(keys):
            cover = max(cover, len(marked) / total)
    return best_share, cover


def matches(text: str | None, items: Items) -> list[tuple[int, float, float]]:
    """(item id, connected share, covered share) of all items that leaked into a text."""
    w = words(text)
    get = items.vocabulary.get
    coded = [get(x, -1) for x in w]
    known = {t for t in coded if t >= 0}
    candidates = {item for t in known & items.telling for item in items.by_telling[t]} | (items.plain if known else set())
    if not candidates:
        return []
    out = []
    score: Counter[int] = Counter()
    for pair in {p for p in zip(coded, coded[1:]) if p[0] >= 0 and p[1] >= 0}:
        for item in items.pairs.get(pair, ()):
            if item in candidates:
                score[item] += 1
    for item, n in score.items():
        if n < items.need[item]:
            continue
        a = items.tokens[item]
        mine = set(a)
        b = [t if t in mine else -1 for t in coded]
        share, cover = stretch(a, tiles(a, b), items.telling)
        if share >= THIRD or cover >= 0.6:
            out.append((items.ids[item], share, cover))
    return out


def leaked(documents: DataFrame, eval_items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = 5000) -> DataFrame:
    """(item_id, doc_id, connected, covered) of all items and the documents that hold them.

    Items go out in blocks of a fixed size, each against all documents; the result doesn't depend on the blocks.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0))
    queries = eval_items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull()).orderBy("item_id")
    n = queries.count()
    known, telling = statistics(lambda: (r.text for r in queries.toLocalIterator()))
    schema = "item_id bigint, doc_id bigint, connected double, covered double"
    out = None
    for start in range(0, max(n, 1), block):
        rows = [(r.item_id, r.text) for r in queries.offset(start).limit(block).collect()]
        shared = spark.sparkContext.broadcast(Items(rows, known, telling))

        def match(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = shared.value
            for pdf in frames:
                found = [(i, k, s, c) for k, t in zip(pdf["doc_id"], pdf["text"]) for i, s, c in matches(t, items)]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "connected", "covered"])

        part = docs.mapInPandas(match, schema)
        out = part if out is None else out.unionByName(part)
    return out
