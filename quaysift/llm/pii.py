"""Personal data in free text: find it and put typed placeholders in its place.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans (see
pii_training). Windows are laid over every position of every text. They overlap; where they do, their scores are blended by
distance to the window's edge, and the Viterbi path of the whole text is decoded. A window's scores don't depend on the windows
computed with it.

Defined cases: null and empty texts give nothing; texts of any length are read whole; repeated rows each give their
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import threading
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysift.functions import ontology as O
from quaysift.llm.pii_templates import KINDS
from quaysift.session import spread

PLACEHOLDERS = {"person_name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street_address": "[ADDRESS]"}
WINDOW, STRIDE, CONTEXT, BLOCK = 96, 64, 26, 496  # a block's rows are no power of two, for the caches' sake
CELLS, PIECE, GROUP = 1 << 20, 128, 1 << 20
#: What the beginning of a span of a kind gains over the trained scores: a missed name or number is worse than a spare placeholder.
MARGINS = {"person_name": 3.0, "phone": 2.0}
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

#: Letters of the alphabets that have two cases, by rule.
_LETTERS = [c for c in map(chr, range(0x24F)) if c.isalpha()] + [c for c in map(chr, range(0x370, 0x530)) if c.isalpha()] + [c for c in map(chr, range(0x1E00, 0x1F00)) if c.isalpha()]
UP = "".join(c for c in _LETTERS if c.isupper())
ANY = "".join(_LETTERS)
# Words that no name begins with, particles of names, ends of streets' names, words before them, post boxes.
_NO_NAME = frozenset(
    "The In On At By For From To Of And But Or Our This That These Those Is Are Was Were It Its If When As With After Before Under Over Table All No Not Per Total Net Gross Section Article Figure Page Note".split()
)
_PARTICLE = "de|da|do|dos|das|del|della|di|du|la|le|el|al|bin|ibn|ben|van|von|der|den|dem|ter|ten|te|het|af|av|zu|zur|y|e|i|st"
_STREET_ENDS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer", "straat", "laan", "plein", "gracht", "ox", "OX", "fach", "ostale", "ostbus", "partado", "asella")
_STREET_BEFORE = re.compile(rf"(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]alle|[Aa]venida|[Pp]laza|[Rr]ua|[Uu]lica|ul\.|al\.)(?:\s[^\W\d_]+){{1,4}}$")
_CAP = rf"[{UP}][{ANY}'’-]+"
#: Where personal data is likely: training reads the surroundings of these places, ``find`` reads all. Each pattern begins with a small set of characters, which keeps the search fast.
_CUE_MAIL = re.compile(r"@|[(\[](?:at|AT)[)\]]")
_USER = re.compile(r"[\w.+-]*\s?$")
_HOST = re.compile(r"(?:\s?[\w-]+(?:\s?(?:\.|[(\[](?:dot|DOT)[)\]])\s?[\w-]+)*)?")
_CUE_NAME = re.compile(rf"[{UP}](?<![{ANY}][{UP}])(?:\.|[{ANY}'’-]+[.,]?)\s{{1,2}}(?:(?:{_PARTICLE})\s){{0,3}}(?:[{UP}]\.\s?){{0,2}}[{UP}][{ANY}'’-]*")
_CUE_NUMBER = re.compile(rf"\d(?<![\d$€£]\d)(?:(?:[ \xa0()/.+-]{{0,3}}\d){{6,}}|[\dA-Za-z]{{0,4}},?[ \xa0](?:[{UP}]|(?:rue|avenue|boulevard|via|calle)[ \xa0]))")
_CUE_LETTERED = re.compile(r"[A-Z][ -]?\d(?:[ -]?\d){4,}")
_CUE_HOUSE = re.compile(r"[a-zßX.]\s\d")
_POSTCODE = re.compile(r"\d{1,4}[a-z]?,?\s\s?\d{2}-?\d{2,3}")
_DAY = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d$")


def cues(text: str) -> list[tuple[int, int]]:
    """Spans around which training reads a text."""
    found = []
    for m in _CUE_NAME.finditer(text):
        first = m[0].split(None, 1)[0]
        if first in _NO_NAME:
            m = _CUE_NAME.match(text, m.start() + len(first) + 1)
        if m:
            found.append(m.span())
    found += [m.span() for m in _CUE_NUMBER.finditer(text) if not _DAY.match(m[0])]
    found += [m.span() for m in _CUE_LETTERED.finditer(text)]
    if any(mark in text for mark in ("@", "at)", "at]", "AT)", "AT]")):
        found += [(_USER.search(text, max(0, m.start() - 65), m.start()).start(), _HOST.match(text, m.end()).end()) for m in _CUE_MAIL.finditer(text)]
    for m in _CUE_HOUSE.finditer(text):
        at = m.start() + 1
        before = text[max(0, at - 40) : at]
        house = _POSTCODE.match(text, at + 1)
        named = before[before.rfind(" ") + 1 :][:1].isupper()  # the word before a number that may be a street's
        if house or before.endswith(_STREET_ENDS) or named and _STREET_BEFORE.search(before):
            found.append((m.start(), house.end() if house else m.end()))
    found.sort()
    return found


# Characters as the tagger sees them: digits alike, accented letters alike, a few signs of their own.
_SIGNS = "€£’‘“”–—…§¶²°±"


def _class_table() -> np.ndarray:
    table = np.full(0x3100, 1, np.int64)
    table[10], table[9], table[32], table[0xA0] = 2, 3, 3, 3
    k = 4
    for o in range(33, 127):
        if 48 <= o < 58:
            table[o] = 4
        else:
            k += 1
            table[o] = k
    for c in ANY:
        if ord(c) >= 0xC0:
            table[ord(c)] = k + 2 if c.isupper() else k + 1
    for i, c in enumerate(_SIGNS):
        if ord(c) < len(table):
            table[ord(c)] = k + 3 + i
    return table


CLASSES = _class_table()
N_CLASSES = int(CLASSES.max()) + 1
TAGS = 1 + 2 * len(KINDS)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(points, len(CLASSES) - 1)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all cues of a text."""
    out: list[list[int]] = []
    for start, end in cues(text):
        a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The network's sigmoid-shaped function of x, x (27 + x²) / (27 + 9 x²) up to 3, then 1, is v / KAPPA with v = u + u / (1/8 + u²), u = x / ROOT up to EDGE.
ROOT, EDGE, KAPPA = np.float32(24**0.5), np.float32(0.375**0.5), np.float32(9 / 24**0.5)


def squash(u: np.ndarray, a: np.ndarray) -> None:
    """KAPPA times the network's sigmoid-shaped function of ROOT u, in place; a is scratch."""
    np.clip(u, -EDGE, EDGE, out=u)
    np.multiply(u, u, out=a)
    a += np.float32(1 / 8)
    np.divide(u, a, out=a)
    u += a


_LOCAL = threading.local()


def _scratch(name: str, *shape: int) -> np.ndarray:
    """A float32 array to be overwritten, in the memory of the last one of this name: fresh memory costs more than the sums in it."""
    kept, size = _LOCAL.__dict__, math.prod(shape)
    if name not in kept or len(kept[name]) < size:
        kept[name] = np.empty(size, np.float32)
    return kept[name][:size].reshape(shape)


class Tagger:
    """The trained network; all arrays float32."""

    def __init__(self, weights: dict[str, np.ndarray]):
        w = {k: v.astype(np.float64) for k, v in weights.items()}
        self.h, width = w["wh"].shape[1], w["emb"].shape[1]
        h = self.h
        # gate(x) = (KAPPA + v(x / 2)) / (2 KAPPA): with halved columns one squash serves all gates; states are kept 2 KAPPA² times as large
        column = np.full(4 * h, 1 / float(ROOT))
        column[: 3 * h] /= 2
        state = 1 / (2 * float(KAPPA) ** 2)
        # one product for each step: the gates from state, character and bias, and the tags' scores of the step before
        step = np.zeros((2, 4 * h + TAGS, h + width + 1))
        step[:, : 4 * h] = (np.concatenate([w["wh"] * state, w["wx"], w["b"][:, None, :]], 1) * column).transpose(0, 2, 1)
        step[:, 4 * h :, :h] = w["wo"].reshape(2, h, TAGS).transpose(0, 2, 1) * state
        self.step, self.emb = step.astype(np.float32), np.ascontiguousarray(w["emb"].T, np.float32)
        self.bo, self.trans = w["bo"].astype(np.float32), w["trans"].astype(np.float32)
        for kind, margin in MARGINS.items():
            self.bo[1 + 2 * KINDS.index(kind)] += margin

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[n, T] character classes, longest rows first -> [n, T, tags]; a row's scores depend on its own characters only.

        Arrays have the rows last, so that every operation runs along them; both directions take a step at once, the second from each
        row's own end. What is computed behind the end of a row, beside longer ones, is not used.
        """
        n, steps = x.shape
        h, width = self.h, len(self.emb)
        live = np.searchsorted(-lengths, -np.arange(steps), "left")  # rows longer than t
        ahead = np.take(self.emb, np.ascontiguousarray(x.T), axis=1, mode="clip", out=_scratch("ahead", width, steps, n))
        even = bool(lengths[-1] == steps)
        if even:
            back = ahead[:, ::-1]
        else:
            ends_first = np.take_along_axis(x, np.maximum(lengths[:, None] - 1 - np.arange(steps), 0), 1)
            back = np.take(self.emb, np.ascontiguousarray(ends_first.T), axis=1, mode="clip", out=_scratch("back", width, steps, n))
        out = _scratch("out", 2, steps, TAGS, n)
        whole = [_scratch(name, 2, k, n) for name, k in (("given", h + width + 1), ("made", 4 * h + TAGS), ("squash", 4 * h), ("cell", h), ("now", h), ("small", h))]
        whole[0][:, :h], whole[0][:, -1], whole[3][:] = 0.0, 1.0, 0.0
        size = 0
        for t in range(steps + 1):
            need = int(live[max(t - 1, 0)])  # rows with a score of the step before
            if not t or need <= size - 64:
                size = need
                given, made, scratch, cell, now, small = (a[:, :, :size] for a in whole)
                state, gates, three = given[:, :h], made[:, : 4 * h], made[:, : 3 * h]
                enter, forget, leave, new = (made[:, i * h : (i + 1) * h] for i in range(4))
            if t < steps:
                given[0, h:-1], given[1, h:-1] = ahead[:, t, :size], back[:, t, :size]
            np.matmul(self.step, given, out=made)
            if t:
                out[:, t - 1, :, :size] = made[:, 4 * h :]
            if t == steps:
                break
            squash(gates, scratch)
            three += KAPPA
            cell *= forget
            np.multiply(enter, new, out=small)
            cell += small
            cell *= 1 / (2 * KAPPA)
            np.multiply(cell, 1 / (KAPPA * ROOT), out=now)
            squash(now, small)
            np.multiply(now, leave, out=state)
        if even:
            out[0] += out[1, ::-1]
            out[0] += self.bo[:, None]
            return np.ascontiguousarray(out[0].transpose(2, 0, 1))
        first, second = (np.ascontiguousarray(o.transpose(2, 0, 1)) for o in out)
        for r, k in enumerate(lengths.tolist()):
            first[r, :k] += second[r, :k][::-1]
            first[r, :k] += self.bo
        return first

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of texts of different lengths."""
        ends = np.cumsum([len(s) for s in scores])
        return np.split(self.paths(np.concatenate(scores), np.append(0, ends[:-1]), ends), ends[:-1])

    def paths(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tags of all positions by the Viterbi paths of the pieces from first up to last, in parts of a bounded number of cells.

        A position of two pieces must be outside of spans in both.
        """
        tags = np.zeros(len(flat), np.int64)
        order = np.argsort(first - last, kind="stable")
        start = 0
        while start < len(order):
            longest = int(last[order[start]] - first[order[start]])
            part = order[start : start + max(1, min(512, CELLS // max(1, longest)))]
            start += len(part)
            lengths = (last - first)[part]
            live = np.searchsorted(-lengths, -np.arange(longest + 1), "left").tolist()  # pieces longer than t
            # tags before pieces, so that every operation runs along the pieces
            best = _scratch("best", longest, TAGS, len(part))
            for t in range(longest):
                best[t] = np.take(flat, first[part] + t, axis=0, mode="clip").T
            ways, most = _scratch("ways", TAGS, TAGS, len(part)), _scratch("most", TAGS, len(part))
            step, outside = self.trans[:, :, None], best[0, 0].copy()
            for t in range(1, longest):
                m = live[t]
                np.add(best[t - 1, :, None, :m], step, out=ways[:, :, :m])
                np.maximum.reduce(ways[:, :, :m], axis=0, out=most[:, :m])
                outside[:m] += self.trans[0, 0]
                outside[:m] += best[t, 0, :m]
                best[t, :, :m] += most[:, :m]
            # only pieces whose best path is not the one outside of all spans are followed back
            some = np.flatnonzero(best[lengths - 1, :, np.arange(len(part))].max(1) > outside)
            best, begins, lengths = best[:, :, some], first[part[some]], lengths[some]
            live = np.searchsorted(-lengths, -np.arange(longest + 1), "left").tolist()
            at = np.zeros(len(some), np.int64)
            for t in range(live.index(0) - 1, -1, -1):
                m, n = live[t + 1], live[t]
                if m:
                    at[:m] = (best[t, :, :m] + self.trans[:, at[:m]]).argmax(0)
                if m < n:
                    at[m:n] = best[t, :, m:n].argmax(0)
                tags[begins[:n] + t] = at[:n]
        return tags


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    with np.load(WEIGHTS) as f:
        return Tagger(dict(f))


_BLEND = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def _tag_texts(pieces: list[np.ndarray], net: Tagger) -> list[np.ndarray]:
    """Tags of each text, from blended scores of the windows over all of it."""
    flat, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
    starts, sizes = [], []
    for end, piece in zip(ends.tolist(), pieces):
        begin = end - len(piece)
        some = [begin] if len(piece) <= WINDOW else [*range(begin, end - WINDOW, STRIDE), end - WINDOW]
        starts += some
        sizes += [min(len(piece), WINDOW)] * len(some)
    order = np.argsort(-np.array(sizes), kind="stable")
    start, size, step = np.array(starts)[order], np.array(sizes)[order], np.arange(WINDOW)
    weight = np.zeros(len(flat), np.float32)
    for s, n in zip(start.tolist(), size.tolist()):
        weight[s : s + n] += _BLEND[:n]
    merged = np.zeros((len(flat), TAGS), np.float32)
    for at in range(0, len(order), BLOCK):
        begins, lengths = start[at : at + BLOCK], size[at : at + BLOCK]
        here = np.minimum(begins[:, None] + step[: lengths[0]], len(flat) - 1)
        out = net.scores(flat[here], lengths)
        out *= (_BLEND[: lengths[0]] / weight[here])[:, :, None]
        for r, (s, n) in enumerate(zip(begins.tolist(), lengths.tolist())):
            merged[s : s + n] += out[r, :n]
    return _decoded(merged, ends, net)


def _plain(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Positions which the best path of a text surely leaves outside of all spans; the texts of scores may follow each other.

    A run of other tags gains over the outside at most the sum of what the best tag gains at each of its positions, with the best
    transition between tags, and the best ways in and out. Where even the run that gains most of those over a position loses, no best path has one.
    """
    over = trans - trans[0, 0]
    gains = scores[:, 1].copy()
    for j in range(2, scores.shape[1]):
        np.maximum(gains, scores[:, j], out=gains)
    gains -= scores[:, 0]
    between = float(over[1:, 1:].max())
    sums = np.concatenate([[0.0], np.cumsum(gains.astype(np.float64) + between)])
    most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])  # ends behind a position less beginnings up to it
    return most - between + max(0.0, float(over[0, 1:].max())) + max(0.0, float(over[1:, 0].max())) < -0.01


def _decoded(flat: np.ndarray, ends: np.ndarray, net: Tagger) -> list[np.ndarray]:
    """Best paths of whole texts: they are decoded in pieces between positions surely outside of spans, which gives the same paths."""
    plain = np.flatnonzero(_plain(flat, net.trans))
    cuts = plain[np.diff(plain // PIECE, prepend=-1) > 0]  # one in a stretch is enough
    flat[cuts, 1:] = -1e6
    first, last = np.concatenate([[0], ends[:-1], cuts]), np.concatenate([ends, cuts + 1])
    first.sort()
    last.sort()
    return np.split(net.paths(flat, first, last), ends[:-1])


_MAIL = re.compile(r"[\w.+-]+\s?(?:@|[(\[](?:at|AT)[)\]])\s?[\w-]+")
_FIRM = re.compile(rf"^\s*(?:&|and [{UP}]\S+ LLP|LLP|LLC|Ltd|plc|GmbH|Inc)\b")


#: Words of metrics' names, and of the periods and units beside them (fixed values).
_METRIC_WORDS = frozenset(w for alias in O.ALIASES for w in alias.split()) | frozenset("ltm ttm trailing twelve months fiscal year quarter mwh gwh kwh gj usd eur gbp mm".split())
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def _metric_words(text: str) -> bool:
    """Whether all words, if any, are words of metrics' names."""
    words = O.squeeze(text).split()
    return bool(words) and all(w in _METRIC_WORDS for w in words)


_FULL_NAME = re.compile(rf"(?:{_CAP}|[{UP}])\.?(?:[,\s]\s?(?:(?:{_PARTICLE})\s){{0,3}}(?:{_CAP}|[{UP}]\.?)){{1,5}}")


def _widened(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A span with the rest of the words, for mail of the address, at its ends, and without blanks and signs around it."""
    inside = (lambda c: c.isalnum() or c in "._+-") if kind == "email" else str.isalpha if kind == "person_name" else str.isalnum
    while a and inside(text[a - 1]) and inside(text[a]):
        a -= 1
    while b < len(text) and inside(text[b]) and inside(text[b - 1]):
        b += 1
    while a < b and text[a] in " ,;:|\n\"“”\xa0":
        a += 1
    while b > a and text[b - 1] in " ,;:|\n\"“”\xa0" or (b > a and kind == "email" and text[b - 1] in ".>"):
        b -= 1
    return a, b


def _of_form(kind: str, text: str, a: int, b: int) -> str | None:
    """The kind of a span by its form, None where it has not the form of its kind."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        return kind if _MAIL.search(span) or "@" in span else None
    longest = max(map(len, span.split()), default=0)
    if kind in ("phone", "id_number"):
        # what goes on behind a point or stands in thousands is an amount, and so are bare digits in brackets
        amount = re.match(r"[.,]\d", text[b : b + 2]) or re.fullmatch(r"[1-9]\d{0,2}(?: \d{3})+", span) and kind == "phone" or re.search(r"USD|EUR|GBP|[$€£]", span)
        if amount or span.isdigit() and text[a - 1 : a] == "(" and text[b : b + 1] == ")":
            return None
    if kind == "phone":
        if re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", span):  # nine digits as 3, 2 and 4 are no telephone number
            return "id_number"
        bare = span.isdigit() and span[0] != "0" and len(span) < 10
        return kind if 7 <= digits <= 17 and not bare and not re.search(r"[A-Za-z,]", re.sub(r"(?i)ext?\.?|x", "", span)) else None
    if kind == "id_number":
        return kind if digits >= 6 and longest <= 20 else None
    if kind == "street_address":
        first = span.split("\n")[0]
        named = re.search(rf"[{UP}][^\W\d_]{{2,}}|[Bb]ox|\brue\b", first) and not re.fullmatch(rf"(?:{_MONTHS}) \d{{4}}|\d{{1,2}} (?:{_MONTHS})(?: \d{{4}})?", first.strip())
        return kind if digits >= 1 and longest <= 25 and named and " " in first and not _metric_words(re.sub(r"[\d,.]+.*", "", span)) else None
    found = max((m[0] for m in _FULL_NAME.finditer(span)), key=len, default="")
    if digits or len(found) < 4 or found.split()[0] in _NO_NAME or _FIRM.match(text[b : b + 24]):
        return None
    # the name of a metric is no person's, nor is the last line of an address
    ending = re.search(r"(?:Street|St|Avenue|Ave|Road|Rd|Way|Close|Drive|Blvd|Lane|Court)\.?[,\n] ?$", text[max(0, a - 14) : a])
    return None if _metric_words(found) or ending else kind


def find(texts: list[str | None], net: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal data of each text."""
    net = net or tagger()
    pieces, owners = [], []
    for k, text in enumerate(texts):
        if text:
            pieces.append(codes(text))
            owners.append(k)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not pieces:
        return out
    for k, tags in zip(owners, _tag_texts(pieces, net)):
        if not tags.any():
            continue
        text = texts[k]
        kinds = np.where(tags > 0, (tags - 1) // 2, -1)
        edges = np.flatnonzero((np.diff(kinds, prepend=-1) != 0) | ((tags > 0) & (tags % 2 == 1)))
        for e, start in enumerate(edges):
            if kinds[start] < 0:
                continue
            end = start
            while end < len(kinds) and kinds[end] == kinds[start] and (end == start or tags[end] % 2 == 0):
                end += 1
            kind = KINDS[kinds[start]]
            first, last = _widened(kind, text, int(start), int(end))
            if out[k] and first < out[k][-1][1]:
                first = out[k][-1][1]
            kind = _of_form(kind, text, first, last)
            if kind:
                out[k].append((first, last, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with placeholders in place of the spans."""
    for a, b, kind in reversed(spans):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


def records(doc_chunks: DataFrame, evidence_chunks: DataFrame, financial_evidence: DataFrame) -> DataFrame:
    """The three fields as (tbl, row_key, text)."""
    return (
        doc_chunks.select(F.lit("doc_chunks").alias("tbl"), F.col("chunk_key").alias("row_key"), "text")
        .unionByName(evidence_chunks.select(F.lit("evidence_chunks").alias("tbl"), F.col("evidence_key").alias("row_key"), F.col("quote").alias("text")))
        .unionByName(financial_evidence.select(F.lit("financial_evidence").alias("tbl"), F.col("evidence_id").alias("row_key"), F.col("source_quote").alias("text")))
    )


def _redacted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        # groups of rows with about GROUP characters, one row at least
        group = pdf["text"].str.len().cumsum().to_numpy() // GROUP
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(pdf)]
        for start, end in zip(edges, edges[1:]):
            part = pdf.iloc[start:end]
            rows = []
            for tbl, key, text, spans in zip(part["tbl"], part["row_key"], part["text"], find(list(part["text"]))):
                if spans:
                    rows.append((tbl, key, sorted({k for _, _, k in spans}), len(spans), masked(text, spans)))
            yield pd.DataFrame(rows, columns=["tbl", "row_key", "kinds", "n_spans", "redacted"])


def redact(rows: DataFrame) -> DataFrame:
    """Rows with personal data: tbl, row_key, kinds, n_spans, redacted text. rows: tbl, row_key, text."""
    return spread(rows.filter(F.length("text") > 0)).mapInPandas(_redacted, "tbl string, row_key bigint, kinds array<string>, n_spans int, redacted string")
