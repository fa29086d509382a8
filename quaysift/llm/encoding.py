"""Texts garbled by a wrong character encoding: find them and restore the original.

Method: best-first search over texts. A state is a text; an edge encodes it in the encoding it was wrongly
decoded with and decodes it in the one it was written in, or undoes an escape. Visited states are hashed. A
character-plausibility cost (see ``cost``) guides the search, and the cheapest text reached is the restoration.

The search runs on single words with characters beyond ASCII, or with escapes (entities, backslash-u, percent) of such
characters, since a text may be garbled in places only; what a word
alone does not decide is searched again as a run of neighbouring words, and the conversions found in a text are
offered to its remaining words. Words are cached with their digits normalised.

A record counts as garbled if a conversion makes it more plausible by a clear margin, or if it holds what only
wrong decoding leaves behind (replacement characters, C1 controls). Unusual but correct characters, look-alike
letters of another script and invisible characters are no case.

Defined cases: null texts and texts in ASCII without such escapes come out as not garbled and unchanged; an escape of a
correct character is no garbling and stays; text of any length is
searched whole; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysift.session import spread

#: Encodings which texts were wrongly decoded with, and those they are written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "cp852", "iso8859_15", "cp1254", "mac_cyrillic", "cp1253", "cp1257")
RIGHT = ("utf-8", "cp1252", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "mac_roman", "cp850", "cp437", "cp852")
#: Letters of the Cyrillic and Greek scripts that look like Latin ones.
LOOKALIKES = frozenset("аеорсухіјѕԁһкмтвнАВЕКМНОРСТУХІЈЅοΟνυΑΒΕΖΗΙΚΜΝΡΤΥΧ")
#: Signs that stand in ordinary text, alone or beside digits.
SIGNS = frozenset("€£¥’‘“”„«»–—…•§¶°±²³×÷½¼¾µ·¿¡√≤≥≈→←™®©ºª‰†‡≠∞−′″¢")
INVISIBLE = frozenset("​‌‍⁠﻿­‎‏")
_RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_EUROPEAN = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœąćęłńśźżčďěňřšťůžőűăâîșțğışđ")
#: Improvement from which a conversion counts, and cost above which a word is looked into.
MARGIN, SUSPECT = 1.9, 1.0
WORD = re.compile(r"[^ \n\r\t]*[^\x00-\x7f \n\r\t][^ \n\r\t]*")

#: One escape as a whole: an entity with its semicolon, a code unit, or percent bytes.
ESCAPE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|\\u[0-9a-fA-F]{4}|(?:%[0-9A-Fa-f]{2})+")
ESCAPED_WORD = re.compile(rf"[^ \n\r\t]*?(?:{ESCAPE.pattern})[^ \n\r\t]*")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes which it leaves undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


def convert(text: str, wrong: str, right: str) -> str | None:
    """The text if it had been decoded with the other encoding; None where that is impossible."""
    table = _bytes_of(wrong)
    try:
        return bytes([table[c] for c in text]).decode(right)
    except (KeyError, UnicodeDecodeError):
        return None


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFB00 <= o < 0xFB07:
        return "l"
    if 0x400 <= o < 0x530:
        return "c"
    if 0x370 <= o < 0x400:
        return "g"
    return "o"


def _odd(c: str) -> bool:
    """A sign beyond ASCII which is no apostrophe, quotation mark or dash."""
    return ord(c) > 127 and not c.isalpha() and c not in INVISIBLE and c not in "’‘“”„«»…–—"


def _word_cost(word: str) -> float:
    """Cost of one stretch of letters and signs without ASCII blanks."""
    n, total = len(word), 0.0
    letters = [c for c in word if c.isalpha() and c not in "ªº"]
    scripts = [_script(c) for c in letters]
    latin, cyrillic, greek = scripts.count("l"), scripts.count("c"), scripts.count("g")
    accented = sum(1 for c, s in zip(letters, scripts) if s == "l" and ord(c) > 127)
    dense = accented >= 3 and accented > 0.6 * latin or accented == 2 and latin == 2
    shouted = sum(1 for c in letters if c.isupper()) == len(letters)
    for i, c in enumerate(word):
        o = ord(c)
        if o < 128:
            continue
        before, after = word[i - 1] if i else " ", word[i + 1] if i + 1 < n else " "
        beside = _odd(before) + _odd(after)
        if o == 0xFFFD or 0x80 <= o < 0xA0:
            total += 6.0
        elif c in INVISIBLE or c == " ":
            total += 0.0 if not (before.isalpha() and ord(before) > 127 and before.isupper()) else 1.0
        elif 0x2500 <= o < 0x25A0:
            total += 3.0
        elif c.isalpha() and c not in "ªºµ":
            s = _script(c)
            if s == "l":
                total += 0.05 if c.lower() in _EUROPEAN else 2.5
                total += 1.0 if dense else 0.0
                if beside and c.lower() in "ãâåäðñî" and not (before + after).isspace():
                    total += 1.0
                if cyrillic > latin:
                    total += 2.0
            elif s == "c":
                if latin and cyrillic <= latin:
                    total += 0.2 if c in LOOKALIKES and not beside else 3.0
                else:
                    total += (0.05 if c in _RUSSIAN else 1.5) + (0.4 if shouted and len(letters) > 1 else 0.0)
            elif s == "g":
                total += 0.1 if greek == len(letters) and greek > 2 else 0.5 if greek == len(letters) else 0.2 if c in LOOKALIKES and not beside else 3.0
            else:
                total += 0.3 if unicodedata.category(c) in ("Lo", "Lm") and not latin else 3.0
            if c.isupper() and before.isalpha() and before.islower():
                total += 2.5
            if beside:
                total += 0.8
        else:
            inner = before.isalpha() and after.isalpha()
            if c in "’‘-–—·":
                total += 0.1
            elif c in SIGNS:
                total += 3.0 if inner and c not in "«»“”„" else 0.15
                total += 1.5 if c in "¡¿³²¼½¾ªº" and before.isalpha() and before.lower() not in "mk" else 0.0
            else:
                total += 3.0 if inner else 1.5
            if beside or (before.isalpha() and ord(before) > 127 and c not in "’”“»…–—"):
                total += 1.0
    return total


@lru_cache(maxsize=400_000)
def cost(text: str) -> float:
    """Implausibility of a text: nothing for ASCII, little for letters and signs where they belong, much for controls,
    frames, signs within words, mixed scripts and capitals after small letters."""
    return sum(_word_cost(w) for w in re.split(r"[ \n\r\t]+", text) if not w.isascii())


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")
_UESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _edges(text: str, single_byte: bool) -> Iterator[tuple[str, str]]:
    for wrong in WRONG:
        for right in RIGHT if single_byte else RIGHT[:1]:
            if wrong == right:
                continue
            out = convert(text, wrong, right)
            if out is not None and out != text and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", out):
                yield out, f"{wrong}>{right}"
    if "&" in text and (out := html.unescape(text)) != text:
        yield out, "unescape"
    if "\\u" in text and (out := _UESCAPE.sub(lambda m: chr(int(m[1], 16)), text)) != text:
        yield out, "unescape"
    if "%" in text and (out := _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)) != text:
        yield out, "unescape"


@lru_cache(maxsize=400_000)
def search(text: str, single_byte: bool = True, expansions: int = 24) -> tuple[str, tuple[str, ...]]:
    """(cheapest text reachable, conversions on the way). Each conversion costs a little, so that none is made for nothing."""
    start = cost(text)
    best, seen = (start, text, ()), {hash(text)}
    queue: list[tuple[float, int, str, tuple[str, ...]]] = [(start, 0, text, ())]
    while queue and expansions:
        at, depth, state, path = heapq.heappop(queue)
        expansions -= 1
        if at < best[0]:
            best = (at, state, path)
        if depth >= 4:
            continue
        for out, op in _edges(state, single_byte):
            key = hash(out)
            if key in seen:
                continue
            seen.add(key)
            # UTF-8 sequences hardly arise by chance; between single-byte encodings anything converts
            step = 0.05 if op.endswith(">utf-8") else 0.9 if op != "unescape" else 0.3
            total = cost(out) + (at - cost(state) if path else 0.0) + step
            if total < start + 3.0:
                heapq.heappush(queue, (total, depth + 1, out, (*path, op)))
    return best[1], best[2]


@lru_cache(maxsize=400_000)
def _restored_word(word: str) -> tuple[str, tuple[str, ...]]:
    out, path = search(word, False)
    if path and cost(word) - cost(out) > 0.5 and any(op != "unescape" for op in path):
        return out, path
    if cost(word) >= SUSPECT:
        out, path = search(word, True)
        if path and cost(word) - cost(out) >= MARGIN + min(_dense(word), 5) and any(op != "unescape" for op in path):
            return out, path
    return word, ()


def _dense(word: str) -> int:
    """Number of accented letters of a word that has hardly any others: some languages have such words, so alone they prove little."""
    latin = [c for c in word if c.isalpha() and _script(c) == "l"]
    accented = sum(ord(c) > 127 for c in latin)
    return accented if accented > 0.6 * len(latin) else 0


def _one_escape(m: re.Match) -> str:
    given = m[0]
    if given[0] == "&":
        return html.unescape(given)
    return chr(int(given[2:], 16)) if given[0] == "\\" else bytes.fromhex(given.replace("%", "")).decode("utf-8", "replace")


def plain_of(word: str) -> str:
    """The word without its escapes, also escaped ones."""
    while (out := ESCAPE.sub(_one_escape, word)) != word:
        word = out
    return word


def _escaped_words(text: str) -> dict[str, str]:
    """Words in ASCII that are escapes of others -> those."""
    if not ESCAPE.search(text):
        return {}
    words = {w: plain_of(w) for w in dict.fromkeys(ESCAPED_WORD.findall(text)) if w.isascii()}
    return {w: p for w, p in words.items() if not p.isascii()}


def _normal(word: str) -> str:
    return re.sub(r"\d+", "0", word)


def restore(text: str | None) -> tuple[str | None, bool, bool, list[str]]:
    """(text restored as far as possible, garbled, wholly restored, conversions)."""
    if text is None:
        return text, False, True, []
    escaped = _escaped_words(text)
    if text.isascii() and not escaped:
        return text, False, True, []
    paths: dict[tuple[str, ...], int] = {}
    changes: dict[str, str] = {}
    left: list[str] = []
    for word in dict.fromkeys(WORD.findall(text)):
        core = _normal(word)
        if (core.count("0") and cost(core) < 0.5) or cost(core) < 0.35:
            left.append(word)
            continue
        _, path = _restored_word(core)
        fixed = _follow(word, path) if path else word
        if fixed != word:
            changes[word] = fixed
            paths[path] = paths.get(path, 0) + 1
        else:
            left.append(word)
    for word, plain in escaped.items():
        core = _normal(plain)
        if (core.count("0") and cost(core) < 0.5) or cost(core) < 0.35:
            continue
        _, path = _restored_word(core)
        fixed = _follow(plain, path) if path else plain
        if fixed is not None and fixed != plain:
            changes[word] = fixed
            paths[("unescape", *path)] = paths.get(("unescape", *path), 0) + 1
    # runs of neighbouring words decide together, between single-byte encodings
    residue = [w for w in left if cost(_normal(w)) >= SUSPECT]
    if residue:
        for run in re.findall(r"(?:[^ \n\r\t]*[^\x00-\x7f \n\r\t][^ \n\r\t]*[ \n]?){2,12}", text):
            tokens = [w for w in run.split() if w not in changes and not w.isascii()]
            if len(tokens) < 2 or not any(cost(_normal(w)) >= SUSPECT for w in tokens):
                continue
            joined = _normal(" ".join(tokens))
            out, path = search(joined, True)
            if path and cost(joined) - cost(out) >= MARGIN and cost(out) < 0.5 * cost(joined):
                paths[path] = paths.get(path, 0) + 1
                for w in tokens:
                    if (fixed := _follow(w, path)) is not None and fixed != w and cost(fixed) <= cost(w) + 0.3:
                        changes[w] = fixed
    if paths:
        words = [w for w in dict.fromkeys(WORD.findall(text)) if w in changes or cost(_normal(w)) >= 0.04]
        known = sorted(paths, key=lambda p: -paths[p])
        if any(not op.endswith(">utf-8") and op != "unescape" for p in known for op in p):
            # one text was mostly garbled in one way: the conversion that suits all of its words goes first
            known.sort(key=lambda p: _after(words, p))
        for word in words:
            now = cost(_normal(changes.get(word, word)))
            for p in known:
                fixed = _follow(word, p)
                if fixed is not None and fixed != word and cost(_normal(fixed)) <= min(now, cost(_normal(word))) + 0.15:
                    changes[word] = fixed
                    break
        for word, plain in escaped.items():
            if word in changes or cost(_normal(plain)) < 0.04:
                continue
            for p in known:
                fixed = _follow(plain, p)
                if fixed is not None and fixed != plain and cost(_normal(fixed)) <= cost(_normal(plain)) + 0.15:
                    changes[word] = fixed
                    break
    out = WORD.sub(lambda m: changes.get(m[0], m[0]), text) if changes else text
    if escaped and changes:
        out = ESCAPED_WORD.sub(lambda m: changes.get(m[0], m[0]), out)
    broken = any(c == "�" or "\x80" <= c < "\xa0" for c in out)
    garbled = bool(paths) or any(c == "�" or "\x80" <= c < "\xa0" for c in text)
    whole = not broken and all(cost(_normal(w)) < SUSPECT for w in WORD.findall(out)) if garbled else True
    return out, garbled, whole, sorted({">".join(p) if len(p) == 1 else " then ".join(p) for p in paths})


def _after(words: list[str], path: tuple[str, ...]) -> float:
    """Cost of a text's words if all which can be are converted along the path."""
    total = 0.0
    for w in words:
        fixed = _follow(w, path)
        total += cost(_normal(w)) + 0.5 if fixed is None else min(cost(_normal(w)) + 0.5, cost(_normal(fixed)))
    return total


def _follow(word: str, path: tuple[str, ...]) -> str | None:
    for op in path:
        if op == "unescape":
            word = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), _UESCAPE.sub(lambda m: chr(int(m[1], 16)), html.unescape(word)))
            continue
        out = convert(word, *op.split(">"))
        if out is None:
            return None
        word = out
    return word


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for key, text in zip(pdf["key"], pdf["text"]):
            out, garbled, whole, ops = restore(text)
            if garbled:
                rows.append((key, out, whole, ops))
        yield pd.DataFrame(rows, columns=["key", "restored", "whole", "conversions"])


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """The garbled rows: key, restored text, whether all of it could be restored, and the conversions found."""
    beyond = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(rf"[^\x00-\x7f]|{ESCAPE.pattern}"))
    out = spread(beyond).mapInPandas(_repaired, "key bigint, restored string, whole boolean, conversions array<string>")
    return out.withColumnRenamed("key", key)
