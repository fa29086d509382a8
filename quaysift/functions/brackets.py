"""Texts put in brackets within a narrative, one after the other, in a time that is next to linear in its length.

All is seen over the narrative's skeleton, which is what is left of it without brackets: a gap before each of its characters and one
at its end hold the brackets, given or put there. A text is where its skeleton is and where the gaps within hold what it has there.
"""

from __future__ import annotations

import re

import numpy as np

_RUN = re.compile(r"[\[\]]+")
_SMALL = 1_000_000


def _parts(text: str) -> tuple[str, dict[int, str]]:
    """The text without brackets, and the brackets by gap."""
    gaps, gone = {}, 0
    for m in _RUN.finditer(text):
        gaps[m.start() - gone] = m[0]
        gone += len(m[0])
    return (_RUN.sub("", text) if gaps else text), gaps


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def places(body: str, needles: list[str]) -> dict[str, np.ndarray]:
    """Where each needle (distinct, not empty) is in the body, in order; overlapping places too.

    Fingerprints of all stretches of 1, 2, 4, ... characters come from those of half the size; a needle is known by those of its
    beginning and its end, which together cover it. Each place is then compared with the needle itself.
    """
    out = {t: np.zeros(0, np.int64) for t in needles}
    if len(body) * len(needles) <= _SMALL:
        for t in needles:
            found, at = [], body.find(t)
            while at >= 0:
                found.append(at)
                at = body.find(t, at + 1)
            out[t] = np.array(found, np.int64)
        return out
    needles = [t for t in needles if len(t) <= len(body)]
    if not needles:
        return out
    sizes = np.array([len(t) for t in needles])
    begins = len(body) + np.cumsum(sizes) - sizes
    prints = np.frombuffer("".join([body, *needles]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = 1
    while True:
        here = np.flatnonzero((sizes >= size) & (sizes < 2 * size))
        if len(here):
            seeds = np.unique(prints[begins[here]])
            near = []
            for a in range(0, len(body) - size + 1, 1 << 20):
                part = prints[a : min(a + (1 << 20), len(body) - size + 1)]
                near.append(a + np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, part), len(seeds) - 1)] == part))
            spots = np.concatenate(near)
            for n in np.unique(sizes[here]):
                own = here[sizes[here] == n]
                keys = _mixed(prints[begins[own]], prints[begins[own] + n - size])
                fit = spots[spots <= len(body) - n]
                there = _mixed(prints[fit], prints[fit + n - size])
                known = np.isin(there, keys)
                fit, there = fit[known], there[known]
                order = np.argsort(there, kind="stable")
                fit, there = fit[order], there[order]
                for k, lo, hi in zip(own, np.searchsorted(there, keys, "left"), np.searchsorted(there, keys, "right")):
                    out[needles[k]] = np.array([p for p in fit[lo:hi].tolist() if body.startswith(needles[k], p)], np.int64)
        if int(sizes.max()) < 2 * size:
            return out
        prints = _mixed(prints[:-size], prints[size:])
        size *= 2


class _Text:
    """A text by its skeleton and the brackets before, within and behind it."""

    def __init__(self, text: str):
        self.body, gaps = _parts(text)
        self.size = len(self.body)
        self.before = gaps.pop(0, "") if self.size else text
        self.behind = gaps.pop(self.size, "") if self.size else ""
        self.within = gaps if self.size else {}
        self.next = 0  # of its places, the first that isn't parted yet


class _Content:
    def __init__(self, narrative: str):
        self.body, self.gaps = _parts(narrative)
        self.marks = bytearray(len(self.body) + 1)  # gaps that hold brackets
        for g in self.gaps:
            self.marks[g] = 1

    def put(self, gap: int, brackets: str) -> None:
        self.gaps[gap], self.marks[gap] = brackets, 1

    def held(self, start: int, stop: int) -> list[int]:
        """The gaps from start to before stop that hold brackets."""
        found, g = [], self.marks.find(1, start, stop)
        while g >= 0:
            found.append(g)
            g = self.marks.find(1, g + 1, stop)
        return found

    def fits(self, t: _Text, p: int, before: str, behind: str) -> bool:
        if before and not self.gaps.get(p, "").endswith(before) or behind and not self.gaps.get(p + t.size, "").startswith(behind):
            return False
        if not t.within:
            return self.marks.find(1, p + 1, p + t.size) < 0
        return {g - p: self.gaps[g] for g in self.held(p + 1, p + t.size)} == t.within

    def first(self, t: _Text, spots: np.ndarray) -> int:
        """The place of the text's first occurrence, -1 where there is none."""
        if t.before or t.behind or t.within:
            return next((p for p in spots.tolist() if self.fits(t, p, t.before, t.behind)), -1)
        while t.next < len(spots):
            p = int(spots[t.next])
            cut = self.marks.rfind(1, p + 1, p + t.size)
            if cut < 0:
                return p
            t.next = int(np.searchsorted(spots, cut))  # brackets stay, so what they part is parted for good
        return -1

    def bracket(self, t: _Text, spots: np.ndarray) -> None:
        if t.size:
            p = self.first(t, spots)
            if p >= 0:
                held, after = self.gaps.get(p, ""), self.gaps.get(p + t.size, "")
                at = len(held) - len(t.before)
                self.put(p, held[:at] + "[" + held[at:])
                self.put(p + t.size, after[: len(t.behind)] + "]" + after[len(t.behind) :])
        elif t.before:
            g = next((g for g in self.held(0, len(self.marks)) if t.before in self.gaps[g]), None)
            if g is not None:
                self.put(g, self.gaps[g].replace(t.before, f"[{t.before}]", 1))

    def has_bracketed(self, t: _Text, spots: np.ndarray) -> bool:
        if not t.size:
            return any(f"[{t.before}]" in held for held in self.gaps.values())
        marks = np.frombuffer(self.marks, np.uint8)
        likely = spots[(marks[spots] > 0) & (marks[spots + t.size] > 0)]
        return any(self.fits(t, p, "[" + t.before, t.behind + "]") for p in likely.tolist())

    def text(self) -> str:
        out, at = [], 0
        for g in sorted(self.gaps):
            out += [self.body[at:g], self.gaps[g]]
            at = g
        return "".join([*out, self.body[at:]])


def bracket(narrative: str, texts: list[str], most: int = 5) -> tuple[str, list[str]]:
    """The narrative with the first occurrence of each text in brackets, text after text, and the first texts that it then doesn't hold in brackets."""
    content, known = _Content(narrative), {t: _Text(t) for t in dict.fromkeys(texts)}
    spots = places(content.body, list(dict.fromkeys(t.body for t in known.values() if t.size)))
    none = np.zeros(0, np.int64)
    for text in texts:
        content.bracket(t := known[text], spots.get(t.body, none))
    missing: list[str] = []
    there: dict[str, bool] = {}
    for text in texts:
        if text not in there:
            there[text] = content.has_bracketed(t := known[text], spots.get(t.body, none))
        if not there[text]:
            missing.append(text)
            if len(missing) == most:
                break
    return content.text(), missing
