"""Numbers and units as records state them: plain functions over single strings, exact arithmetic."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

#: Exact international definitions, kind of quantity -> unit -> amount in the common unit.
UNITS: dict[str, dict[str, Fraction]] = {
    "money": {"one": Fraction(1), "thousand": Fraction(1000), "million": Fraction(10**6), "billion": Fraction(10**9), "trillion": Fraction(10**12)},
    "count": {"one": Fraction(1), "thousand": Fraction(1000), "million": Fraction(10**6), "billion": Fraction(10**9)},
    "rate": {"basis point": Fraction(1), "percent": Fraction(100), "per mille": Fraction(10), "fraction": Fraction(10000)},
    "area": {
        "m2": Fraction(1), "ft2": Fraction("0.09290304"), "yd2": Fraction("0.83612736"), "acre": Fraction("4046.8564224"),
        "ha": Fraction(10000), "km2": Fraction(10**6), "mi2": Fraction("2589988.110336"), "cm2": Fraction("0.0001"),
    },
    "mass": {
        "kg": Fraction(1), "g": Fraction("0.001"), "mg": Fraction("0.000001"), "lb": Fraction("0.45359237"), "oz": Fraction("0.028349523125"),
        "short ton": Fraction("907.18474"), "long ton": Fraction("1016.0469088"), "tonne": Fraction(1000), "kilotonne": Fraction(10**6), "quintal": Fraction(100),
    },
    "energy": {
        "kwh": Fraction(1), "wh": Fraction(1, 1000), "mwh": Fraction(1000), "gwh": Fraction(10**6), "twh": Fraction(10**9), "gj": Fraction(2500, 9),
        "mj": Fraction(5, 18), "tj": Fraction(2500000, 9), "kj": Fraction(1, 3600), "therm": Fraction("105505585.262") / 3600000, "mmbtu": Fraction("1055055852.62") / 3600000,
    },
    "volume": {
        "l": Fraction(1), "ml": Fraction(1, 1000), "cl": Fraction(1, 100), "hl": Fraction(100), "m3": Fraction(1000), "us gal": Fraction("3.785411784"),
        "imperial gal": Fraction("4.54609"), "us barrel": Fraction("158.987294928"), "ft3": Fraction("28.316846592"), "megalitre": Fraction(10**6),
    },
}
COMMON = {"money": "one", "count": "one", "rate": "basis point", "area": "m2", "mass": "kg", "energy": "kwh", "volume": "l"}

#: How texts write the units; the first that matches counts, so that longer names stand first.
_MARKS: dict[str, tuple[tuple[str, str], ...]] = {
    "scale": (
        ("trillion", r"trillions?|\btn\b|\btrn\b"),
        ("billion", r"billions?|\bbn\b|bn\b|\bmrd\b|milliards?|nine zeros omitted|(?<=\d)\s?b\b|[$€£]\s?b\b"),
        ("million", r"millions?|\bmm\b|\bmn\b|\bmio\b|\bmln\b|six zeros omitted|musd|usd\s?m\b|(?<=\d)\s?mm\b|(?<=\d)\s?mn\b|(?<=\d)\s?m\b|[$€£]\s?mm?\b"),
        ("thousand", r"thousands?|['’]000|\b000s?\b|usd000|three zeros omitted|kusd|usd\s?k\b|\btsd\b|(?<=\d)\s?k\b|[$€£]\s?k\b|[$€£]\s?000"),
    ),
    "rate": (
        ("basis point", r"basis[\s-]?points?|\bbps?\b|(?<=\d)bps?\b"),
        ("per mille", r"‰|per mille|permille"),
        ("percent", r"%|\bper\s?cent\b|\bpercentage\b|(?<=\d)percent\b|\bpct\b|(?<=\d)pct\b"),
        ("fraction", r"fractions?|\bratios?\b|of one\b|as a decimal"),
    ),
    "area": (
        ("ft2", r"square\s?(?:feet|foot)|\bsq\.?\s?\.?(?:ft|feet|foot)\b|sqft|ft²|\bft2\b|(?<=\d)\s?sf\b|\bsf\b"),
        ("yd2", r"square\s?yards?|\bsq\.?\s?yds?\b|yd²"),
        ("km2", r"square\s?kilomet(?:re|er)s?|km²|\bkm2\b|\bsq\.?\s?km\b"),
        ("mi2", r"square\s?miles?|\bsq\.?\s?mi\b"),
        ("cm2", r"cm²|\bcm2\b"),
        ("acre", r"\bacres?\b|(?<=\d)\s?ac\b|\bac\b"),
        ("ha", r"hectares?|(?<=\d)\s?ha\b|\bha\b"),
        ("m2", r"square\s?met(?:re|er)s?|m²|\bm2\b|\bsqm\b|(?<=\d)sqm\b|\bsq\.?\s?m\b"),
    ),
    "mass": (
        ("short ton", r"short\s?tons?|us tons?"),
        ("long ton", r"long\s?tons?"),
        ("kilotonne", r"kilotonnes?|\bkt\b"),
        ("tonne", r"metric\s?tons?|tonnes?|(?<=\d)\s?t\b|\bt\b|\bmt\b"),
        ("lb", r"\blbs?\b|(?<=\d)lbs?\b|pounds?"),
        ("oz", r"\boz\b|ounces?"),
        ("quintal", r"quintals?"),
        ("kg", r"\bkgs?\b|(?<=\d)kgs?\b|kilograms?|kilogrammes?|\bkilos?\b"),
        ("mg", r"\bmg\b|milligrams?"),
        ("g", r"\bgrams?\b|(?<=\d)\s?g\b"),
    ),
    "energy": (
        ("twh", r"\btwh\b|(?<=\d)twh\b|terawatt[\s-]?hours?"),
        ("gwh", r"\bgwh\b|(?<=\d)gwh\b|gigawatt[\s-]?hours?"),
        ("mwh", r"\bmwh\b|(?<=\d)mwh\b|megawatt[\s-]?hours?"),
        ("kwh", r"\bkwh\b|(?<=\d)kwh\b|kilowatt[\s-]?hours?"),
        ("tj", r"\btj\b|(?<=\d)tj\b|terajoules?"),
        ("gj", r"\bgj\b|(?<=\d)gj\b|gigajoules?"),
        ("mj", r"\bmj\b|(?<=\d)mj\b|megajoules?"),
        ("kj", r"\bkj\b|(?<=\d)kj\b|kilojoules?"),
        ("mmbtu", r"\bmmbtu\b"),
        ("therm", r"\btherms?\b"),
        ("wh", r"\bwh\b|\bwatt[\s-]?hours?"),
    ),
    "volume": (
        ("hl", r"\bhl\b|(?<=\d)hl\b|hectolit(?:re|er)s?"),
        ("megalitre", r"megalit(?:re|er)s?"),
        ("ml", r"\bml\b|(?<=\d)ml\b|millilit(?:re|er)s?"),
        ("cl", r"\bcl\b|(?<=\d)cl\b|centilit(?:re|er)s?"),
        ("imperial gal", r"(?:imp(?:erial)?|uk)\.?\s?gal(?:lon)?s?\b|gallons?\s?\((?:imp(?:erial)?|uk)\)"),
        ("us gal", r"\bgal(?:lon)?s?\b|(?<=\d)gal\b"),
        ("us barrel", r"\bbbls?\b|\bbarrels?\b"),
        ("m3", r"cubic\s?met(?:re|er)s?|m³|\bm3\b|\bcbm\b"),
        ("ft3", r"cubic\s?(?:feet|foot)|ft³|\bft3\b"),
        ("l", r"lit(?:re|er)s?|(?<=\d)\s?l\b|\bl\b"),
    ),
}
_COMPILED = {kind: tuple((unit, re.compile(p, re.I)) for unit, p in marks) for kind, marks in _MARKS.items()}
_CURRENCY = re.compile(r"[$€£¥]|\busd\b|usd|\bdollars?\b|\beur\b|\bgbp\b|\bcents?\b", re.I)

# Number words.
_ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_POWERS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_BLANKS = "    "


def words_to_number(text: str) -> Fraction | None:
    """'minus two hundred and six point five million' -> -206500000; None where another word stands between."""
    tokens = re.findall(r"[a-z]+", text.lower())
    total, group, digits, sign, seen = Fraction(0), Fraction(0), None, 1, False
    for t in tokens:
        if t in ("minus", "negative") and not seen:
            sign = -1
        elif t == "point" and seen:
            digits = 0
        elif t in _ONES:
            seen = True
            if digits is None:
                group += _ONES[t]
            elif _ONES[t] < 10:
                digits += 1
                group += Fraction(_ONES[t], 10**digits)
            else:
                return None
        elif t in _TENS and digits is None:
            group, seen = group + _TENS[t], True
        elif t == "hundred" and seen:
            group *= 100
        elif t in _POWERS and seen:
            total, group, digits = total + group * _POWERS[t], Fraction(0), None
        elif t not in ("and", "a", "dollars", "dollar", "us", "usd"):
            return None
    return sign * (total + group) if seen else None


_NUMBER = re.compile(r"\d+(?:[\d.,'’ _" + _BLANKS + r"]*\d)?(?:e[+-]?\d+)?", re.I)


def _plain(digits: str) -> Fraction | None:
    """Digits with grouping marks; a single mark followed by three digits groups, the last of two kinds is the point."""
    s = re.sub(r"[ '’_" + _BLANKS + "]", "", digits)
    power = re.search(r"e([+-]?\d+)$", s, re.I)
    exponent, s = (int(power[1]), s[: power.start()]) if power else (0, s)
    if abs(exponent) > 30:
        return None
    commas, dots = s.count(","), s.count(".")
    if commas and dots:
        point = max(s.rfind(","), s.rfind("."))
        s = re.sub(r"[.,]", "", s[:point]) + "." + s[point + 1 :]
    elif commas:
        s = s.replace(",", "") if commas > 1 or len(s) - s.rfind(",") == 4 else s.replace(",", ".")
    elif dots > 1:
        s = s.replace(".", "")
    try:
        return Fraction(s) * Fraction(10) ** exponent
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def parse_number(text: str | None) -> tuple[Fraction, str] | None:
    """(number as written, rest of the text with the number replaced by 0), None where the text is no number.

    Number words come back in single pieces with the rest 'words'. Parentheses around the whole and a leading
    minus negate. A text with two separate numbers is none.
    """
    if text is None:
        return None
    s = text.strip().replace("−", "-").replace("–", "-")
    if not s:
        return None
    negative = False
    wrapped = re.fullmatch(r"([$€£a-z\s]*)\((.*)\)([\sa-z%$€£]*)", s, re.I | re.S)
    if wrapped and re.search(r"\d|[a-z]{3}", wrapped[2], re.I) and not re.fullmatch(r"\s*[a-z]+\s*", wrapped[2], re.I):
        negative, s = True, f"{wrapped[1]} {wrapped[2]} {wrapped[3]}".strip()
    s = re.sub(r"gallons?\s?\(us\)", "us gal", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])[²2](?![\d])", "²", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])[³3](?![\d])", "³", s, flags=re.I)
    found = _NUMBER.findall(s)
    if not found:
        number = words_to_number(s)
        return None if number is None else (-number if negative else number, "words")
    if len(found) > 1:
        return None
    number = _plain(found[0])
    if number is None:
        return None
    at = s.index(found[0])
    before, after = s[:at], s[at + len(found[0]) :]
    if re.search(r"[a-z]{4,}", before, re.I) and not _CURRENCY.search(before):
        return None
    if re.search(r"-\s*[$€£a-z\s]*$", before, re.I):
        negative = not negative
    return -number if negative else number, f"{before}0{after}"


@lru_cache(maxsize=200_000)
def unit_in(text: str | None, kind: str, money_only_scale: bool = False) -> str | None:
    """The unit of this kind which a text states, None where it states none.

    A scale beside a currency sign says nothing about counts; with money_only_scale a bare scale doesn't either.
    """
    if not text:
        return None
    s = re.sub(r"[_" + _BLANKS + r"]", " ", text)
    if kind in ("money", "count"):
        if kind == "count" and (money_only_scale or _CURRENCY.search(s)):
            return None
        marks = _COMPILED["scale"]
    else:
        marks = _COMPILED[kind]
    for unit, pattern in marks:
        if pattern.search(s):
            return unit
    return None


_HEADER = re.compile(r"(?:\ball (?:figures|amounts|values|numbers)\s+(?:are\s+)?|\btable\s+)([^.|\n]{1,40}?)\s*(?:[.|\n]|$)", re.I)
_BRACKET = re.compile(r"[\(\[]([^()\[\]\n]{1,60})[\)\]]")
_BEHIND = re.compile(r"\s?(%|‰|['’]000\b|[^\W\d_][\w²³.-]*(?: (?!\w+ \w+ \w)[^\W\d_]+){0,2})")


def _places(value: str | None, quote: str) -> list[tuple[int, int]]:
    """(start, end) of a value in a quotation, as a number of its own."""
    v, out, start = (value or "").strip(), [], 0
    while v and (at := quote.find(v, start)) >= 0:
        start = at + len(v)
        inside = re.search(r"\d[.,' ]?$", quote[:at][-2:]) if v[:1].isdigit() else None
        if not inside and not re.match(r"[.,']?\d", quote[start : start + 2]):
            out.append((at, start))
    return out


@lru_cache(maxsize=200_000)
def units_in_quote(quote: str | None, value: str | None, metric_name: str | None, kind: str) -> tuple[tuple[str, bool], ...]:
    """(unit, tied) for every unit of the kind that a quotation states.

    A unit is tied to the figure if it stands in a header over all figures, in brackets between the metric's name or
    the beginning of the clause and the figure, or directly behind the figure, with or without brackets; any other
    mention is loose (it may belong to another figure, or to the same figure in other words).
    """
    if not quote:
        return ()
    tied: list[str] = []
    for header in _HEADER.findall(quote):
        tied.append(unit_in(header, kind) or "")
    brackets = [(m.start(), m.end(), unit_in(m[1], kind)) for m in _BRACKET.finditer(quote)]
    for at, end in _places(value, quote):
        clause = max(quote.rfind("\n", 0, at), max((m.end() for m in re.finditer(r"[.!?;]\s", quote[:at])), default=0))
        tied += [unit or "" for a, b, unit in brackets if (clause <= a < at and not re.search(r"\d[\d.,]*\s*$", quote[clause:a])) or re.fullmatch(r"\s*", quote[end:a] if a >= end else "x")]
        behind = _BEHIND.match(quote, end)
        if behind:
            tied.append(unit_in(f"0 {behind[1]}" if behind[1][0] != "%" else f"0{behind[1]}", kind) or "")
    name = (metric_name or "").strip()
    at = quote.find(name) if name else -1
    if at >= 0:
        tied += [unit or "" for a, _, unit in brackets if a >= at + len(name) and not quote[at + len(name) : a].strip()]
    bare = re.sub(r"(?<=\d)[\d.,'’]*\d", "", quote)  # grouped thousands are no mark
    out = dict.fromkeys(((unit, True) for unit in tied if unit))
    loose = [unit for unit, pattern in (_COMPILED["scale"] if kind in ("money", "count") else _COMPILED[kind]) if pattern.search(bare)]
    out |= dict.fromkeys((unit, False) for unit in loose if (unit, True) not in out)
    return tuple(out)


def half_away(x: Fraction) -> int:
    """Rounded to a whole number, halves away from zero."""
    return (1 if x >= 0 else -1) * ((2 * abs(x.numerator) + x.denominator) // (2 * x.denominator))
