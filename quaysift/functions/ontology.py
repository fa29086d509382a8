"""Metrics, periods and document kinds as the sources spell them, and how to resolve a spelling.

Resolution is by dictionary first and by one slip of the keyboard (Damerau-Levenshtein distance 1, for
names of five letters or more) second. Everything here is plain Python over single strings; the operators
call it once per distinct string of an Arrow batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Metric -> (kind of quantity, spellings).
METRICS: dict[str, tuple[str, tuple[str, ...]]] = {
    "revenue": ("money", ("revenue", "revenues", "turnover", "sales", "rev", "total revenue", "total revenues", "net sales", "total sales")),
    "ebitda": ("money", ("ebitda", "adjusted ebitda", "adj ebitda")),
    "net_income": ("money", ("net income", "net profit", "earnings", "profit after tax", "net earnings")),
    "gross_profit": ("money", ("gross profit",)),
    "operating_income": ("money", ("operating income", "operating profit", "ebit")),
    "arr": ("money", ("arr", "annual recurring revenue", "recurring revenue annualised", "recurring revenue annualized", "recurring revenue")),
    "mrr": ("money", ("mrr", "monthly recurring revenue")),
    "net_debt": ("money", ("net debt", "net borrowings", "debt net")),
    "capex": ("money", ("capex", "capital expenditure", "capital expenditures")),
    "free_cash_flow": ("money", ("free cash flow", "fcf")),
    "working_capital": ("money", ("working capital", "net working capital")),
    "ebitda_margin": ("rate", ("ebitda margin",)),
    "gross_margin": ("rate", ("gross margin", "gm", "gross profit margin")),
    "operating_margin": ("rate", ("operating margin", "ebit margin")),
    "net_margin": ("rate", ("net margin", "net profit margin")),
    "churn": ("rate", ("churn", "churn rate", "customer churn", "logo churn")),
    "headcount": ("count", ("headcount", "employees", "staff count", "staff", "ftes")),
    "active_sites": ("count", ("active sites", "sites active", "live sites", "sites")),
    "floor_area": ("area", ("floor area", "floor space", "warehouse area")),
    "shipped_weight": ("mass", ("shipped weight", "weight shipped", "freight weight")),
    "energy_use": ("energy", ("energy use", "energy consumed", "power consumption", "energy consumption")),
    "tank_storage": ("volume", ("tank storage", "storage volume", "tank capacity")),
}

# Document kind -> spellings in file names and source columns (letters only, lower case).
DOC_KINDS: dict[str, tuple[str, ...]] = {
    "cim": ("cim", "info memo", "information memorandum", "conf info memo", "confidential information memorandum"),
    "tax": ("tax return", "taxreturn", "tax filing", "tax ret"),
    "board": ("board deck", "board pack", "boardpresentation", "board presentation", "board pres"),
    "model": ("lender model", "lendermodel", "bank model", "lender mdl"),
    "minutes": ("meeting notes", "mtg notes", "call minutes", "minutes", "mgmt call", "management call"),
}

# Words that follow a company's name.
LEGAL_FORMS = frozenset(("ltd", "limited", "inc", "llc", "plc", "gmbh", "sa", "ag", "bv", "holdings", "corp", "co", "group", "sarl", "spa", "nv", "oy", "ab"))

ALIASES: dict[str, str] = {alias: metric for metric, (_, names) in METRICS.items() for alias in names}
KIND_OF: dict[str, str] = {metric: kind for metric, (kind, _) in METRICS.items()}


def one_slip(a: str, b: str) -> bool:
    """True if b is a with at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def squeeze(text: str) -> str:
    """Lower case, every run of other characters than letters and digits one blank."""
    return re.sub(r"[^0-9a-zà-öø-ÿ]+", " ", text.lower()).strip()


_UNIT_TAIL = re.compile(
    r"(\s*[\(\[][^\)\]]*[\)\]]|\s*[,\-–:]\s*(us\$|\$|usd|percent|per cent|square|sq\b|in\b).*|\s+(in (thousands|millions|billions).*|ratio|fraction|percent|pct|%|sqft|sq ft|mwh|gwh|gj|kwh|lbs?|cubic met\w+|us gallons?|hl|kg|tonnes?|short tons?))\s*$",
    re.I,
)


def split_metric(name: str | None) -> tuple[str, str]:
    """(name proper, tail which may state a unit)."""
    text = (name or "").strip()
    head, tails = text, []
    while True:
        m = _UNIT_TAIL.search(head)
        if not m or m.start() == 0:
            return head, " ".join(reversed(tails))
        if squeeze(m.group(0)).startswith("annu"):  # part of a name, not a unit
            if squeeze(head) in ALIASES or not tails:
                return head, " ".join(reversed(tails))
        tails.append(m.group(0))
        head = head[: m.start()]


@lru_cache(maxsize=200_000)
def resolve_metric(name: str | None) -> str | None:
    """The metric which a spelling means, None where there is none or where it is equally near to two."""
    for text in (name or "", split_metric(name)[0]):
        key = squeeze(text)
        if key in ALIASES:
            return ALIASES[key]
    for text in (split_metric(name)[0], name or ""):
        key = squeeze(text)
        for probe in (key, key.replace(" ", "")):
            if len(probe) < 4:
                continue
            near = {ALIASES[a] for a in ALIASES if len(a) >= 3 and one_slip(probe, a if " " in probe else a.replace(" ", ""))}
            if len(near) == 1:
                return near.pop()
            if len(near) > 1:
                longest = [ALIASES[a] for a in ALIASES if one_slip(probe, a) and a[:1] == probe[:1]]
                if len(set(longest)) == 1:
                    return longest[0]
    return None


_YEAR = r"(?:19|20)?\d\d"
_PERIODS = (
    (re.compile(rf"^q([1-4])\s*(?:fy)?\s*'?\s*({_YEAR})$"), lambda m: ("q", m[1], m[2])),
    (re.compile(rf"^([1-4])q\s*(?:fy)?\s*'?\s*({_YEAR})$"), lambda m: ("q", m[1], m[2])),
    (re.compile(rf"^(?:fy|fiscal(?: year)?)?\s*'?\s*({_YEAR})[\s-]*q([1-4])$"), lambda m: ("q", m[2], m[1])),
    (re.compile(rf"^(?:fy|fiscal(?: year)?|year)\s*'?\s*({_YEAR})$"), lambda m: ("y", "", m[1])),
    (re.compile(r"^((?:19|20)\d\d)$"), lambda m: ("y", "", m[1])),
)
_TRAILING = frozenset(("ttm", "ltm", "trailing twelve months", "last twelve months", "the trailing twelve months", "trailing 12 months"))
#: A period anywhere in running text.
PERIOD_IN_TEXT = re.compile(
    r"(?<![\w$€£.,])(?:Q[1-4]\s?(?:FY)?\s?'?(?:19|20)?\d\d|[1-4]Q'?(?:19|20)?\d\d|(?:FY|Fiscal(?: Year)?)\s?'?(?:19|20)?\d\d(?:[\s-]?Q[1-4])?|(?:19|20)\d\d[\s-]?Q[1-4]|(?:the )?trailing twelve months|TTM|LTM|(?:19|20)\d\d)(?![\w,]\d|\w)",
    re.I,
)


@lru_cache(maxsize=100_000)
def resolve_period(text: str | None) -> str | None:
    """FY2024, Q1FY2024 or TTM; None where the text is no period."""
    key = re.sub(r"\s+", " ", (text or "").replace("’", "'").strip().lower()).strip(" .")
    if key in _TRAILING:
        return "TTM"
    for pattern, parts in _PERIODS:
        m = pattern.match(key)
        if m:
            what, quarter, year = parts(m)
            year = year if len(year) == 4 else ("20" if int(year) < 80 else "19") + year
            return f"Q{quarter}FY{year}" if what == "q" else f"FY{year}"
    return None


def period_of(fiscal_year: str | None, quote: str | None, metric_name: str | None) -> str | None:
    """The stated period; where none is stated, the one in the sentence of the quotation that names the metric."""
    period = resolve_period(fiscal_year)
    if period or (fiscal_year or "").strip() or not quote:
        return period
    name = (metric_name or "").strip()
    sentences = re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n+", quote)
    named = [s for s in sentences if name and name in s] or sentences
    found = [m.group(0) for s in named for m in PERIOD_IN_TEXT.finditer(s)]
    found.sort(key=lambda text: re.fullmatch(r"\d{4}", text) is not None)  # a bare year counts last
    return next((p for p in map(resolve_period, found) if p), None)


def period_order(period: str | None) -> int:
    """A resolved period's place in time: years of eight steps, a quarter before its year's end; trailing and unknown ones last."""
    m = re.fullmatch(r"(?:Q([1-4]))?FY(\d{4})", period or "")
    if m:
        return 8 * int(m[2]) + (2 * int(m[1]) - 2 if m[1] else 7)
    return 8 * 10000 + (0 if period == "TTM" else 1)


@lru_cache(maxsize=100_000)
def resolve_doc_kind(text: str | None) -> str | None:
    """Kind of document that a file name or a source column names."""
    if text is None:
        return None
    words = " " + re.sub(r"[^a-z]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", text.split("::")[0]).lower()).strip() + " "
    glued = words.replace(" ", "")
    best: tuple[int, str] | None = None
    for kind, names in DOC_KINDS.items():
        for name in names:
            if f" {name} " in words or (len(name) > 6 and name.replace(" ", "") in glued):
                if best is None or len(name) > best[0]:
                    best = (len(name), kind)
    return best[1] if best else None
