"""Labelled spans for training the tagger of personal data: sentences of known frames, in rows of a bounded sample.

A frame is a wording around slots; what fills a slot is labelled with its kind. Everything outside slots is
unlabelled text, among it the wordings that resemble personal data (law firms, invoices, parcels, projects, places).
"""

from __future__ import annotations

import re

from quaysift.llm.pii_templates import KIND as _KIND

_W = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:['’][A-Za-zÀ-ÿ]+)?"
#: Slots of the frames.
SLOT = {
    "N": rf"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? )?(?:{_W}(?:-{_W})?|[A-ZÀ-Þ]\.)(?: (?:[A-ZÀ-Þ]\.|{_W}(?:-{_W})?)){{0,3}}|(?:{_W}(?:-{_W})?), (?:{_W}|[A-ZÀ-Þ]\.)(?: [A-ZÀ-Þ]\.)?",
    "E": r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+",
    "P": r"\+?\(?\d[\d\s().\-/]{5,18}\d(?: ?(?:ext\.?|x) ?\d{1,5})?",
    "I": r"(?:[A-Z]{1,2}[ -]?)?\d[\dA-Z]*(?:[ -][\dA-Z]+)*",
    "A": (
        r"(?:(?:Apt|Flat|Suite|Unit)\.? \d+(?:/| ?, ?))?\d+[a-z]?,? (?:[Rr]ue (?:des |de la |du |de )?[A-ZÀ-Þ][\wÀ-ÿ]+|(?:[A-ZÀ-Þ][\wÀ-ÿ'’-]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Way|Close|Drive|Dr|Blvd|Boulevard|Lane|Ln|Court|Ct|Terrace|Row|Square)\.?)"
        r"(?:, Suite \d+)?(?:(?:, ?|\n)[A-ZÀ-Þ][\wÀ-ÿ]+(?: (?!In |For |The )[A-ZÀ-Þ][\wÀ-ÿ]+)?)?(?:, [A-Z]{2} \d{4,5})?"
        r"|[A-ZÀ-Þ][\wÀ-ÿ]+(?:gasse|straße|strasse|weg|platz) \d+[a-z]?(?:(?:, ?|\n)\d{4,5} [A-ZÀ-Þ][\wÀ-ÿ]+(?: [A-ZÀ-Þ][\wÀ-ÿ]+)?)?"
        r"|(?:P\. ?O\.|PO|Post(?:al)?) [Bb]ox \d+(?:(?:, ?|\n)[A-ZÀ-Þ][\wÀ-ÿ]+(?: (?!In |For |The )[A-ZÀ-Þ][\wÀ-ÿ]+)?)?"
    ),
}
#: Wordings around personal data.
FRAMES = tuple(
    line
    for line in r"""
[Pp]lease call {N} on {P}
{S}{N}, {L}{I}, is listed
holder as {N}, {L}{I}(?=[.\s]|$)
passed for {N} \({L}{I}, {A}\)?
{S}{N}: I would put
{S}{N} \({E}\) will
{S}{N} and {N} signed the
signed copy to {A}
Prepared by {N} for the
Mobile {P}, ask for {N}(?=\.)
loan to {N} of [$€£]
mail bounced \({E}\), so we tried {P}(?=\.)
According to {N}, who runs
{S}{N} disputed the
Questions on [a-z -]+ go to {E}(?=\.?(?:\s|$))
cc: {N}; {E}(?=\s|$)
Home address on file: {A}
Regards,\n{N}\n{P}(?=\s|$)
Beneficial owner {N} lives at {A}
can be reached at {P} until
Copies went to {E} and {E} in
{S}{N} confirmed the [a-zA-Z -]+ figure
payroll file shows {L}{I} next to
Tel\. {P} / {E}(?=\s|$)
(?:^|\n){N} \| (?:[a-z ]+) \| {P}(?=\n|$)
(?:^|\n){N} \| (?:[a-z ]+) \| {E}(?=\n|$)
""".strip().split("\n")
    if line
)
#: A sentence's start, and what identity numbers are called (fixed values).
_START = r"(?:^|[.?!;:”\"] |\n|[\[\"“\t]|  )"
_LABEL = r"(?:(?:SSN|NI number|national ID|passport(?: no\.)?|social security no\.|national insurance number|personal tax ID|tax ID|driver licence|identity card(?: no\.)?|ID) )?"


def _compiled() -> list[tuple[re.Pattern, list[int]]]:
    out = []
    for frame in FRAMES:
        kinds = [_KIND[k] for k in re.findall(r"\{([NEPIA])\}", frame)]
        pattern = frame.replace("{S}", _START).replace("{L}", _LABEL)
        for k in re.findall(r"\{([NEPIA])\}", frame):
            pattern = pattern.replace("{" + k + "}", f"(@{k}@)", 1)
        for k, slot in SLOT.items():
            pattern = pattern.replace(f"@{k}@", slot)
        out.append((re.compile(pattern), kinds))
    return out


_FRAMES = _compiled()


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the labelled spans of a text, without overlaps."""
    found = []
    for pattern, kinds in _FRAMES:
        for m in pattern.finditer(text):
            found += [(m.start(g + 1), m.end(g + 1), k) for g, k in enumerate(kinds)]
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, int]] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out
