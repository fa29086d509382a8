"""Texts cut off by field limits or in transfer: the cut rows, and each source's share of them.

Method: a structural completeness check. A stack automaton reads the whole text and keeps what is open (brackets,
quotation marks, tags of markup, code fences); its end state tells whether something is unclosed, a multibyte sequence or
an escape is broken, a terminator is missing, or a table row has fewer cells than its header. A missing terminator is judged
against the baseline of complete lines: an unterminated last line is complete if lines of the same form (digits as 0,
names as Xx), or of the same label and the same form of value, also stand within other texts, where nothing can have
cut them; likewise the last cell of a table. How often a form must stand there depends on the source: ``support`` times,
but once is enough in a source of which no row shows a sure cut, and at a length at which a source's sure cuts pile up (its
field limit) five times as often.

Scale: one pass reads each text once and gives out a slim row a text and, for each batch, the counts of its lines and
cells; that table is checkpointed. The inventories are sums by form, joined only with the few undecided rows.

Defined cases: null, blank and placeholder texts are complete; a terminated text is complete whatever its length;
repeated rows are each judged; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysift.session import cut_lineage, spread

OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_EVENT = re.compile(r"[()\[\]{}“”„«»\"]|```|</?[a-zA-Z][a-zA-Z0-9]{0,15}(?:\s[^<>]*)?/?>")
#: Tags which need not be closed.
_LOOSE_TAGS = frozenset("p li td th tr br hr img input meta link option dt dd col area base wbr source".split())
_TERMINATED = re.compile(r"[.!?。！？][\"”’»)\]*_]*$")
#: Abbreviations after which a sentence goes on.
_WITHIN = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|No|no|nos|St|Rd|Ave|Tel|ext|vs|approx|incl|Apt|Dept|P\.O)\.|\b[A-Z]\.")
_INITIAL = re.compile(r"(?:^|(?<!\d)\s)(?:[A-ZÀ-Þ]|Mr|Mrs|Ms|Dr|Prof|no|nos|vs|approx|incl|ext|P\.O|Apt|Tel)\.$")
_BROKEN_END = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?[a-zA-Z0-9]{0,8}|<[/a-zA-Z][^<>\n]{0,80}|%[0-9A-Fa-f]?|�)$")
_MARKED = re.compile(r"(?:\.\.\.|…)[\"”’»)\]]*$")
#: A whole mail address at the end, up to one of the usual last labels (fixed values).
MAIL_AT_END = r"(?i)\S\s?(?:@|\(at\)|\[at\])\s?[\w-][\w. -]*(?:\.|\(dot\)|\[dot\])\s?(?:example|invalid|test|localhost|com|org|net|edu|gov|io|co|uk|de|fr|es|pt|pl|ru|it|nl|eu|ch|at|us)$"
_PLACEHOLDER = re.compile(r"^[(\[]?\s*(?:empty|no text|n/?a|none|null|tbd|-+|not available|blank|page intentionally left blank)\s*[)\]]?\.?$", re.I)


def open_at_end(text: str) -> list[str]:
    """What the automaton's stack holds after the whole text; closers without an opener are passed over."""
    stack: list[str] = []
    for c in _EVENT.findall(text):
        if c in ('"', "```"):
            if c in stack:
                del stack[stack.index(c) :]
            else:
                stack.append(c)
        elif c[0] == "<":
            name = c.strip("</>").split()[0].lower()
            if c[1] == "/":
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif name not in _LOOSE_TAGS and c[-2] != "/":
                stack.append(f"<{name}>")
        elif c == "“" and "„" in stack:
            del stack[stack.index("„") :]
        elif c in OPENERS:
            stack.append(c)
        elif c in CLOSERS and CLOSERS[c] in stack:
            while stack.pop() != CLOSERS[c]:
                pass
    return stack


def judge(text: str | None) -> tuple[str, str | None, str | None]:
    """(verdict, last line, last cell): verdict complete, cut, or undecided with the line or cell to compare."""
    if text is None:
        return "complete", None, None
    body = text.rstrip()
    if not body or _PLACEHOLDER.match(body.strip()):
        return "complete", None, None
    if _MARKED.search(body):
        return "cut", None, None
    lines = body.split("\n")
    last = lines[-1].strip()
    if body.count("|") and lines[0].count(" | ") and (" | " in last or len(lines) > 1 and all(" | " in x or x.rstrip().endswith("|") for x in lines[:-1] if x.strip())):
        raw = text.rstrip("\n").split("\n")[-1]
        have, want = raw.count("|"), lines[0].count("|")
        if have < want:
            return "cut", None, None
        cell = raw.rsplit("|", 1)[-1].strip()
        return ("undecided", None, cell) if cell and len(lines) > 1 else ("complete", None, None)
    stack = open_at_end(body)
    if stack:
        return "cut", None, None
    inner = body
    if len(inner) > 2 and (inner[0], inner[-1]) in (("[", "]"), ('"', '"'), ("“", "”"), ("(", ")")):
        return "complete", None, None
    if _TERMINATED.search(inner):
        return ("cut" if _INITIAL.search(inner) else "complete"), None, None
    if _BROKEN_END.search(inner) and not inner.endswith("%"):
        return "cut", None, None
    if re.search(r"[.!?][”\"’)\]]?\s+\S", _WITHIN.sub("", last)):
        return "cut", None, None
    return "undecided", last, None


_DIGIT = re.compile(r"[0-9]")
_FORMS = (
    (re.compile(r"\b(?:Q0 (?:FY)?0000|FY ?0000|FY ?00|0000-Q0|the trailing twelve months|TTM|LTM)\b", re.A), "PP"),
    (re.compile(r"[$€£]0{1,3}(?:,000)+(?![0-9,.])"), "$G"), (re.compile(r"[$€£]0+(?:\.0+)?"), "$N"), (re.compile(r"\b0+(?:\.0+)?(?= ?%| percent)", re.A), "N"),
)


@lru_cache(maxsize=200_000)
def line_key(line: str) -> str:
    """A line with its periods as PP, well-formed amounts as $G or $N, percentages as N% and other digits as 0."""
    line = _DIGIT.sub("0", line)
    if "0" in line or "TM" in line or "trailing" in line:
        for pattern, mark in _FORMS:
            line = pattern.sub(mark, line)
    return line


def cell_key(cell: str) -> str:
    return _DIGIT.sub("0", cell)


def form(c: Column) -> Column:
    """A line's form: mail addresses by their last label, capitalised words as Xx, digits as 0, runs of Xx as one.

    Patterns begin at the start of a word and never go back within it, so that long runs without blanks cost no more than their length.
    """
    c = F.regexp_replace(c, r"(?i)(?<![^\s@(\[])[^\s@(\[]++\s?(?:@|\(at\)|\[at\])\s?[\w.-]*?(?:\.|\(dot\)|\[dot\]|\s)+([a-z]+)(?=[\s;,)\]]|$)", "@$1")
    c = F.regexp_replace(c, r"(?U)\b\p{Lu}[\p{L}’'-]*\.?", "Xx")
    return F.regexp_replace(c, r"Xx(?:[\s,-]+Xx)*", "Xx")


READ = "what string, tbl string, row_key bigint, source string, size int, verdict string, line string, cell string, key string, n bigint"
_ENDED = re.compile(r"[.!?][\"”’»)\]]*$")


def inventory(text: str) -> tuple[list[str], list[str]]:
    """(keys of the unterminated lines, distinct keys of each row's cells) that stand before a text's last line."""
    lines, cells = [], []
    for raw in text.split("\n")[:-1]:
        line = raw.strip(" ")
        if " | " in line:
            cells += {cell_key(cell.strip()) for cell in line.split("|")}
        elif line and not _ENDED.search(line):
            lines.append(line_key(line))
    return lines, cells


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for pdf in frames:
        rows, lines, cells = [], Counter(), Counter()
        for tbl, key, source, text in pdf.itertuples(index=False, name=None):
            verdict, line, cell = judge(text)
            shape = line_key(line) if line is not None else cell_key(cell) if cell is not None else None
            rows.append(("text", tbl, key, source, None if text is None else len(text), verdict, line, cell, shape, None))
            if text is not None and "\n" in text:
                found = inventory(text)
                lines.update(found[0])
                cells.update(found[1])
        rows += [("line", *[None] * 7, key, n) for key, n in lines.items()] + [("cell", *[None] * 7, key, n) for key, n in cells.items()]
        yield pd.DataFrame(rows, columns=names)


def records(doc_chunks: DataFrame, evidence_chunks: DataFrame) -> DataFrame:
    """Both tables as (tbl, row_key, source, text)."""
    return doc_chunks.select(F.lit("doc_chunks").alias("tbl"), F.col("chunk_key").alias("row_key"), "source", "text").unionByName(
        evidence_chunks.select(F.lit("evidence_chunks").alias("tbl"), F.col("evidence_key").alias("row_key"), "source", F.col("quote").alias("text"))
    )


def check(rows: DataFrame, support: int = 2) -> DataFrame:
    """(tbl, row_key, source, cut) of all rows: (tbl, row_key, source, text)."""
    read = cut_lineage(spread(rows.select("tbl", "row_key", "source", "text")).mapInPandas(_read, READ))
    judged = read.filter("what = 'text'").drop("what", "n")
    counted = lambda what: read.filter(F.col("what") == what).groupBy("key").agg(F.sum("n").alias("n"))
    lines = counted("line")
    pattern = r"^(.{1,60}?): (.+)$"
    label, value, tail = F.regexp_extract("key", pattern, 1), F.regexp_extract("key", pattern, 2), F.regexp_extract("key", r"(?<!\S)(\S++)$", 1)
    # every line counts for its key, its form, its label, its value and its last word: one sum over all of them
    facets = F.array(*[F.struct(F.lit(name).alias("facet"), c.alias("shape")) for name, c in (("key", F.col("key")), ("form", form(F.col("key"))), ("label", label), ("value", value), ("tail", tail))])
    sums = lines.select("n", F.explode(facets).alias("f")).filter("f.shape <> ''").groupBy("f.facet", "f.shape").agg(F.sum("n").alias("n"))
    # the baseline of each source: whether any of its rows is surely cut, and the lengths at which these pile up
    sure = F.sum((F.col("verdict") == "cut").cast("int"))
    steady = judged.groupBy("tbl", "source").agg(sure.alias("n_sure")).filter("n_sure = 0").select("tbl", "source", F.lit(True).alias("steady"))
    limits = judged.groupBy("tbl", "source", "size").agg(F.count("*").alias("n_size"), sure.alias("n_cut"))
    limits = limits.filter((F.col("n_cut") >= 8) & (F.col("n_cut") >= 0.5 * F.col("n_size"))).select("tbl", "source", "size", F.lit(True).alias("at_limit"))
    need = F.when(F.coalesce("at_limit", F.lit(False)), 5 * support).when(F.coalesce("steady", F.lit(False)), 1).otherwise(support)
    undecided = judged.filter("verdict = 'undecided'").join(limits, ["tbl", "source", "size"], "left").join(steady, ["tbl", "source"], "left").withColumn("need", need)
    asked = undecided.filter("line IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    asked = cut_lineage(asked.select("id", "tbl", "row_key", "source", "line", "key", "need"))
    known = asked.select("id", F.explode(facets).alias("f")).select("id", "f.facet", "f.shape").join(sums, ["facet", "shape"])
    known = known.groupBy("id").pivot("facet", ["key", "form", "label", "value", "tail"]).agg(F.first("n")).toDF("id", *[f"n_{c}" for c in ("key", "form", "label", "value", "tail")])
    has = lambda name, least=support: F.coalesce(F.col(f"n_{name}") >= least, F.lit(False))
    shown = form(F.col("key"))
    personal = shown.rlike(r"@|0000|Xx")
    least = F.greatest("need", F.lit(support))
    alike = has("form", least) & personal & (has("tail") | tail.rlike(r"[0@]"))
    run = F.col("line").rlike(r"^\S{40,}$")
    mailed = F.col("line").rlike(MAIL_AT_END)
    by_line = asked.join(known, "id", "left").select("tbl", "row_key", "source", (~(has("key", F.col("need")) | (has("label", least) & has("value", least)) | alike | run | mailed)).alias("cut"))
    cells = counted("cell").withColumnRenamed("n", "n_cell")
    personal_cell = F.col("key").rlike(r"(?i)@|\(at\)|\[at\]")
    by_cell = undecided.filter("cell IS NOT NULL").join(cells, "key", "left").select(
        "tbl", "row_key", "source", F.when(personal_cell, ~F.col("cell").rlike(MAIL_AT_END)).otherwise(F.coalesce(F.col("n_cell") < F.col("need"), F.lit(True))).alias("cut")
    )
    decided = judged.filter("verdict <> 'undecided'").select("tbl", "row_key", "source", (F.col("verdict") == "cut").alias("cut"))
    return decided.unionByName(by_line).unionByName(by_cell)


def shares(checked: DataFrame) -> DataFrame:
    """How often each source cuts: tbl, source, n_rows, n_cut, share."""
    return checked.groupBy("tbl", "source").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share")
    )
