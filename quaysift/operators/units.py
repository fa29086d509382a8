"""Quantities recorded in different units, brought to the common unit of their metric.

Method: a hidden Markov model for each device (here the metric of one document or file). The unit of a record is the
hidden state. What the record says of its unit is the emission: a unit in the value itself settles it, one tied to the
figure elsewhere (metric's name, header, brackets, source column, file name) is likely, one that is only mentioned in
the quotation is possible, and so is the common unit wherever the value itself names none. Jumps of the log value
against the level of the series and switches of the unit are the transitions; Viterbi decodes the units. Units that a
record doesn't mention are impossible: a number without any unit is in the common one (a rate below one: a fraction).

Scale: one Python pass reads the records into a slim table, which is checkpointed. Records with one possible unit are done
then; all they give to the model is the mean log value of a period, by a partial aggregate, and a series has no more
periods than the calendar. Only the distinct figures that leave several units possible are shuffled, by series and
segment: a period with settled records separates what lies before it from what follows, so that segments are decoded
apart and a hot series is spread. Within a segment rows stream; whenever all survivors share their past, it is given out.

Defined cases: null, blank or non-numeric values give a null common value; an unknown metric gives null kind and
value; repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysift.functions import ontology as O
from quaysift.functions import quantities as Q
from quaysift.session import cut_lineage, spread

OBSERVED = "tbl string, row_key bigint, series string, at int, metric string, kind string, unit string, common_value decimal(38,0), common_exact double, num string, proposals string"
DECIDED = "series string, at int, kind string, num string, proposals string, unit string, common_value decimal(38,0), common_exact double"
RESULT = ("tbl", "row_key", "metric", "kind", "unit", "common_value", "common_exact")
#: Log weights of the model: what a record proposes beside the likeliest unit, a switch of the unit, a jump of the level
#: (in decades), and the most a jump can cost. A tied unit gives way only to levels on both sides (9 > 8), a loose one wins by one.
LESS_NEAR, COMMON_BESIDE_TIED, LOOSE = -1.0, -9.0, -1.5
SWITCH, JUMP_SCALE, JUMP_MOST = -0.7, 0.5, 8.0

Proposals = list[tuple[str, float]]


def financial_evidence_records(df: DataFrame) -> DataFrame:
    """The columns the operator reads, from extracted figures."""
    nameless = F.col("doc_name").isNull() | (F.col("doc_name") == "unknown")
    return df.select(
        F.lit("financial_evidence").alias("tbl"), F.col("evidence_id").alias("row_key"),
        F.concat_ws("|", F.coalesce("doc_name", F.lit("")), F.when(nameless, F.col("run_id"))).alias("origin"),
        F.col("metric_name").alias("metric_name"), F.col("fiscal_year").alias("period"), "value",
        F.col("source_quote").alias("quote"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("file_name"),
    )


def financials_records(df: DataFrame) -> DataFrame:
    """The columns the operator reads, from the companies' own files."""
    return df.select(
        F.lit("financials").alias("tbl"), F.col("fin_row_id").alias("row_key"), F.coalesce("file_name", F.lit("")).alias("origin"),
        F.col("metric").alias("metric_name"), F.col("fiscal_year").alias("period"), "value",
        F.lit(None).cast("string").alias("quote"), F.col("source").alias("note"), "file_name",
    )


def observe(
    metric_name: str | None, value: str | None, quote: str | None, note: str | None, file_name: str | None
) -> tuple[str | None, str | None, Fraction | None, Proposals]:
    """(metric, kind, number as written, proposed units with their log weights, the likeliest first) of one record."""
    metric = O.resolve_metric(metric_name)
    kind = O.KIND_OF.get(metric) if metric else None
    read = Q.parse_number(value) if kind else None
    if read is None:
        return metric, kind, None, []
    number, rest = read
    if rest == "words":
        powers = [p for p in ("trillion", "billion", "million", "thousand") if p in value.lower()]
        if powers and kind in ("money", "count") and powers[0] in Q.UNITS[kind]:
            return metric, kind, number / Q.UNITS[kind][powers[0]], [(powers[0], 0.0)]
        rest = ""
    unit = Q.unit_in(rest, kind)
    if unit is not None:
        return metric, kind, number, [(unit, 0.0)]
    mentions = Q.units_in_quote(quote, value, metric_name, kind)
    tied = [Q.unit_in(O.split_metric(metric_name)[1], kind), *(unit for unit, near in mentions if near)]
    if note:
        tail = re.search(r"[,(\[].*$", note)
        tied.append(Q.unit_in(tail[0], kind) if tail else None)
    if file_name:
        tied.append(Q.unit_in(re.sub(r"\.\w+$", "", file_name), kind, True))
    plain = "fraction" if kind == "rate" and abs(number) < 1 else Q.COMMON[kind]
    out: dict[str, float] = {}
    for unit in tied:
        if unit in Q.UNITS[kind]:
            out.setdefault(unit, LESS_NEAR * len(out))
    out.setdefault(plain, COMMON_BESIDE_TIED + min(out.values()) if out else 0.0)
    for unit, near in mentions:
        if unit in Q.UNITS[kind]:
            out.setdefault(unit, LOOSE + min(out.values()))
    return metric, kind, number, list(out.items())


def _common(number: Fraction, kind: str, unit: str) -> tuple[Decimal | None, float | None]:
    common = number * Q.UNITS[kind][unit]
    whole = Q.half_away(common)
    return (Decimal(whole), float(common)) if abs(whole) < 10**38 else (None, None)


def _observations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OBSERVED.replace("(38,0)", "").split(", ")]
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            metric, kind, number, proposals = observe(r.metric_name, r.value, r.quote, r.note, r.file_name)
            at = O.period_order(O.period_of(r.period, r.quote, r.metric_name))
            key = r.tbl, r.row_key, f"{r.tbl}|{r.origin}|{metric}", at, metric, kind
            if number is None:
                rows.append((*key, None, None, None, None, None))
            elif len(proposals) == 1:
                unit = proposals[0][0]
                rows.append((*key, unit, *_common(number, kind, unit), None, None))
            else:
                rows.append((*key, None, None, None, str(number), "|".join(f"{unit}={weight}" for unit, weight in proposals)))
        yield pd.DataFrame(rows, columns=names)


def _jump(a: float | None, b: float | None) -> float:
    """Cost of the way from one log level to another; nothing where one is unknown (a zero has no logarithm)."""
    return 0.0 if a is None or b is None else min(((b - a) / JUMP_SCALE) ** 2 / 2, JUMP_MOST)


def _level(number: Fraction, factor: Fraction) -> float | None:
    return math.log10(abs(float(number * factor))) if number else None


class Chain:
    """Viterbi over one segment of a series, fed record by record in the order of time.

    ``add`` and ``close`` give out (record, unit) as soon as they are certain: when all survivors share one predecessor.
    """

    def __init__(self, before: float | None) -> None:
        self.before = before
        self.states: list[tuple[str, float | None, float]] = []
        self.held: list[tuple] = []

    def _trace(self, end: int) -> list[tuple]:
        out = []
        for record, states, back in reversed(self.held):
            out.append((record, states[end][0]))
            end = back[end]
        self.held = []
        return out[::-1]

    def add(self, record: tuple, kind: str, number: Fraction, proposals: Proposals) -> list[tuple]:
        scored, back = [], []
        for unit, weight in proposals:
            level = _level(number, Q.UNITS[kind][unit])
            if self.states:
                ways = [score - _jump(other, level) + (0.0 if unit == name else SWITCH) for name, other, score in self.states]
                best = max(range(len(ways)), key=ways.__getitem__)
                scored.append((unit, level, ways[best] + weight))
                back.append(best)
            else:
                scored.append((unit, level, weight - _jump(self.before, level)))
                back.append(0)
        out = self._trace(back[0]) if self.held and len(set(back)) == 1 else []
        self.states = scored
        self.held.append((record, scored, back if not out else [0] * len(back)))
        return out

    def close(self, after: float | None) -> list[tuple]:
        if not self.held:
            return []
        scores = [score - _jump(level, after) for _, level, score in self.states]
        return self._trace(max(range(len(scores)), key=scores.__getitem__))


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (series, segment, at, kind, num, proposals, before, after), those of a segment together and in order."""
    names = [c.split()[0] for c in DECIDED.replace("(38,0)", "").split(", ")]
    chain, key, after = None, None, None

    def rows(settled: list[tuple]) -> list[tuple]:
        return [(*record, unit, *_common(Fraction(record[3]), record[2], unit)) for record, unit in settled]

    for pdf in frames:
        out: list[tuple] = []
        for series, segment, at, kind, num, proposals, before, later in pdf.itertuples(index=False, name=None):
            if key != (series, segment):
                if chain is not None:
                    out += rows(chain.close(after))
                chain, key = Chain(None if before != before else before), (series, segment)
                after = None if later != later else later
            listed = [(unit, float(weight)) for unit, weight in (p.split("=") for p in proposals.split("|"))]
            out += rows(chain.add((series, at, kind, num, proposals), kind, Fraction(num), listed))
        yield pd.DataFrame(out, columns=names)
    if chain is not None:
        yield pd.DataFrame(rows(chain.close(after)), columns=names)


def common_units(records: DataFrame) -> DataFrame:
    """Every record with its metric, kind of quantity, decoded unit and value in the common unit.

    records: tbl, row_key, origin, metric_name, period, value, quote, note, file_name.
    """
    given = spread(records.select("tbl", "row_key", "origin", "metric_name", "period", "value", "quote", "note", "file_name"))
    observed = cut_lineage(given.mapInPandas(_observations, OBSERVED))
    settled = observed.filter(F.col("proposals").isNull())
    levels = settled.filter(F.abs("common_exact") > 0).groupBy("series", "at").agg(F.avg(F.log10(F.abs("common_exact"))).alias("level"))
    anchors = levels.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("at", "level"))).alias("anchors"))
    open_rows = observed.filter(F.col("proposals").isNotNull())
    figure = ["series", "at", "kind", "num", "proposals"]
    figures = open_rows.select(*figure).distinct().join(anchors, "series", "left")
    before = F.element_at(F.filter("anchors", lambda a: a["at"] <= F.col("at")), -1)
    after = F.try_element_at(F.filter("anchors", lambda a: a["at"] > F.col("at")), F.lit(1))
    before = F.when(F.exists("anchors", lambda a: a["at"] <= F.col("at")), before)
    placed = figures.select(
        "series", F.coalesce(before["at"], F.lit(-1)).alias("segment"), "at", "kind", "num", "proposals",
        before["level"].alias("before"), after["level"].alias("after"),
    )
    ordered = placed.repartition("series", "segment").sortWithinPartitions("series", "segment", "at", "num", "proposals")
    decided = ordered.mapInPandas(_decoded, DECIDED)
    opened = open_rows.drop("unit", "common_value", "common_exact").join(decided, figure)
    return settled.select(*RESULT).unionByName(opened.select(*RESULT))


def converted(decoded: DataFrame) -> DataFrame:
    """Rows whose number stood in another unit than the common one, with the whole number in the common unit."""
    foreign = F.lit(False)
    for kind, unit in Q.COMMON.items():
        foreign = foreign | ((F.col("kind") == kind) & (F.col("unit") != unit))
    return decoded.filter(F.col("common_value").isNotNull() & foreign).select("tbl", "row_key", F.col("common_value").cast("bigint").alias("common_value")).distinct()
