"""Matching extracted figures with the companies' own rows, without a shared key.

Method: soft logic. Weighted rules over candidate links become a convex hinge-loss problem, solved by consensus ADMM; a
link's value in [0, 1] is its confidence, and a link of at least ``threshold`` is reported.

1. Both sides are read into (company, metric, period, document kind) with a nearness in [0, 1] for what was only nearly
   spelt (a metric with a slip, a period found in the quotation). Companies are the financials files; the names in
   document titles find theirs by exact stem or one slip of the keyboard (a join over single-deletion variants of the
   distinct names, never all against all).
2. Candidates agree in company, metric and period and may differ in document kind, value and spelling. Rows which agree
   in all of them are one class, so that repeated figures do not multiply variables. All distinct amounts of a block
   (company, metric, period) are merged in their order, so that the nearest two of any two classes are found exactly.
3. Rules in a block, none of which settles a link by itself:
   same kind and near spelling -> link; other kind -> no link; near values -> link; far values -> no link; few links at all;
   a row is stated by one document (exclusivity); a row without a source is stated by some document of the block (existence),
   be it one of the evidence or one that other rows name; a document states a figure in one kind of row (crowding, weak);
   what links a document to a row links it to a row without a source that states the same amount (transitivity).
4. Links are expanded to the rows of their classes (``link``) or reported by class with counts (``classes``).

Blocks with the same pattern of kinds, nearness and value agreement (to a thousandth) have one solution, computed once
a batch.

Defined cases: rows with doc_name unknown or null, with no known metric or with no period match nothing; null or
unusable values count as unknown agreement; repeated rows each match; an empty table gives no links; further
columns are ignored, also if they bear the names used here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysift.functions import ontology as O
from quaysift.functions import quantities as Q
from quaysift.operators.units import observe
from quaysift.session import cut_lineage, spread

READ = "row_key bigint, stem string, sector string, metric string, period string, doc_kind string, near double, amount double"
LINK = "company string, metric string, period string, e_kind string, f_kind string, confidence double"

#: Weights of the rule families; the first five and existence, crowding and transitivity are squared hinges, exclusivity a linear one.
WEIGHTS = {"same_kind": 3.0, "other_kind": 3.0, "near_value": 1.0, "far_value": 0.5, "few": 0.1, "exclusive": 5.0, "exists": 2.0, "crowd": 0.3, "transitive": 0.5}
#: Nearness of a metric spelt with a slip, of a period read from the quotation, and of a company's name with a slip.
SLIPPED_METRIC, QUOTED_PERIOD, SLIPPED_NAME = 0.95, 0.95, 0.95
_FILE_TAIL = re.compile(r"([_\s-]+(financials?|fin|metrics|kpis?|usd|in|thousands|millions|billions|musd|kusd|mm|usd000|bn))+$", re.I)
_VERSION = re.compile(r"[\s_-]*(\(\d+\)|v\d+|final|draft|fy\d\d)$", re.I)


@lru_cache(maxsize=100_000)
def company_of_document(doc_name: str | None) -> tuple[str, str] | None:
    """(stem, sector or '') from a document's title."""
    if doc_name is None or doc_name.strip().lower() in ("", "unknown"):
        return None
    title = re.sub(r"\.[a-z0-9]{2,5}$", "", doc_name.split("::")[0].strip(), flags=re.I)
    while True:
        shorter = _VERSION.sub("", title)
        if shorter == title:
            break
        title = shorter
    words = re.sub(r"[^a-zà-ÿ]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", title).lower()).strip()
    for names in O.DOC_KINDS.values():
        for name in sorted(names, key=len, reverse=True):
            if words.endswith(" " + name):
                return _named(words[: -len(name)].split())
    return _named(words.split())


def _named(words: list[str]) -> tuple[str, str] | None:
    words = [w for w in words if w not in O.LEGAL_FORMS]
    return (words[0], " ".join(words[1:])) if words else None


@lru_cache(maxsize=100_000)
def company_of_file(file_name: str | None, company: str | None) -> tuple[str, str] | None:
    """(stem, sector or '') from a financials file, else from its company column."""
    if file_name and file_name.strip():
        root = _FILE_TAIL.sub("", re.sub(r"\.\w+$", "", file_name.strip()))
        return _named(re.sub(r"[^a-zà-ÿ]+", " ", root.lower()).split())
    return _named(re.sub(r"[^a-zà-ÿ]+", " ", company.lower().replace(".", "")).split()) if company else None


def _amount(metric_name: str | None, value: str | None, quote: str | None, note: str | None, file_name: str | None) -> tuple[str | None, float | None]:
    metric, kind, number, units = observe(metric_name, value, quote, note, file_name)
    return metric, None if number is None else float(number * Q.UNITS[kind][units[0][0]])


def _exact_metric(name: str) -> bool:
    return any(O.squeeze(text) in O.ALIASES for text in (name, O.split_metric(name)[0]))


def _read_evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            name = company_of_document(r.doc_name)
            metric, amount = _amount(r.metric_name, r.value, r.source_quote, None, None)
            period = O.period_of(r.fiscal_year, r.source_quote, r.metric_name)
            kind = O.resolve_doc_kind(r.doc_name)
            if name and metric and period and kind:
                near = (1.0 if _exact_metric(r.metric_name) else SLIPPED_METRIC) * (1.0 if O.resolve_period(r.fiscal_year) else QUOTED_PERIOD)
                rows.append((r.evidence_id, *name, metric, period, kind, near, amount))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])


def _read_financials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            name = company_of_file(r.file_name, r.company)
            metric, amount = _amount(r.metric, r.value, None, r.source, r.file_name)
            period = O.resolve_period(r.fiscal_year)
            blank = r.source is None or not r.source.strip()
            kind = "" if blank else O.resolve_doc_kind(r.source)
            if name and metric and period and kind is not None:
                near = 1.0 if _exact_metric(r.metric) else SLIPPED_METRIC
                rows.append((r.fin_row_id, *name, metric, period, kind, near, amount))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])


def _variants(stem: str) -> Column:
    """A name and, if it has five letters or more, all it becomes by leaving out one."""
    c = F.col(stem)
    without = F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))
    return F.when(F.length(c) > 4, F.array_distinct(F.concat(F.array(c), without))).otherwise(F.array(c))


def _one_slip(left: str, right: str) -> Column:
    """Whether two names differ by one insertion, deletion, substitution or swap of neighbours at most."""
    a, b = F.col(left), F.col(right)
    unlike = F.filter(F.sequence(F.lit(1), F.length(a)), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    p, q = F.get(unlike, F.lit(0)), F.get(unlike, F.lit(1))
    letter = lambda c, k: F.substring(c, k, F.lit(1))
    swapped = (F.length(a) == F.length(b)) & (F.size(unlike) == 2) & (q == p + 1) & (letter(a, p) == letter(b, q)) & (letter(a, q) == letter(b, p))
    return (F.levenshtein(a, b) <= 1) | F.coalesce(swapped, F.lit(False))


def resolve_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """(stem, sector) -> company (its stem and sector, and how near): names: stem, sector; companies: stem, sector."""
    known = companies.select(F.col("stem").alias("c_stem"), F.col("sector").alias("c_sector")).distinct()
    left = names.select("stem", "sector").distinct().withColumn("v", F.explode(_variants("stem")))
    right = known.withColumn("v", F.explode(_variants("c_stem")))
    near = left.join(right, "v").drop("v").distinct().filter(_one_slip("stem", "c_stem"))
    near = near.filter((F.col("sector") == "") | (F.col("c_sector") == "") | (F.levenshtein("sector", "c_sector") <= 1))
    near = near.withColumn("rank", (F.col("stem") != F.col("c_stem")).cast("int") * 2 + (F.col("sector") != F.col("c_sector")).cast("int"))
    best = near.groupBy("stem", "sector").agg(
        F.min(F.struct("rank", "c_stem", "c_sector")).alias("best"),
        F.min("rank").alias("least"), F.collect_list("rank").alias("ranks"),
    )
    single = F.size(F.filter("ranks", lambda r: r == F.col("least"))) == 1
    return best.filter(single).select(
        "stem", "sector", F.concat_ws("|", "best.c_stem", "best.c_sector").alias("company"),
        F.when(F.col("least") >= 2, SLIPPED_NAME).otherwise(1.0).alias("nearness"),
    )


Factor = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]


def hinge_admm(n: int, factors: list[Factor], rho: float = 1.0, rounds: int = 1000, tolerance: float = 1e-5) -> np.ndarray:
    """Minimise the sum of w * max(0, a.x + b), or of its squares, over x in [0, 1]^n by consensus ADMM.

    factors: by arity (variables [m, k], coefficients [m, k], constants [m], weights [m], squared).
    """
    x = np.full(n, 0.5)
    degree = np.zeros(n)
    copies = []
    for index, *_ in factors:
        np.add.at(degree, index, 1.0)
        copies.append([x[index].copy(), np.zeros(index.shape)])
    degree = np.maximum(degree, 1.0)
    for _ in range(rounds):
        total, moved = np.zeros(n), 0.0
        for (index, coef, const, weight, squared), state in zip(factors, copies):
            point = x[index] - state[1] / rho
            slack = (coef * point).sum(1) + const
            norm = np.maximum((coef * coef).sum(1), 1e-12)
            if squared:
                step = 2 * weight * np.maximum(slack, 0.0) / (rho + 2 * weight * norm)
            else:
                # a full push where the hinge stays open, else just onto its edge
                step = np.minimum(weight / rho, np.maximum(slack, 0.0) / norm)
            state[0] = point - step[:, None] * coef
            np.add.at(total, index, state[0] + state[1] / rho)
        new = np.clip(total / degree, 0.0, 1.0)
        for (index, *_), state in zip(factors, copies):
            gap = state[0] - new[index]
            state[1] += rho * gap
            moved = max(moved, float(np.abs(gap).max(initial=0.0)))
        done = moved < tolerance and float(np.abs(new - x).max(initial=0.0)) < tolerance
        x = new
        if done:
            break
    return x


def agreement(delta: float | None) -> float | None:
    """Agreement in [0, 1] of two classes whose nearest amounts differ by that share; None where a side has no amount."""
    return None if delta is None else min(max(1.0 - delta / 0.1, 0.0), 1.0)


class _Block:
    """One block, read by rising amounts: its classes, and the least difference between any two of each side.

    The difference is a share of the larger amount. For one amount it grows with the distance among amounts of its sign,
    and is at least 1 for others, so that of all pairs only neighbours in the order of the amounts count; the last amount
    of each class is all that is kept, however many there are.
    """

    def __init__(self, key: tuple[str, str, str]) -> None:
        self.key = key
        self.nearness: dict[tuple[str, str], float] = {}
        self.last: dict[tuple[str, str], float] = {}
        self.delta: dict[tuple[tuple[str, str], tuple[str, str]], float] = {}

    def add(self, side: str, kind: str, nearness: float, amount: float | None) -> None:
        own = side, kind
        self.nearness[own] = max(nearness, self.nearness.get(own, 0.0))
        if amount is None or amount != amount:
            return
        for (other, its_kind), before in self.last.items():
            # a row without a source is also compared with the rows that name theirs
            if other != side or side == "f" and (kind == "") != (its_kind == ""):
                pair = (own, (other, its_kind)) if own < (other, its_kind) else ((other, its_kind), own)
                delta = 0.0 if amount == before else abs(amount - before) / max(abs(amount), abs(before), 1e-9)
                self.delta[pair] = min(delta, self.delta.get(pair, delta))
        self.last[own] = amount

    def side(self, name: str) -> list[tuple[str, float]]:
        """(kind, nearness) of its classes."""
        return sorted((kind, near) for (side, kind), near in self.nearness.items() if side == name)


    def agreement(self, one: tuple[str, str], other: tuple[str, str]) -> float | None:
        """Agreement of two classes to a thousandth."""
        value = agreement(self.delta.get((one, other) if one < other else (other, one)))
        return None if value is None else round(value, 3)

    def pattern(self) -> tuple:
        """All that the rules see of the block: kinds with their nearness, and the agreement of every pair that may be linked."""
        left, right = self.side("e"), self.side("f")
        stated = [kind for kind, _ in right if kind and kind not in dict(left)]
        pairs = []
        for f, _ in right:
            for e, _ in left:
                pairs.append((e, f, self.agreement(("e", e), ("f", f))))
            if not f:
                pairs += [(k, f, self.agreement(("f", k), ("f", f))) for k in stated]
        ties = [(f, self.agreement(("f", ""), ("f", f))) for f, _ in right if f and f in dict(left)] if "" in dict(right) else []
        return tuple(left), tuple(right), tuple(pairs), tuple((f, value) for f, value in ties if value is not None)


def rules(pattern: tuple, first: int, add) -> None:
    """The rules of a block; its pairs are the variables from ``first`` on. add(family, [(variable, coefficient)], constant)."""
    left, right, pairs = dict(pattern[0]), dict(pattern[1]), pattern[2]
    at = {(k, f): first + n for n, (k, f, _) in enumerate(pairs)}
    for k, f, value in pairs:
        v = at[k, f]
        near = left.get(k, 1.0) * right[f]
        if f == k:
            add("same_kind", [(v, -1.0)], near)
        elif f:
            add("other_kind", [(v, 1.0)], 0.0)
        if value is not None:
            add("near_value", [(v, -1.0)], value * near)
            add("far_value", [(v, 1.0)], -value)
        add("few", [(v, 1.0)], 0.0)
    for f, near in right.items():
        mine = [(v, k) for (k, g), v in at.items() if g == f]
        if len(mine) > 1:
            add("exclusive", [(v, 1.0) for v, _ in mine], -1.0)
        if not f:
            add("exists", [(v, -1.0) for v, _ in mine], near * max(left.get(k, 0.0) for _, k in mine))
    for e in left:
        if len(right) > 1:
            add("crowd", [(at[e, f], 1.0) for f in right], -1.0)
    for f, value in pattern[3]:
        add("transitive", [(at[f, f], 1.0), (at[f, ""], -1.0)], value - 1.0)


def solve(patterns: list[tuple], weights: dict[str, float] = WEIGHTS) -> list[list[tuple[str, str, float]]]:
    """For each block's pattern, its links with the confidence of each."""
    parts: dict[tuple[int, bool], tuple[list, list, list, list]] = {}

    def add(family: str, terms: list[tuple[int, float]], const: float) -> None:
        if weights[family]:
            part = parts.setdefault((len(terms), family != "exclusive"), ([], [], [], []))
            for store, item in zip(part, ([v for v, _ in terms], [c for _, c in terms], const, weights[family])):
                store.append(item)

    starts, n = [], 0
    for pattern in patterns:
        starts.append(n)
        rules(pattern, n, add)
        n += len(pattern[2])
    factors = [(np.array(i), np.array(c, float), np.array(k, float), np.array(w, float), squared) for (_, squared), (i, c, k, w) in parts.items()]
    x = hinge_admm(n, factors) if n else np.zeros(0)
    return [[(k, f, float(x[start + m])) for m, (k, f, _) in enumerate(pattern[2]) if k in dict(pattern[0])] for start, pattern in zip(starts, patterns)]


def _solved(blocks: list[_Block]) -> pd.DataFrame:
    patterns = [b.pattern() for b in blocks]
    distinct = list(dict.fromkeys(patterns))
    links = dict(zip(distinct, solve(distinct)))
    rows = [(*b.key, k, f, confidence) for b, pattern in zip(blocks, patterns) for k, f, confidence in links[pattern]]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LINK.split(", ")])


def _linked(frames: Iterator[pd.DataFrame], batch: int = 4000) -> Iterator[pd.DataFrame]:
    """Rows (company, metric, period, side, kind, nearness, amount), those of a block together and by rising amounts."""
    held: _Block | None = None
    blocks: list[_Block] = []

    def close() -> None:
        if held is not None and len({side for side, _ in held.nearness}) == 2:
            blocks.append(held)

    for pdf in frames:
        for *key, side, kind, nearness, amount in pdf.itertuples(index=False, name=None):
            if held is None or tuple(key) != held.key:
                close()
                held = _Block(tuple(key))
            held.add(side, kind, nearness, amount)
        if len(blocks) >= batch:
            yield _solved(blocks)
            blocks = []
    close()
    yield _solved(blocks)


KEY = ["company", "metric", "period"]


def _read(evidence: DataFrame, financials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as rows of (row_key, company, metric, period, kind, nearness, amount); each source is parsed once."""
    e = cut_lineage(spread(evidence.select("evidence_id", "metric_name", "value", "fiscal_year", "source_quote", "doc_name")).mapInPandas(_read_evidence, READ))
    f = cut_lineage(spread(financials.select("fin_row_id", "file_name", "company", "metric", "fiscal_year", "value", "source")).mapInPandas(_read_financials, READ))
    resolved = resolve_companies(e.select("stem", "sector"), f.select("stem", "sector"))
    e = e.join(resolved, ["stem", "sector"]).select("row_key", *KEY, F.col("doc_kind").alias("kind"), (F.col("near") * F.col("nearness")).alias("nearness"), "amount")
    return e, f.select("row_key", F.concat_ws("|", "stem", "sector").alias("company"), "metric", "period", F.col("doc_kind").alias("kind"), F.col("near").alias("nearness"), "amount")


def _links(e: DataFrame, f: DataFrame, threshold: float) -> DataFrame:
    given = e.withColumn("side", F.lit("e")).unionByName(f.withColumn("side", F.lit("f")))
    amounts = given.groupBy(*KEY, "side", "kind", F.round("amount", 4).alias("amount")).agg(F.max("nearness").alias("nearness")).select(*KEY, "side", "kind", "nearness", "amount")
    ordered = amounts.repartition(*KEY).sortWithinPartitions(*KEY, "amount", "side", "kind")
    return ordered.mapInPandas(_linked, LINK).filter(F.col("confidence") >= threshold)


def link(evidence: DataFrame, financials: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(evidence_id, fin_row_id, confidence) of all pairs of rows which state the same fact."""
    e, f = _read(evidence, financials)
    on_e = _links(e, f, threshold).join(e.select(F.col("row_key").alias("evidence_id"), *KEY, F.col("kind").alias("e_kind")), [*KEY, "e_kind"])
    return on_e.join(f.select(F.col("row_key").alias("fin_row_id"), *KEY, F.col("kind").alias("f_kind")), [*KEY, "f_kind"]).select("evidence_id", "fin_row_id", "confidence")


def classes(evidence: DataFrame, financials: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The links between classes, with the number of rows on each side: what ``link`` expands to pairs."""
    e, f = _read(evidence, financials)
    count = lambda d, kind, n: d.groupBy(*KEY, F.col("kind").alias(kind)).agg(F.count("*").alias(n))
    out = _links(e, f, threshold).join(count(e, "e_kind", "n_evidence"), [*KEY, "e_kind"]).join(count(f, "f_kind", "n_financials"), [*KEY, "f_kind"])
    return out.select(*KEY, "e_kind", "f_kind", "confidence", "n_evidence", "n_financials")
