import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quaysift.functions import quantities as Q
from quaysift.operators import units

FE = "evidence_id bigint, run_id string, metric_name string, value string, fiscal_year string, source_quote string, doc_name string, tbl string"
CASES = [
    ("Net Income", "67.5mm", None, 67_500_000), ("Gross Margin", "2105 bps", None, None), ("Gross Margin", "0.101", None, 1010), ("Churn Rate", "12.9%", None, 1290),
    ("Gross Margin", "9.7", None, None), ("Gross Margin (%)", "9.7", None, 970), ("Floor Area", "1,000 sq ft", None, 93), ("Floor space", "2.62", "All figures acres. Floor space Q3 2023 2.62", 10603),
    ("Shipped Weight", "68651 lbs", None, 31140), ("Shipped Weight", "61", "Shipped Weight for 2023Q3 was 61 (short tons).", 55338), ("Energy Use", "651 GJ", None, 180833),
    ("Tank Storage", "4731 hl", None, 473100), ("Tank Storage", "2,225,383 L", None, None), ("Tank capacity", "2321175 gallons (US)", None, 8786603), ("Headcount", "13.13k", None, 13130),
    ("Headcount", "100", "All figures USD mm. Headcount FY2024 100", None), ("Revenue", "thirty-five point eight nine million dollars", None, 35_890_000),
    ("Revenue", "n/a", None, None), ("Revenue", None, None, None), ("Weather", "5M", None, None), ("Net Debt", "($9K)", None, -9000), ("Revenue", "$ 65867000", "Revenue came to $65.9 million.", None),
]


def evidence(spark, rows):
    return spark.createDataFrame([(i, "r", m, v, "FY2024", q, "A_CIM.txt", "x") for i, (m, v, q, _) in enumerate(rows)], FE)


def test_cases(spark):
    out = units.converted(units.common_units(units.financial_evidence_records(evidence(spark, CASES)))).collect()
    assert {r.row_key: r.common_value for r in out} == {i: w for i, (*_, w) in enumerate(CASES) if w is not None}


def test_files_and_sources(spark):
    rows = [(1, "a_metrics_MUSD.csv", "Net Debt", "-0.27", "minutes", -270000), (2, "a_metrics_MUSD.csv", "Headcount", "27", "minutes", None), (3, "a_fin.csv", "Gross Margin", "0.4", "bank model, as a fraction of one", 4000),
            (4, "a_fin.csv", "Headcount", "12.6", "bank model ('000)", 12600), (5, "a-fin_in_thousands.csv", "Energy Use", "301 megawatt-hours", None, 301000), (6, "a_fin_kUSD.csv", "Revenue", "USD 5 million", None, 5000000)]
    df = spark.createDataFrame([(k, f, "A", m, "FY24", v, s) for k, f, m, v, s, _ in rows], "fin_row_id bigint, file_name string, company string, metric string, fiscal_year string, value string, source string")
    got = {r.row_key: r.common_value for r in units.converted(units.common_units(units.financials_records(df))).collect()}
    assert got == {k: w for k, *_, w in rows if w is not None}


# The forms in which quotations state a unit, for a figure of 40.19 whose metric is Net Income.
FORMS = [
    ("net income (in millions of dollars), 2024Q1: 40.19", "million"), ("All figures $ thousands. Net Income FY2024 40.19", "thousand"), ("Table in billions | Net Income | FY24 | 40.19", "billion"),
    ("Net Income for FY24 was 40.19 (USD mm).", "million"), ("Net Income (USD mm) | FY24 | 40.19", "million"), ("Net Income came to 40.19 million in FY24.", "million"), ("In FY24, Net Income came to 40.19, as restated.", "one"),
    ("Fees cost $1.5M. Net Income FY24: 40.19", "one"), ("Net Income was $140.19 million.", "one"), ("Net Income FY24: 40.19\nThe draft (in thousands) is old.", "one"), ("Net Income FY24: 40.19 against 240,000", "one"),
]


@pytest.mark.parametrize("quote,unit", FORMS)
def test_forms_of_quotations(quote, unit):
    name = "net income" if quote.startswith("net") else "Net Income"
    assert units.observe(name, "40.19", quote, None, None)[3][0][0] == unit


def test_repeats(spark):
    rows = [("Revenue", f"{k}M", None, None) for k in range(1, 60)] + [("Revenue", "60", "All figures $m. Revenue 60", None)]
    records = units.financial_evidence_records(evidence(spark, rows))
    out = units.common_units(records.unionByName(records))
    assert out.count() == 120 and units.converted(out).count() == 60


def test_empty(spark):
    assert units.common_units(units.financial_evidence_records(evidence(spark, CASES).filter(F.lit(False)))).count() == 0


def level_case(spark, value, quote, others):
    """The unit decoded for a figure of FY2023 in a series with figures before and after."""
    rows = [(k, "r", "Revenue", v, f"FY20{20 + k}", None, "A_CIM.txt", "x") for k, v in others] + [(3, "r", "Revenue", value, "FY2023", quote, "A_CIM.txt", "x")]
    out = units.common_units(units.financial_evidence_records(spark.createDataFrame(rows, FE)))
    return out.filter("row_key = 3").first().unit


def test_the_level_decides(spark, monkeypatch):
    """A loose mention is taken where the level asks for it and not where it doesn't; without transitions it never is."""
    loose = "Revenue rose, and fees fell by a million. Revenue FY2023: 52.9"
    millions, pieces = [(2, "$51.0M"), (4, "$53.5M")], [(2, "$51"), (4, "$53")]
    assert level_case(spark, "52.9", loose, millions) == "million" and level_case(spark, "52.9", loose, pieces) == "one"
    tied = "All figures in thousands. Revenue FY2023: 52900000"
    assert level_case(spark, "52900000", tied, millions) == "one" and level_case(spark, "52900", tied, millions) == "thousand"
    assert level_case(spark, "52.9", None, millions) == "one"  # a number without any unit is in the common one
    chain = units.Chain(7.7)
    chain.add(("a",), "money", Fraction("52.9"), [("one", 0.0), ("million", units.LOOSE)])
    assert chain.close(7.7) == [(("a",), "million")]
    monkeypatch.setattr(units, "JUMP_MOST", 0.0)
    monkeypatch.setattr(units, "SWITCH", 0.0)
    chain = units.Chain(7.7)
    chain.add(("a",), "money", Fraction("52.9"), [("one", 0.0), ("million", units.LOOSE)])
    assert chain.close(7.7) == [(("a",), "one")]


def test_chain_against_all_paths():
    """Streamed decoding, which gives out what is certain, is the best of all paths."""
    rng = random.Random(5)
    for _ in range(150):
        before, after = (rng.choice([None, rng.uniform(0, 8)]) for _ in range(2))
        steps = [(Fraction(rng.choice([0, 5, 52, 5200, 10**6])), [(u, rng.uniform(-4, 0)) for u in rng.sample(list(Q.UNITS["money"]), rng.randint(1, 3))]) for _ in range(rng.randint(1, 6))]
        chain, got = units.Chain(before), []
        for k, (number, proposals) in enumerate(steps):
            got += chain.add((k,), "money", number, proposals)
        got += chain.close(after)
        assert [r for r, _ in got] == [(k,) for k in range(len(steps))]

        def cost(path):
            levels = [units._level(n, Q.UNITS["money"][u]) for (n, _), (u, _) in zip(steps, path)]
            total = sum(w for _, w in path) - units._jump(before, levels[0]) - units._jump(levels[-1], after)
            return total + sum((0 if a[0] == b[0] else units.SWITCH) - units._jump(x, y) for a, b, x, y in zip(path, path[1:], levels, levels[1:]))

        weights = [dict(p) for _, p in steps]
        best = max(itertools.product(*[p for _, p in steps]), key=cost)
        assert abs(cost([(u, w[u]) for (_, u), w in zip(got, weights)]) - cost(best)) < 1e-9


@pytest.mark.parametrize("kind", list(units.Q.UNITS))
def test_common_unit_is_one(kind):
    assert units.Q.UNITS[kind][units.Q.COMMON[kind]] == 1
