import math

import pytest
from pyspark.sql import functions as F

from quaysift.functions import normalize as N
from quaysift.functions import ontology as O
from quaysift.functions import quantities as Q

AMOUNTS = [
    ("$52.9M", 52.9e6), ("52.9B", 52.9e9), ("$48,400,000", 48.4e6), ("(1.2M)", -1.2e6), ("$(1.2M)", -1.2e6), ("$(450K)", -450e3), ("58%", 58.0),
    ("1,850,000", 1.85e6), ("15%", 15.0), ("$52,900,000,000", 52.9e9), ("", None), ("52.9 million", None), ("5mm", 5e6), ("2bn", 2e9), ("1t", 1e12),
    ("USD 5M", 5e6), ("-$5", -5.0), ("(5%)", -5.0), ("1e6", 1e6), ("5d", None), (None, None), ("n/a", None), ("5.", 5.0), ("-5.", -5.0),
]
METRICS = [("rev", "revenue"), ("Net Sales", "revenue"), ("EBITDA", "ebitda"), ("Total Revenue", "revenue"), ("Adj. EBITDA", "ebitda"), ("Net-Income", "net_income"), ("EBITDA margin", "ebitda_margin"), ("", "unknown"), (None, "unknown")]
PERIODS = [("Trailing  Twelve Months", "TTM"), ("2024/Q3", "Q3FY2024"), ("2024_Q3", "Q3FY2024"), ("Q1-2024", "Q1FY2024"), ("Q3/24", "Q3FY2024"), ("half-year 24", "HALF-YEAR24"),
    ("FY24", "FY2024"), ("FY2024", "FY2024"), ("TTM", "TTM"), ("LTM", "TTM"), ("Q1'24", "Q1FY2024"), ("1Q24", "Q1FY2024"), ("2024Q3", "Q3FY2024"), ("2024 Q3", "Q3FY2024"),
    ("FY24 Q3", "Q3FY2024"), ("2024-Q3", "Q3FY2024"), ("FY85", "FY1985"), ("2023", "FY2023"), ("", "unknown"), (None, "unknown"), ("H1 2024", "H12024"),
]


def test_amounts(spark):
    df = spark.createDataFrame([(v, "str", i) for i, (v, _) in enumerate(AMOUNTS)], "value string, value_kind string, i int")
    got = {r.i: r.num for r in N.with_numeric(df, "value", "value_kind").collect()}
    for i, (v, want) in enumerate(AMOUNTS):
        assert (got[i] is None) == (want is None), v
        assert want is None or math.isclose(got[i], want), v
    assert N.with_numeric(df.withColumn("value_kind", F.lit("bool")), "value", "value_kind").filter("num IS NOT NULL").count() == 0


def test_metrics_and_periods(spark):
    m = spark.createDataFrame(METRICS, "name string, want string")
    assert N.with_metric(m, "name").filter("metric <> want").count() == 0
    p = spark.createDataFrame(PERIODS, "text string, want string")
    assert N.with_period(p, "text").filter("period <> want").collect() == []


def test_agreement(spark):
    rows = spark.createDataFrame([(100.0, 100.5, True), (52.9e6, 48.4e6, False), (0.0, 0.0, True), (-1.0, 1.0, False)], "a double, b double, want boolean")
    assert rows.filter(N.values_agree(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_shown(spark):
    cases = [(52.9e6, "52.9M"), (48.4e6, "48.4M"), (1234.0, "1.234K"), (999999.0, "1000K"), (0.0, "0"), (12.0, "12"), (0.583333333, "0.583333"), (-2.5e9, "-2.5B"), (44235000.0, "%.4gM" % 44.235), (7.1368e15, "7.137e+06B"), (1.2e12, "1200B")]
    df = spark.createDataFrame(cases, "n double, want string")
    assert [(r.n, r.shown) for r in N.with_shown(df, "n", "shown").collect()] == cases


@pytest.mark.parametrize(("text", "want"), [("Q3 2021", "Q3FY2021"), ("FY 2024", "FY2024"), ("Fiscal 2022", "FY2022"), ("fy'24", "FY2024"), ("Trailing Twelve Months", "TTM"), ("Q1FY2023", "Q1FY2023"), ("soon", None), (None, None)])
def test_resolved_periods(text, want):
    assert O.resolve_period(text) == want


@pytest.mark.parametrize(("text", "want"), [("Net  Debt", "net_debt"), ("Debt, net, US$m", "net_debt"), ("Recurring revenue (annualised) (USD mm)", "arr"), ("EBIDTA", "ebitda"), ("EBITDA Margin pct", "ebitda_margin"), ("Gros Margin", "gross_margin"), ("weather", None), (None, None)])
def test_resolved_metrics(text, want):
    assert O.resolve_metric(text) == want


def test_one_slip_against_brute_force():
    from itertools import product

    def brute(a, b):
        if a == b:
            return True
        letters = set(a + b)
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
        edits |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in edits

    words = ["".join(w) for n in range(1, 5) for w in product("ab", repeat=n)]
    for a in words:
        for b in words:
            assert O.one_slip(a, b) == brute(a, b), (a, b)


def test_number_words_and_forms():
    assert Q.words_to_number("two hundred and sixty-two point eight million dollars") == 262_800_000
    assert Q.words_to_number("minus three hundred and two point seven million") == -302_700_000
    assert Q.parse_number("$10'183'719")[0] == 10183719 and Q.parse_number("27 835 000")[0] == 27835000
    assert Q.parse_number("(USD 9.5)")[0] == Q.Fraction("-9.5") and Q.parse_number("45.7 Mio. USD")[0] == Q.Fraction("45.7")
    assert Q.parse_number("see note") is None and Q.parse_number(None) is None and Q.parse_number("") is None
    assert Q.half_away(Q.Fraction(5, 2)) == 3 and Q.half_away(Q.Fraction(-5, 2)) == -3
