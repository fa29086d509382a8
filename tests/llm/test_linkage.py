import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaysift.functions import ontology as O
from quaysift.llm import linkage as L

FE = "evidence_id bigint, metric_name string, value string, fiscal_year string, source_quote string, doc_name string, company string"
FI = "fin_row_id bigint, file_name string, company string, metric string, fiscal_year string, value string, source string, metric_name string"


def pairs(spark, evidence, financials):
    e = spark.createDataFrame([(*r, "clash") for r in evidence], FE)
    f = spark.createDataFrame([(*r, "clash") for r in financials], FI)
    return {(r.evidence_id, r.fin_row_id) for r in L.link(e, f).collect()}


EVIDENCE = [
    (1, "Revenue", "5.2M", "FY2024", None, "Mardovane_Foods_CIM.pdf"), (2, "Sales", "n/a", "FY24", None, "Mardovne Foods Info Memo.pdf"), (3, "Revenue", "9M", "FY2024", None, "mardovane-foods-tax-return.txt"),
    (4, "Revenue", "5.2M", "", "Sales FY24: 5.2M", "Mardovane_Foods_CIM.pdf"), (5, "Revenue", "5.2M", "FY2024", None, "unknown"), (6, "Revenue", "5.2M", None, None, None), (7, "EBITDA", "1M", "Q1'24", None, "Mardovane_Foods_BoardPresentation.docx::P&L"),
    (8, "Revenue", "5.2M", "FY2024", None, "Zukelimar_CIM.pdf"), (9, None, None, "FY2024", None, "Mardovane_Foods_CIM.pdf"),
]
FINANCIALS = [
    (11, "mardovane_foods_financials.csv", None, "Turnover", "2024", "5,200,000", "Information memorandum"), (12, "mardovane_foods_financials.csv", "X", "Net Sales", "FY 2024", "9.0", "Tax ret. ($m)"),
    (13, "mardovane_foods_financials.csv", "X", "Ebitda", "1Q24", None, None), (14, "mardovane_freight-fin_MUSD.csv", "X", "Revenue", "FY2024", "5.2", "CIM"), (15, "mardovane_foods_financials.csv", "X", "Turnover", "2024", "5,200,000", "CIM"),
]


def test_pairs(spark):
    want = {(1, 11), (1, 15), (2, 11), (2, 15), (4, 11), (4, 15), (3, 12), (7, 13)}
    assert pairs(spark, EVIDENCE, FINANCIALS) == want


def test_empty_and_repeated(spark):
    assert pairs(spark, EVIDENCE[:1] * 2, FINANCIALS[:1]) == {(1, 11)}
    e = spark.createDataFrame([(*EVIDENCE[0], "x")], FE)
    f = spark.createDataFrame([(*FINANCIALS[0], "x")], FI)
    assert L.link(e.filter(F.lit(False)), f).count() == 0 and L.link(e, f.filter(F.lit(False))).count() == 0


def test_many_amounts_of_one_class(spark):
    """The value that agrees is the largest of a hundred in its class; a null source leaves the link to the value."""
    many = [(i, "Revenue", f"{i}M", "FY2024", None, "Mardovane_Foods_CIM.pdf") for i in range(1, 101)]
    other = [(200, "Revenue", "900M", "FY2024", None, "Mardovane_Foods_tax_return.txt")]
    own = [(11, "mardovane_foods_financials.csv", "X", "Revenue", "FY2024", "100M", None)]
    assert pairs(spark, many + other, own) == {(i, 11) for i in range(1, 101)}


def test_nearest_amounts_against_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice("ef"), rng.choice("ab"), 1.0, rng.choice([None, 0.0, round(rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 6), 4)])) for _ in range(rng.randint(1, 30))]
        block = L._Block(("c", "m", "p"))
        for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0.0)):
            block.add(*r)
        for e in "ab":
            for f in "ab":
                deltas = [abs(x - y) / max(abs(x), abs(y), 1e-9) for s, k, _, x in rows for t, h, _, y in rows if (s, k, t, h) == ("e", e, "f", f) and x is not None and y is not None]
                assert block.agreement(("e", e), ("f", f)) == (round(L.agreement(min(deltas)), 3) if deltas else None)


def test_admm_against_grid():
    rng = random.Random(2)
    for _ in range(8):
        n = 2
        factors = []
        for _ in range(4):
            index = np.array([[0, 1]])
            coef = np.array([[rng.choice([-1.0, 1.0]), rng.choice([-1.0, 1.0])]])
            factors.append((index, coef, np.array([rng.uniform(-1, 1)]), np.array([rng.uniform(0.2, 3)]), rng.random() < 0.5))
        cost = lambda x: sum(float(w[0]) * max(0.0, float((c[0] * x).sum() + k[0])) ** (1 + q) for _, c, k, w, q in factors)
        got = L.hinge_admm(n, factors, rounds=3000, tolerance=1e-7)
        grid = min(cost(np.array([a, b])) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1, 41))
        assert cost(got) <= grid + 0.02


# Blocks: (evidence kinds with nearness), (rows' kinds with nearness, "" without source), (pair, agreement), (kind, agreement of its row with the one without source).
BLOCKS = [
    ((("cim", 1.0),), (("cim", 1.0),), (("cim", "cim", 0.2),), ()),
    ((("cim", 1.0), ("tax", 1.0)), (("cim", 1.0), ("tax", 1.0)), (("cim", "cim", 1.0), ("tax", "cim", 0.9), ("cim", "tax", 0.9), ("tax", "tax", 1.0)), ()),
    ((("cim", 1.0), ("tax", 1.0)), (("", 1.0),), (("cim", "", 1.0), ("tax", "", 0.9)), ()),
    ((("cim", 1.0),), (("", 1.0), ("tax", 1.0)), (("cim", "", 0.0), ("tax", "", 1.0), ("cim", "tax", 0.0)), ()),
    ((("cim", 1.0), ("tax", 0.9)), (("cim", 1.0), ("", 1.0)), (("cim", "cim", None), ("tax", "cim", None), ("cim", "", None), ("tax", "", None)), (("cim", 1.0),)),
    ((("cim", 1.0),), (("", 1.0),), (("cim", "", None),), ()),
]


def test_what_the_rules_give():
    same, crossed, null, other, tied, only = L.solve(BLOCKS)
    assert same[0][2] > 0.7 and only[0][2] > 0.7
    assert {(k, f) for k, f, x in crossed if x >= 0.5} == {("cim", "cim"), ("tax", "tax")}
    assert null[0][2] >= 0.5 > null[1][2]
    assert {(k, f): x >= 0.5 for k, f, x in other} == {("cim", ""): False, ("cim", "tax"): False}
    assert {(k, f) for k, f, x in tied if x >= 0.5} == {("cim", "cim"), ("cim", "")}


@pytest.mark.parametrize("family", list(L.WEIGHTS))
def test_every_family_of_rules_counts(family):
    full = [x for block in L.solve(BLOCKS) for *_, x in block]
    less = [x for block in L.solve(BLOCKS, L.WEIGHTS | {family: 0.0}) for *_, x in block]
    assert max(abs(a - b) for a, b in zip(full, less)) > 0.003


@pytest.mark.parametrize("families", [("same_kind",), ("other_kind", "exclusive"), ("exists",), ("transitive",)])
def test_links_fall_or_rise_without_rules(families):
    chosen = lambda w: [[x >= 0.5 for *_, x in block] for block in L.solve(BLOCKS, w)]
    assert chosen(L.WEIGHTS) != chosen(L.WEIGHTS | dict.fromkeys(families, 0.0))


def test_slips(spark):
    names = [("abcdef", "abcdef", True), ("abcdef", "abdcef", True), ("abcdef", "abcde", True), ("abcdef", "abxdef", True), ("abcdef", "abxyef", False), ("abcdef", "badcef", False), ("abcdef", "fbcdea", False)]
    df = spark.createDataFrame(names, "a string, b string, want boolean")
    assert df.filter(L._one_slip("a", "b") != F.col("want")).count() == 0
    assert all(O.one_slip(a, b) == want for a, b, want in names)


def test_classes(spark):
    e = spark.createDataFrame([(*r, "clash") for r in EVIDENCE], FE)
    f = spark.createDataFrame([(*r, "clash") for r in FINANCIALS], FI)
    out = L.classes(e, f).collect()
    assert sum(r.n_evidence * r.n_financials for r in out) == 8 and all(0.5 <= r.confidence <= 1 for r in out)


def test_titles():
    assert L.company_of_document("Brisorzor_Freight_Information_Memorandum.txt") == ("brisorzor", "freight")
    assert L.company_of_document("BRISORIZOR FREIGHT LenderModel (1).csv::KPIs") == ("brisorizor", "freight") and L.company_of_document("unknown") is None
    assert L.company_of_file("nifoxerel_energy financials_in_thousands.csv", None) == ("nifoxerel", "energy") and L.company_of_file(None, None) is None
