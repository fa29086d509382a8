import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quaysift.functions import text as X
from quaysift.operators import appendix, financial, grounding, quality, review

CLAIM = "section string, section_ord int, claim_ord int, claim_id string, text string, citation_ids array<string>, status string"
EVID = "section string, e_ord int, eid string, doc string, page int, quote string"


def claims_of(spark, statuses):
    return spark.createDataFrame([("s", 0, i, f"c{i}", "t", ["e1"], s) for i, s in enumerate(statuses)], CLAIM)


@pytest.mark.parametrize(("statuses", "want"), [("ssu", 2 / 3), ("sssu", 0.69), ("s", 1.0), ("sssi", 0.69), ("u", 0.0)])
def test_confidence(spark, statuses, want):
    names = {"s": "supported", "u": "unsupported", "i": "insufficient"}
    r = grounding.summary(claims_of(spark, [names[c] for c in statuses])).first()
    assert math.isclose(r.confidence, want) and r.total == len(statuses) and r.needs_repair == (set(statuses) != {"s"})
    assert r.n_supported + r.n_unsupported + r.n_contradicted + r.n_insufficient == r.total


def test_no_claims(spark):
    assert spark.range(1).select(grounding.confidence(F.lit(0), F.lit(0)).alias("c")).first().c == 0.3


def test_verdicts(spark):
    evidence = spark.createDataFrame([("s", 1, "e1", "d", 1, "Revenue grew to ten million in the year"), ("s", 2, "e2", "d", 2, None)], EVID)
    claims = spark.createDataFrame([("s", 0, 0, "c1", "revenue grew to ten million", ["e1"], ""), ("s", 0, 1, "c2", "cats sleep all day", ["e1", "e9"], ""), ("s", 0, 2, "c3", "no source", [], ""), ("s", 0, 3, "c4", "gone", ["e9"], "")], CLAIM)
    got = {r.claim_id: r.status for r in grounding.verify(claims, evidence).collect()}
    assert got == {"c1": "supported", "c2": "unsupported", "c3": "insufficient", "c4": "insufficient"}
    verdicts = spark.createDataFrame([("s", "c1", "contradicted", 1), ("s", "c1", "bogus", 2), ("s", "c2", "supported", 1)], "section string, claim_id string, status string, ord int")
    got = {r.claim_id: r.status for r in grounding.verify(claims, evidence, verdicts).collect()}
    assert got["c1"] == "insufficient" and got["c2"] == "supported"
    gap = grounding.gap_queries(grounding.verify(claims, evidence)).first().gap_query
    assert gap == "cats sleep all day no source gone"
    assert {(r.doc, r.page) for r in grounding.citations(claims, evidence).collect()} == {("d", 1)}


def test_extract_and_bracket(spark):
    evidence = spark.createDataFrame([("s", i, f"e{i}", "d", 1, "q") for i in range(1, 6)], EVID)
    sections = spark.createDataFrame([("s", "A. B.", None)], "section string, narrative string, claims array<struct<claim_id:string,text:string,citation_ids:array<string>,status:string>>")
    c = grounding.extract_claims(sections, evidence).first()
    assert (c.claim_id, c.text, c.citation_ids, c.status) == ("c1", "A. B.", ["e1", "e2", "e3"], "insufficient")
    df = spark.createDataFrame([("x one y one", ["one", "two"])], "n string, t array<string>")
    assert df.select(grounding.bracketed(F.col("n"), F.col("t")).alias("o")).first().o == "x [one] y one\n\n[Unverified claims: two]"


def test_appendix_keys(spark):
    claims = spark.createDataFrame([("a", 0, 0, "c1", "t", ["e1", "e1"], "supported"), ("b", 1, 0, "c1", "t", ["e1"], "supported"), ("b", 1, 1, "c2", "t", [], "insufficient"), ("b", 1, 2, "c3", "t", ["e9"], "supported")], CLAIM)
    evidence = spark.createDataFrame([("a", 1, "e1", "d", 1, "q" * 250), ("b", 1, "e1", "d2", 1, "q")], EVID)
    figures = spark.createDataFrame([("b", 1, 1, "Revenue", "5", "FY24", "q", 1, "d"), ("b", 1, 2, "Revenue", "6", "FY24", "q", 1, "d")], "section string, section_ord int, fig_ord int, metric_name string, value string, fiscal_year string, source_quote string, page int, doc string")
    rows = appendix.build(claims, evidence, figures).collect()
    assert sorted((r.section, r.entry_type, r.claim_id or "", r.evidence_id or "") for r in rows) == [("a", "claim", "c1", "e1"), ("b", "claim", "c1", "e1"), ("b", "claim", "c2", ""), ("b", "fin", "", "")]
    assert next(r for r in rows if r.section == "a").quote == "q" * 200 + "..." and next(r for r in rows if r.entry_type == "fin").value == "5"
    assert len(appendix.build(claims, evidence, figures, compat=True).collect()) == 3


def test_review(spark):
    sections = spark.createDataFrame([("r", "A", 1, 0.5), ("r", "B", 2, 0.9), ("q", "A", 1, 0.8)], "run_id string, section string, section_ord int, confidence double")
    schema = "run_id string, seq int, action string, section string, reason string, ts string"
    actions = spark.createDataFrame([("r", 1, "export", None, None, "t"), ("r", 2, "approve", "A", "  ok ", "t"), ("r", 3, "export", None, None, "t"), ("r", 4, "edit", "A", None, "t"), ("r", 5, "export", None, None, "t"), ("r", 6, "approve", "A", " ", "t"), ("r", 7, "export", None, None, "t"), ("r", 8, "approve", "Z", "x", "t"), ("q", 1, "export", None, None, "t")], schema)
    got = {(r.run_id, r.seq): (r.allowed, r.version) for r in review.versions(sections, actions).collect()}
    assert got == {("r", 1): (False, None), ("r", 3): (True, 1), ("r", 5): (False, None), ("r", 7): (True, 2), ("q", 1): (True, 1)}
    folded = review.state(sections, actions)
    assert {(r.run_id, r.export_allowed) for r in review.gate(folded).collect()} == {("r", True), ("q", True)}
    assert review.gate(review.state(sections, actions.filter("seq < 2"))).filter("NOT export_allowed").first().n_pending == 1
    assert review.unknown_titles(actions.filter("action = 'approve'"), sections).count() == 1
    codes = spark.createDataFrame([(None, True, 404), ("running", True, 202), ("error", True, 500), ("complete", False, 500), ("complete", True, 200)], "s string, m boolean, want int")
    assert codes.filter(review.job_guard(F.col("s"), F.col("m")) != F.col("want")).count() == 0
    errors = spark.createDataFrame([("429 quota", "rate_limited"), ("API key missing", "missing_api_key"), ("Embedding failed", "embedding_error"), ("a timeout", "timeout"), ("rate was over its limit", "rate_limited"), ("deadline exceeded", "pipeline_error"), ("no documents found", "pipeline_error"), (None, "pipeline_error")], "m string, want string")
    assert errors.filter(review.error_code(F.col("m")) != F.col("want")).count() == 0
    again = spark.createDataFrame([("Internal error", None, True), ("getaddrinfo failed", None, True), ("quota", None, False), ("x", 504, True), ("x", 400, False), (None, None, False)], "m string, c int, want boolean")
    assert again.filter(review.retryable(F.col("m"), F.col("c")) != F.col("want")).count() == 0


def test_flag_scores(spark):
    rows = [("a", "totally one thing"), ("b", "Note: Revenue discrepancy (FY 2024): x"), ("c", None)]
    other = [("a", "quite another"), ("b", "note:  revenue discrepancy (FY2024)"), ("d", "same  Text ")]
    p, e = (spark.createDataFrame(r, "case_id string, flag string").filter("flag IS NOT NULL") for r in (rows, other))
    assert {r.case_id: (r.tp, r.fp, r.fn) for r in quality.flag_scores(p, e).collect()} == {"a": (0, 1, 1), "b": (1, 0, 0), "d": (0, 0, 1)}


def test_slots(spark):
    rows = [("r", 1, "Market & Industry"), ("r", 2, "Financial Market Risks"), ("r", 3, "Management Team"), ("r", 4, "management team"), ("q", 1, "Risks")]
    got = {(r.run_id, r.slot): r.title for r in appendix.section_slots(spark.createDataFrame(rows, "run_id string, section_ord int, title string"), ["run_id"]).collect()}
    assert got == {
        ("r", "MARKET_INDUSTRY"): "Market & Industry", ("r", "MARKET_OVERVIEW"): "Market & Industry", ("r", "FINANCIAL_MARKET_RISKS"): "Financial Market Risks", ("r", "RISKS"): "Financial Market Risks",
        ("r", "KEY_FINANCIAL_METRICS"): "Financial Market Risks", ("r", "MANAGEMENT_TEAM"): "management team", ("q", "RISKS"): "Risks",
    }


def test_brackets(spark):
    rows = [("x one. one  ", ["one", "[one]", "two", ""], "x [[one]]. one\n\n[Unverified claims: two; ]"), ("all", [], "all"), ("a b", ["b", "a"], "[a] [b]")]
    df = spark.createDataFrame(rows, "n string, t array<string>, want string")
    assert [r.o for r in df.select(grounding.bracketed(F.col("n"), F.col("t")).alias("o")).collect()] == [r[2] for r in rows]


def test_brackets_of_long_narratives(spark):
    """Thousands of texts of one narrative: the rows of the plain fold, in seconds."""
    rng = random.Random(4)

    def fold(content, texts):
        for t in texts:
            content = content.replace(t, f"[{t}]", 1) if t else content
        missing = [t for t in texts if f"[{t}]" not in content]
        return content.rstrip() + "\n\n[Unverified claims: " + "; ".join(t[:120] for t in missing[:5]) + "]" if missing else content

    texts = ["".join(rng.choices("abcdefg ", k=rng.randint(60, 330))) + "." for _ in range(3000)]
    texts += [t[5:40] for t in texts[:50]] + ["[sic]", "]", ""]
    few = [("".join(rng.choices("ab[] ", k=20)), ["".join(rng.choices("ab[]", k=rng.randint(0, 4))) for _ in range(6)]) for _ in range(200)]
    rows = [(i, n, t) for i, (n, t) in enumerate([(" ".join(texts[:2900]), texts), *few])] + [(-1, None, ["a"]), (-2, "a", None)]
    df = spark.createDataFrame(rows, "i int, n string, t array<string>")
    start = time.perf_counter()
    got = {r.i: r.o for r in df.select("i", grounding.bracketed(F.col("n"), F.col("t")).alias("o")).collect()}
    assert time.perf_counter() - start < 30
    assert got == {i: None if n is None or t is None else fold(n, t) for i, n, t in rows}


def test_flag_matching(spark):
    rows = [("a", "p", 0, "Revenue discrepancy (FY2024): CIM=1 vs Tax=2; delta 8%"), ("a", "e", 0, "revenue  discrepancy (FY 2024)"), ("b", "p", 0, "X discrepancy (FY1)"), ("b", "p", 1, "Y discrepancy (FY1)"), ("b", "e", 0, "Y discrepancy (FY1)"), ("c", "e", 0, "free text"), ("d", "p", 0, "the free text here"), ("d", "e", 0, "free text")]
    flags = spark.createDataFrame(rows, "case_id string, side string, ord int, flag string")
    got = {r.case_id: (r.tp, r.fp, r.fn) for r in quality.greedy_matches(flags).collect()}
    assert got == {"a": (1, 0, 0), "b": (1, 1, 0), "c": (0, 0, 1), "d": (1, 0, 0)}
    signed = flags.filter("case_id IN ('a', 'b')")
    scored = quality.precision_recall(quality.flag_scores(signed.filter("side = 'p'"), signed.filter("side = 'e'")))
    assert {r.case_id: (r.tp, r.fp, r.fn, round(r.f1, 3)) for r in scored.collect()} == {"a": (1, 0, 0, 1.0), "b": (1, 1, 0, 0.667)}


def test_rates_and_cost(spark):
    r = quality.claim_rates(claims_of(spark, ["supported", "supported", "unsupported", "insufficient"]), ["section"]).first()
    assert (r.support_rate, r.unsupported_rate) == (0.5, 0.25)
    events = spark.createDataFrame([("x", 1, 2.0, 400, None), ("x", 2, 3.0, None, 1000)], "name string, ord int, latency_ms double, chars int, tokens_known bigint")
    costed = quality.cost_events(events, 1.0)
    total = quality.cost_summary(costed).first()
    assert (total.calls, total.tokens, total.cost) == (2, 1100, 1.1) and quality.cost_by_name(costed).first().tokens == 1000


def test_figures(spark):
    chunks = spark.createDataFrame([("d", 1, 0, "Backlog exiting FY2022: $152,100\nARR for FY2019 came to $0.48 million, by count."), ("d", 1, 1, None)], "doc_name string, page int, pos bigint, text string")
    assert {(r.metric_name, r.fiscal_year, r.value) for r in financial.labelled_figures(chunks).collect()} == {("Backlog", "FY2022", "$152,100"), ("ARR", "FY2019", "$0.48 million")}
    good = '{"company_name": "Acme", "metrics": [{"metric_name": "Revenue", "value": 5, "fiscal_year": "FY24"}]}'
    bad = '{"company_name": "unknown", "metrics": [{"metric_name": "Revenue", "value": 5, "page_number": 0}]}'
    answers = spark.createDataFrame([(0, "a", bad), (1, "b", good), (2, "c", "no json")], "doc_ord int, doc_name string, answer string")
    assert [(r.doc_name, r.value, r.page_number) for r in financial.parse_answers(answers).collect()] == [("b", "5", 1)]
    assert financial.first_company(answers).first().company_name == "Acme"


def test_sections_without_claims(spark):
    claims = spark.createDataFrame([("A", "supported", ["e1"]), ("A", "supported", ["e2"])], "section string, status string, citation_ids array<string>")
    out = {r.section: (r.total, r.confidence, r.needs_repair) for r in grounding.summary(claims, 0.7, spark.createDataFrame([("A",), ("B",), ("B",)], "section string")).collect()}
    assert out == {"A": (2, 1.0, False), "B": (0, 0.3, True)}


def test_find_section_and_percent(spark):
    rows = [("r", 2, "Key Risks"), ("r", 1, "Key Risks"), ("r", 3, "A+B"), ("q", 1, "Other")]
    sections = spark.createDataFrame(rows, "run_id string, section_ord int, section string")
    assert [(r.run_id, r.section_ord) for r in review.find_section(sections, "Key%20Risks").collect()] == [("r", 1)]
    assert review.find_section(sections, "A+B").count() == 1 and review.find_section(sections, "50%").count() == 0
    shares = [(0.125, "12%"), (0.375, "38%"), (1.0, "100%"), (0.0, "0%"), (None, None)]
    df = spark.createDataFrame(shares, "x double, want string")
    assert [(r.x, r.p) for r in df.select("x", X.percent(F.col("x")).alias("p")).collect()] == shares
