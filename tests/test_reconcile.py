import random

import pytest

from quaysift.functions.normalize import METRIC_ALIASES
from quaysift.operators import reconcile

SCHEMA = "evidence_id bigint, run_id string, metric_name string, value string, value_kind string, fiscal_year string, doc_name string"


def run(spark, rows, tolerance=0.01):
    df = spark.createDataFrame([(i, "r", m, v, "str", p, d) for i, (m, v, p, d) in enumerate(rows)], SCHEMA)
    return reconcile.worst_pairs(reconcile.normalised(df), tolerance)


@pytest.mark.parametrize(("rows", "n"), [
    ([("Revenue", "52.9M", "FY2024", "a"), ("revenue", "$52,900,000", "FY24", "b")], 0),
    ([("Revenue", "$52.9M", "FY2024", "a"), ("revenue", "$48,400,000", "FY24", "b")], 1),
    ([("Revenue", "52.9M", "FY2024", "a"), ("EBITDA", "48.4M", "FY24", "b")], 0),
    ([("Revenue", "52.9M", "FY2024", "a"), ("Revenue", "48.4M", "FY23", "b")], 0),
    ([("Revenue", "n/a", "FY2024", "a"), ("Revenue", "n/a", "FY24", "b")], 0),
    ([("Revenue", "n/a", "FY2024", "a"), ("Revenue", "TBD", "FY24", "b")], 1),
])
def test_flags(spark, rows, n):
    assert run(spark, rows).count() == n


def test_flag_text(spark):
    flag = reconcile.flags(run(spark, [("Revenue", "$52.9M", "FY2024", "CIM"), ("Revenue", "$48,400,000", "FY24", "Tax")])).first().flag
    assert flag == "Revenue discrepancy (FY2024): CIM=$52.9M (norm=52.9M) vs Tax=$48,400,000 (norm=48.4M), delta=8.51%"


def test_against_all_pairs(spark):
    rng = random.Random(5)
    values = ["1M", "1.005M", "1.2M", "-1M", "-1.1M", "0", "n/a", "TBD", "900K", "2M", "(2M)", "3", "-3", "-2.9", ""]
    rows = []
    for g in range(60):
        rows += [(rng.choice(["Revenue", "EBITDA"]), rng.choice(values), f"FY{1980 + g}", "d") for _ in range(rng.randint(1, 6))]
    parsed = {r.evidence_id: r for r in reconcile.normalised(spark.createDataFrame([(i, "r", m, v, "str", p, d) for i, (m, v, p, d) in enumerate(rows)], SCHEMA)).collect()}
    groups = {}
    for r in parsed.values():
        groups.setdefault((r.metric, r.period), []).append(r)
    want = {}
    for key, rs in groups.items():
        rs.sort(key=lambda r: r.evidence_id)
        best = None
        for i, a in enumerate(rs):
            for b in rs[i + 1 :]:
                if a.num is not None and b.num is not None:
                    top = max(abs(a.num), abs(b.num))
                    delta = abs(a.num - b.num) / top if top else 0.0
                    bad = delta > 0.01
                else:
                    delta, bad = None, a.raw != b.raw
                if bad and (best is None or (1.0 if delta is None else delta) > best[0] + 1e-12):
                    best = (1.0 if delta is None else delta, a.evidence_id, b.evidence_id)
        if best:
            want[key] = best
    got = {(r.metric, r.period): (r.delta if r.delta is not None else 1.0, r.a_id, r.b_id) for r in run(spark, rows).collect()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_aliases_are_clean():
    assert all(k == k.lower().strip() for k in METRIC_ALIASES)
