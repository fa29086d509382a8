import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaysift.llm import encoding, leakage, packing, pii, splitting, truncation


# ---- splitting ---------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .\n|-,", min_size=61, max_size=500), st.integers(40, 60), st.integers(0, 15))
def test_pieces_tile(text, limit, overlap):
    at = 0
    for k, (start, content, end) in enumerate(splitting.split(text, limit, overlap)):
        assert content == at and start <= content < end and end - start <= limit and content - start <= overlap and (k or start == 0)
        at = end
    assert at == len(text)


def test_pieces_frame(spark):
    rows = [(1, "x" * 3000, "d"), (2, "short", "d"), (3, None, "d"), (4, " " * 900, "d"), (5, ("A heading\n" + "Some sentence here. " * 20 + "\n\n") * 4, "d"), (5, "y " * 500, "e")]
    df = spark.createDataFrame(rows, "piece bigint, text string, start string")
    out = splitting.pieces(df, "piece", "text", ["start"]).toDF("key", "kept", "piece", "n", "start", "content", "end", "body").collect()
    assert {r.key for r in out} == {1, 4, 5} and all(len(r.body) <= 800 and r.n > 1 for r in out)
    assert splitting.pieces(df.filter(F.lit(False)), "piece", "text").count() == 0
    heads = [r.body for r in out if r.key == 5 and r.kept == "d"]
    assert all(not h.rstrip().endswith("A heading") for h in heads)


def test_tree():
    """Headings cut by depth, items by indentation; a line in lower case heads nothing."""
    assert [splitting._depth(x) for x in ("# A", "### B", "<h2>C</h2>", "1.2 Scope", "Open points", "the following lower case words", "- item", "a | b | c", "Ends here.")] == [1, 3, 2, 2, 7, None, None, None, None]
    body = "word " * 12
    text = f"# One\n{body}\n## A\n{body}\n## B\n{body}\n# Two\n{body}\n"
    heads = lambda room: [text[a:b].split("\n")[0] for a, b in splitting.pack(text, 0, len(text), room)]
    assert heads(100) == ["# One", "## A", "## B", "# Two"] and heads(200) == ["# One", "# Two"]
    items = "".join(f"- top {k}\n" + f"  - {body}\n" * 2 for k in range(3))
    cut = splitting.pack(items, 0, len(items), 150)
    assert all(items[a:b].startswith("- top") and b - a <= 150 for a, b in cut) and len(cut) == 3
    deep = "#" + " x" * 40 + "\n"
    assert splitting.pack(deep * 3, 0, len(deep) * 3, len(deep)) == [(k * len(deep), (k + 1) * len(deep)) for k in range(3)]


# ---- truncation --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "verdict"), [
    (None, "complete"), ("  ", "complete"), ("(empty)", "complete"), ("All is well.", "complete"), ("We met the audit firm and", "undecided"), ("One. Two is not", "cut"), ("It ends here...", "cut"), ("It ends here…", "cut"),
    ("He said (in part", "cut"), ("“Quoted text", "cut"), ("[Bracketed]", "complete"), ("a | b | c\n1 | 2 | 3\n4 | 5", "cut"), ("a | b\n1 | 2", "undecided"), ("EIN 1 and company no.", "cut"), ("NI number QQ 13 23 02 C.", "complete"), ("Broken \\u00", "cut"), ("Bad �", "cut"),
])
def test_verdicts(text, verdict):
    assert truncation.judge(text)[0] == verdict


def test_cut_rows(spark):
    good = [("t", i, "s", f"Owner: The board\nStatus: modest\nBody number {i} ends well.\nOpen points\nNet sales FY20{i}: $1,200\nLast words here.") for i in range(10, 16)]
    cases = [("t", 1, "s", "Fine.\nOwner: The board"), ("t", 2, "s", "Fine.\nOwner: The boa"), ("t", 3, "s", "Fine.\nOpen points"), ("t", 4, "s", "Fine.\nNet sales FY2031: $9,999"), ("t", 5, "s", "Fine.\nOpen poi"), ("t", 6, "s", None), ("t", 2, "s", "Fine.\nOwner: The boa"), ("t", 7, "s", "Fine.\ncc: a.b@c.example")]
    df = spark.createDataFrame(good + cases, "tbl string, row_key bigint, source string, text string")
    out = truncation.check(df)
    assert {r.row_key for r in out.filter("cut").collect()} == {2, 5} and out.count() == len(good) + len(cases)
    s = truncation.shares(out).first()
    assert (s.n_rows, s.n_cut) == (14, 3) and truncation.check(df.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize(("text", "open_"), [
    ("a (b [c] d", ["("]), ("<b>bold</b> and <i>on", ["<i>"]), ("<p>one<br>two", []), ("<div><b>x</div>", []), ("```\ncode", ["```"]), ("5 < 6 and 7 > 3", []), ("„so“ und „so", ["„"]), ('say "x" and "y', ['"']), ("a) b]", []),
])
def test_stack(text, open_):
    assert truncation.open_at_end(text) == open_


def test_stack_decides(monkeypatch):
    """Texts that end well but leave something open are cut by the automaton alone."""
    texts = ["He said “we will wait. And so it went.", "The list (first part. It ends here.", "<b>All of it. Done.", "```\nx = 1."]
    assert [truncation.judge(t)[0] for t in texts] == ["cut"] * 4
    monkeypatch.setattr(truncation, "open_at_end", lambda text: [])
    assert [truncation.judge(t)[0] for t in texts] == ["complete"] * 4


def test_baseline_of_the_source(spark):
    """One occurrence within other texts is enough in a source without sure cuts, five times as many are asked at a source's limit."""
    schema = "tbl string, row_key bigint, source string, text string"
    steady = [("t", 1, "s", "Open points\nAll is well."), ("t", 2, "s", "Fine.\nOpen points")]
    assert truncation.check(spark.createDataFrame(steady, schema)).filter("cut").count() == 0
    shaky = [*steady, ("t", 3, "s", "It ends here...")]
    assert {r.row_key for r in truncation.check(spark.createDataFrame(shaky, schema)).filter("cut").collect()} == {2, 3}
    size = len("Fine.\nOpen points")
    piled = [("t", 10 + k, "s", "(" + "x" * (size - 1)) for k in range(9)] + [("t", 30 + k, "s", "Open points\nAll is well.") for k in range(4)] + steady[1:]
    assert 2 in {r.row_key for r in truncation.check(spark.createDataFrame(piled, schema)).filter("cut").collect()}


# ---- packing -----------------------------------------------------------------------------------------------------


def test_fill_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        lengths = {n: rng.randint(0, 3) for n in rng.sample(range(1, 15), 4)}
        room = rng.randint(0, 40)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = packing.fill(lengths, room)
        assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= room) and all(c <= lengths[n] for n, c in used.items())


def test_pack(spark):
    rng = random.Random(1)
    lengths = [(i, rng.randint(0, 90)) for i in range(200)] + [(500, 350), (501, 200), (502, 0)]
    df = spark.createDataFrame(lengths, "doc_id bigint, tokens int")
    targets = spark.createDataFrame([("small", 100), ("large", 1000), ("none", 0)], "target_name string, capacity_tokens int")
    for per_block in (10_000, 40):
        out = packing.pack(df, targets, per_block=per_block).collect()
        for name, capacity in (("small", 100), ("large", 1000)):
            mine = [r for r in out if r.target_name == name]
            total = {}
            for r in mine:
                total[r.container] = total.get(r.container, 0) + r.tokens
            assert max(total.values()) <= capacity and all(total[r.container] == r.fill for r in mine)
            per_doc = {}
            for r in mine:
                per_doc.setdefault(r.doc_id, []).append(r.tokens)
            assert {k: sum(v) for k, v in per_doc.items()} == dict(lengths) and all(len(v) == 1 for k, v in per_doc.items() if dict(lengths)[k] <= capacity)
            # items above half the capacity cannot share, so a bin or two in a hundred may stay open
            assert len(total) <= 1.06 * sum(t for _, t in lengths) / capacity + 2
    assert packing.pack(df.filter(F.lit(False)), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "k bigint, t string")
    assert {r.doc_id: r.tokens for r in packing.token_counts(df, "k", "t").collect()} == {1: 2, 2: 0, 3: 0}


# ---- leakage -----------------------------------------------------------------------------------------------------

ITEM = "Decide whether it holds: The harbour annuity covers 54,237 hampers. Calisipimar Foundling ring-fenced $118,596 of it soon after the ropewalk was sold. Of 16,102 drums held at the vault, an interim trustee assigned 89,518."
OTHER = "Decide whether it holds: By June 2011 a retired comptroller had counted 18,802 fathoms at Gorse Point. Segimorel Ropeyard hived off $491,063 of dock levies in July 2011."
THIRD = "Decide whether it holds: Quince Wharf earned $4,677,571 from loom royalties in 2014. The wharf steward puts toll credits at $381,013 near the Ardle mill."
BODY = ITEM.split(": ", 1)[1]


def test_leaks(spark):
    docs = [
        (1, f"Intro text. {BODY} The end."), (2, "Decide whether it holds: something else entirely was said here by nobody."), (3, BODY.upper().replace(",", "")), (4, BODY.replace(" ", "\n> ")), (5, "He spoke of the harbour annuity once."),
        (6, BODY.replace("hampers", "ham​pers").replace("sold", "so­ld")), (7, None), (8, ""), (9, BODY[: len(BODY) // 2]), (1, f"Intro text. {BODY} The end."), (10, BODY.replace("a", "а")), (11, "word " * 20000 + OTHER),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, THIRD), (4, None), (5, "")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(d, i).collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (1, 6), (1, 9), (1, 10), (2, 11)}
    assert {(r.item_id, r.doc_id) for r in leakage.leaked(d, i, block=2).collect()} == got
    assert leakage.leaked(d.filter(F.lit(False)), i).count() == 0 and leakage.leaked(d, i.filter(F.lit(False))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_tiles(a, b):
    found = leakage.tiles(a, b)
    if len(a) >= 2 and len(b) >= 2:
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(2, 26) if a[i : i + n] == b[j : j + n] and len(a[i : i + n]) == n), default=0)
        assert max((n for *_, n in found), default=0) == longest
    used_a, used_b = set(), set()
    for i, j, n in found:
        assert a[i : i + n] == b[j : j + n]
        assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


# ---- encoding ----------------------------------------------------------------------------------------------------

TEXT = "Die Geschäftsführung erklärt den Rückgang mit höheren Löhnen. “We would rather wait,” said the reviewer’s aide for £5m."


@pytest.mark.parametrize(("wrong", "right"), [("cp1252", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8")])
def test_round_trip(wrong, right):
    inverse = {v: k for k, v in encoding._bytes_of(wrong).items()}
    garbled = "".join(inverse[b] for b in TEXT.encode(right))
    assert encoding.restore(garbled)[:3] == (TEXT, True, True)
    assert encoding.restore("Unharmed line. " * 300 + garbled)[0].endswith(TEXT)


def test_cyrillic_and_double():
    russian = "Выручка составила больше, чем в прошлом году. Аудитор запросил ещё документы."
    assert encoding.restore(russian.encode("cp1251").decode("cp1252"))[0] == russian
    twice = "".join(map(chr, "é à ü größer".encode())).encode("cp1252", "replace").decode("cp1252")
    assert encoding.restore(twice)[1]


@pytest.mark.parametrize("text", ["SÃO CONDIÇÕES DE APROVAÇÃO", "The Ærøvik branch and the Ñandú depot", "±2 °C over 20 m², √81 as ¶ 129, § 22", "Lesenоdоrn Saltwоrks assіgned", "zero​width", "naïve façade – “quoted”", "Größe, Maß, żółć, Москва", "", None, "plain"])
def test_unharmed(text):
    assert encoding.restore(text) == (text, False, True, [])


def test_repair_frame(spark):
    df = spark.createDataFrame([(1, "F�r die Pr�fung"), (2, "fine"), (3, None), (4, "betrÃ¤gt"), (4, "betrÃ¤gt")], "key bigint, restored string")
    got = sorted((r.key, r.restored, r.whole) for r in encoding.repair(df, "key", "restored").collect())
    assert got == [(1, "F�r die Pr�fung", False), (4, "beträgt", True), (4, "beträgt", True)]


# ---- personal data -----------------------------------------------------------------------------------------------


def test_redaction(spark):
    rows = [("t", 1, "Please call Dmitri Eskholt on (020) 7946-0162 about the lender model."), ("t", 2, "Energy use fell by 2 percent."), ("t", 3, None), ("t", 4, ""), ("t", 5, "Revenue rose. " * 2000 + "Copies went to rene.cranwick@wufipomar.test and rudbeck31@wufipomar.test in August."), ("t", 1, "Please call Dmitri Eskholt on (020) 7946-0162 about the lender model."), ("t", 6, "The tax adviser retained Vangate and Fenwick LLP to challenge the signed minutes.")]
    out = pii.redact(spark.createDataFrame(rows, "tbl string, row_key bigint, text string")).collect()
    assert sorted(r.row_key for r in out) == [1, 1, 5]
    first = next(r for r in out if r.row_key == 1)
    assert first.kinds == ["person_name", "phone"] and first.redacted == "Please call [NAME] on [PHONE] about the lender model."
    assert next(r for r in out if r.row_key == 5).redacted.endswith("Copies went to [EMAIL] and [EMAIL] in August.")
    assert pii.redact(spark.createDataFrame([], "tbl string, row_key bigint, text string")).count() == 0


def test_held_out_accuracy():
    """Kinds found in rows that training did not see against the labels of known frames."""
    import duckdb

    from quaysift.llm.pii_labels import spans
    from quaysift.llm.pii_templates import KINDS

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/doc_chunks.parquet' WHERE text IS NOT NULL UNION ALL SELECT source_quote FROM '/root/testdata/sf0.001/financial_evidence.parquet' WHERE source_quote IS NOT NULL").fetchall()]
    hit = miss = extra = 0
    for text, found in zip(texts, pii.find(texts)):
        want, got = {KINDS[k] for *_, k in spans(text)}, {k for *_, k in found}
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    assert hit / max(1, hit + miss) >= 0.97 and hit / max(1, hit + extra) >= 0.95


def test_viterbi_against_brute_force():
    from itertools import product

    import numpy as np

    net = pii.Tagger.__new__(pii.Tagger)
    r = np.random.default_rng(0)
    net.trans = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    scores = [r.standard_normal((n, pii.TAGS)).astype(np.float32) for n in (3, 1, 4, 2)]
    for s, path in zip(scores, net.decode(scores)):
        value = lambda p, s=s: sum(s[t, k] for t, k in enumerate(p)) + sum(net.trans[a, b] for a, b in zip(p, p[1:]))
        best = max(map(value, product(range(pii.TAGS), repeat=len(s))))
        assert abs(value(path if path is not None else [0] * len(s)) - best) < 1e-4


def test_gradient():
    import numpy as np

    from quaysift.llm import pii_training as T

    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in T.initial(0, hidden=3, width=2).items()}
    x, y, sizes = r.integers(0, 20, (3, T.T)), r.integers(0, T.K, (3, T.T)), np.array([T.T, 7, 1])
    _, g = T.loss_and_gradient(w, x, y, sizes)
    for name in ("wo", "trans", "wh", "b", "wx", "emb"):
        for _ in range(4):
            at = tuple(r.integers(0, min(n, 20)) for n in w[name].shape)
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            slope = (T.loss_and_gradient(up, x, y, sizes)[0] - T.loss_and_gradient(down, x, y, sizes)[0]) / 2e-4
            assert abs(slope - g[name][at]) < 1e-4 * max(1.0, abs(slope))


def test_scores_are_those_of_training_and_need_no_neighbours():
    import numpy as np

    from quaysift.llm import pii_training as T

    r = np.random.default_rng(2)
    w = T.initial(1, hidden=4, width=3)
    net = pii.Tagger(w)
    sizes = np.array([40, 22, 22, 5])
    x = r.integers(1, pii.N_CLASSES, (4, 40))
    whole = net.scores(x, sizes)
    for k, n in enumerate(sizes):
        alone = net.scores(x[k : k + 1, :n], sizes[k : k + 1])
        assert np.abs(alone[0] - whole[k, :n]).max() < 1e-5


@pytest.mark.parametrize("garbled, want", [
    ("the caf&Atilde;&copy; by the river", "the café by the river"), ("the caf\\u00c3\\u00a9 by the river", "the café by the river"),
    ("the caf%C3%83%C2%A9 by the river", "the café by the river"), ("the caf&amp;Atilde;&amp;copy; by the river", "the café by the river"),
    ("Müller met in the caf&Atilde;&copy;", "Müller met in the café"),
])
def test_escaped_garbling(spark, garbled, want):
    assert encoding.restore(garbled)[:3] == (want, True, True)
    df = spark.createDataFrame([(1, garbled)], "key bigint, restored string")
    assert [(r.key, r.restored) for r in encoding.repair(df, "key", "restored").collect()] == [(1, want)]


@pytest.mark.parametrize("text", ["the caf&eacute; by the river", "see /caf%C3%A9?a=1&section=2&copy=3", "R&D; 100% of 20%25 and AT&amp;T", "a\\u00e9b &mdash; &nbsp;", "50%E9"])
def test_correct_escapes_stay(text):
    assert encoding.restore(text) == (text, False, True, [])
