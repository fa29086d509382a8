import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaysift.functions import text as X
from quaysift.operators import chunking, lexical, retrieval


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n?;", max_size=400), st.integers(5, 60))
def test_pieces_cover_the_text(text, size):
    parts = chunking.recursive_split(text, size, 0)
    assert all(0 < len(p) <= size for p in parts)
    # repeated separators drop out, all else is there once and in order
    assert re.sub(r"[^ab]", "", "".join(parts)) == re.sub(r"[^ab]", "", text)


def test_nested_overlap():
    """Overlap is laid within the node that was too large, then among its neighbours."""
    text = "aaaa\n\n" + "bbbbbb. cccccc. dddddd\n\neeee"
    assert chunking.recursive_split(text, 10, 3) == ["aaaa", "aaabbbbbb.", "bb.cccccc.", "cc.dddddd", "dddeeee"]
    assert chunking.recursive_split("x. . . y", 4, 0) == ["x. y"]
    assert chunking.recursive_split("aaaa bbbb. ", 9, 0) == ["aaaa", "bbbb."]


def test_split_rules():
    assert chunking.recursive_split("  short ") == ["short"] and chunking.recursive_split("") == [] and chunking.recursive_split(None) == []
    assert [len(p) for p in chunking.recursive_split("x" * 2000, 800, 120)] == [800, 800, 640]
    first, second = chunking.recursive_split("a" * 30 + ". " + "b" * 30, 40, 5)
    assert first == "a" * 30 + "." and second == first[-5:] + "b" * 30


def test_tables():
    text = "h1 | h2\n" + "\n".join(f"row{i} | {i}" for i in range(40))
    packs = chunking.table_split(text, 100)
    assert all(p.startswith("h1 | h2\n") and len(p) <= 100 for p in packs)
    assert [line for p in packs for line in p.split("\n")[1:]] == text.split("\n")[1:]
    assert chunking.table_split("h\n" + "x" * 200, 100) == ["h\n" + "x" * 200] and chunking.table_split("h" * 200, 100) is None
    assert [c for c, _ in chunking.pack_rows("h", ["a" * 30] * 5, "t", 70)] == ["t_rows0", "t_rows1", "t_rows2"] and chunking.pack_rows("h", ["a"], "t")[0][0] == "t"


def test_expand_and_windows(spark):
    rows = [("r", "d", 1, "c0", 0, "  ", False), ("r", "d", 1, "c1", 1, "x. " * 400, None), ("r", "d", 1, "c2", 2, "a | b\n" * 300, True), ("r", "d", 1, "c3", 3, None, True), ("r", "d", 1, "c4", 4, "ok", False)]
    df = spark.createDataFrame(rows, "run_id string, doc_name string, page int, chunk_id string, pos bigint, text string, is_table boolean")
    ids = {r.chunk_id for r in chunking.expand(df).collect()}
    assert {"c1_part0", "c2_rows0", "c4"} <= ids and not any(i.startswith(("c0", "c3")) for i in ids)
    w = spark.createDataFrame([("a" * 200,)], "t string").select(X.char_windows(F.col("t"), 80, 12).alias("w")).first().w
    assert [len(x) for x in w] == [80, 80, 64] and chunking.windows("a" * 200, 80, 12) == w
    assert chunking.with_overlap(["aaaa. ", "bbbb. ", "cc"], 3) == ["aaaa. ", "a. bbbb. ", "b. cc"]


def test_hash_embedding_against_python(spark):
    import hashlib

    texts = ["Revenue revenue growth", "", "***", "it's 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.key: r.embedding for r in retrieval.hash_embedding(df, "k", "t").collect()}
    for k, t in enumerate(texts):
        v = [0.0] * 768
        for tok in re.findall(X.TOKEN, t.lower()) or [t.strip() or "empty"]:
            h = int(hashlib.md5(tok.encode()).hexdigest(), 16)
            v[h % 768] += 1.0 if (h >> 16) & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        assert all(math.isclose(a, b / n, abs_tol=1e-12) for a, b in zip(got[k], v)), t


def test_bm25_against_python(spark):
    docs = ["revenue grew", "revenue revenue fell in the market", "the market", "the the cat", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, t string")
    queries = spark.createDataFrame([(0, "the revenue revenue"), (1, "nothing")], "qid int, query string")
    toks = [re.findall(X.TOKEN, d) for d in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    df_of = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df_of.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    got = {(r.qid, r.key): r.score for r in lexical.bm25(df, "k", "t", queries).collect()}
    for k, t in enumerate(toks):
        want = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in ["the", "revenue", "revenue"] if w in t)
        if any(w in t for w in ("the", "revenue")):
            assert math.isclose(got[0, k], want, abs_tol=1e-9)
    assert not any(q == 1 for q, _ in got)


def test_fusion_and_expansion(spark):
    a = spark.createDataFrame([(0, 7, 0), (0, 8, 1)], "qid int, key int, rank int")
    b = spark.createDataFrame([(0, 8, 0), (0, 9, 1)], "qid int, key int, rank int")
    fused = {r.key: r.score for r in retrieval.rrf([a, b]).collect()}
    swapped = {r.key: r.score for r in retrieval.rrf([b, a]).collect()}
    assert fused == swapped and math.isclose(fused[8], 1 / 61 + 1 / 62) and math.isclose(fused[9], 1 / 62)
    assert retrieval.expand_query("") == "" and "EBITDA" in retrieval.expand_query("Key Financial Metrics") and retrieval.expand_query("Weather") == "Weather"
    assert "headwinds" in retrieval.expand_query("Key risk factors")
    assert retrieval.expand_query("Management Team") == "Management Team CEO CFO founders executives leadership board background experience"
    assert retrieval.expand_query("Market risks").split()[2:4] == ["risk", "factors"] and "TAM" in retrieval.expand_query("Market risks")


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0)], "a array<double>, b array<double>, want double")
    assert df.filter(F.abs(X.cosine(F.col("a"), F.col("b")) - F.col("want")) > 1e-12).count() == 0


def test_embedder_falls_back(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta")], "k int, t string")
    short = retrieval.embed(df, "k", "t", lambda texts: [])
    assert {len(r.embedding) for r in short.collect()} == {768}
    full = retrieval.embed(df, "k", "t", lambda texts: [[float(len(t))] for t in texts])
    assert {r.key: r.embedding for r in full.collect()} == {1: [5.0], 2: [4.0]}


@pytest.mark.parametrize("bits", [1, 11])
def test_scoped_hybrid(spark, monkeypatch, bits):
    """Retrieval by blocks of keys gives the hits of the hybrid by joins, for corpora of one block and of several."""
    from quaysift.operators import scoped

    monkeypatch.setattr(scoped, "BLOCK_BITS", bits)
    texts = ["Revenue grew by 5 percent", "revenue and margin", "The board met the CEO", "the the the", "— § —", "Market size, market share", "Don't panic", "EBITDA margin", "risk of churn"]
    rows = [(k, run, "d::s", k, t, k) for k, (run, t) in enumerate([("a", t) for t in texts] + [("b", t) for t in texts[:3]] + [("c", "— § —")])]
    index = spark.createDataFrame(rows, "key bigint, run_id string, doc_name string, page int, text string, n int")
    asked = spark.createDataFrame([(r, f"{r}{i}", q) for r in "abcd" for i, q in enumerate(["revenue margin revenue", "the", "zzz", "market risk don't"])], "run_id string, qid string, query string")
    want = {(r.qid, r.key, r["rank"], round(r.score, 9)) for r in retrieval.hybrid(index, "key", "text", asked, 5, scope=("run_id",)).collect()}
    got = scoped.Corpora(index).hybrid(asked, 5).collect()
    assert {(r.qid, r.key, r["rank"], round(r.score, 9)) for r in got} == want and len(got) == len(want)
    assert all(r.quote == rows[r.key][4] and r.page == r.key and r.doc_name == "d::s" for r in got)
