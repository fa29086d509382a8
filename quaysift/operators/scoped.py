"""Hybrid retrieval in many corpora at once (one for each run), which reads each text once a round.

The index is dealt to blocks of consecutive keys, so that a corpus of usual size is in one block and a large one in many; no task ever
holds more than a block. A block's texts are tokenised once in an Arrow batch; terms and slots meet there, never as rows. A corpus of
one block has all its statistics there and gives its final hits; of corpora of several blocks the statistics are aggregated once, each
block gives its candidates, and those are ranked together. The results are those of ``retrieval.hybrid``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.config import DEFAULT, EngineConfig
from quaysift.functions import text as X
from quaysift.operators import lexical, retrieval
from quaysift.session import cut_lineage

BLOCK_BITS = 11
_TOKEN = re.compile(X.TOKEN)
_DENSE, _LEXICAL, _FUSED = 0, 1, 2
_SCHEMA = "run_id string, q int, key bigint, source int, score double, rank int, doc_name string, page int, quote string"


class _Terms:
    """Terms by number, with their hash slots and signs; begun anew when large."""

    def __init__(self, dim: int):
        self.dim, self.ids, self.slots, self.signs = dim, {}, [], []

    def __call__(self, found: list[str]) -> list[int]:
        ids = self.ids
        for t in found:
            if t not in ids:
                digest = hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()
                ids[t] = len(ids)
                self.slots.append(int.from_bytes(digest, "big") % self.dim)
                self.signs.append(1.0 if digest[13] & 1 else -1.0)
        return [ids[t] for t in found]


_terms: dict[int, _Terms] = {}


def _vectors(texts: list[str], found: list[list[str]], terms: _Terms) -> np.ndarray:
    """Hash embeddings of unit length (see retrieval.hash_weights), one row for each text."""
    units = [ts or [s.strip(" ") or "empty"] for ts, s in zip(found, texts)]
    ids = np.array(terms([t for ts in units for t in ts]), np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(ts) for ts in units])
    slots, signs = np.array(terms.slots)[ids], np.array(terms.signs)[ids]
    out = np.bincount(rows * terms.dim + slots, weights=signs, minlength=len(texts) * terms.dim).reshape(len(texts), terms.dim)
    norms = np.sqrt((out * out).sum(1))
    out[norms == 0, 0] = 1.0
    return out / np.where(norms > 0, norms, 1.0)[:, None]


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The k best by score to nine places, then key."""
    return np.lexsort((keys, -np.round(scores, 9)))[:k]


def _scored(group: pd.DataFrame, asked: pd.DataFrame, top_k: int, config: EngineConfig) -> pd.DataFrame:
    """A block's hits: final ones where it has the whole corpus, else candidates."""
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    if not len(group) or not len(asked):
        return pd.DataFrame([], columns=columns)
    terms = _terms.get(config.embed_dim)
    if terms is None or len(terms.ids) > 500_000:
        terms = _terms[config.embed_dim] = _Terms(config.embed_dim)
    texts, keys, n = list(group["text"]), group["key"].to_numpy(), len(group)
    found = [_TOKEN.findall(t.lower()) for t in texts]
    sizes = np.array([len(ts) for ts in found])
    queries = [q or "" for q in asked["query"]]
    q_found = [_TOKEN.findall(q.lower()) for q in queries]
    dense = _vectors(texts, found, terms) @ _vectors(queries, q_found, terms).T

    ids = np.array(terms([t for ts in found for t in ts]), np.int64)
    span = len(terms.ids)
    pairs, tf = np.unique(np.repeat(np.arange(n), sizes) * span + ids, return_counts=True)
    row, term = pairs // span, pairs % span
    whole = asked["n_docs"].isna().iloc[0]
    if whole:
        df = np.bincount(term, minlength=span)
        known = np.flatnonzero(df)
        raw = np.log(n - df[known] + 0.5) - np.log(df[known] + 0.5)
        idf = np.zeros(span)
        idf[known] = np.where(raw < 0, (raw.mean() if len(raw) else 0.0) * config.bm25_epsilon, raw)
        mean_size = sizes.mean()
    else:
        mean_size = asked["avgdl"].iloc[0]
    k1, b = config.bm25_k1, config.bm25_b
    pool = max(top_k, config.rerank_candidates)
    out = []
    for j, (q, words) in enumerate(zip(asked["q"], q_found)):
        weight, wanted = np.zeros(span), np.zeros(span, bool)
        if whole:
            for w in words:
                if (i := terms.ids.get(w, span)) < span:
                    weight[i] += idf[i]
                    wanted[i] = True
        else:
            given = {w["term"]: w["idf"] for w in asked["weights"].iloc[j]} if asked["weights"].iloc[j] is not None else {}
            for w in words:
                if w in given and (i := terms.ids.get(w, span)) < span:
                    weight[i] += given[w]
                    wanted[i] = True
        at = np.flatnonzero(wanted[term])
        f, r = tf[at], row[at]
        part = weight[term[at]] * f * (k1 + 1) / (f + k1 * (1 - b + b * sizes[r] / mean_size))
        lexical_scores, hit = np.bincount(r, weights=part, minlength=n), np.unique(r)
        if whole and (lexical_scores[hit] > 0).any():
            hit = hit[lexical_scores[hit] > 0]
        first = _best(dense[:, j], keys, pool)
        second = hit[_best(lexical_scores[hit], keys[hit], pool)]
        if whole:
            fused: dict[int, list] = {}
            for source, ranking in ((_DENSE, first), (_LEXICAL, second)):
                for rank, i in enumerate(ranking.tolist()):
                    fused.setdefault(i, [0.0, (source, rank)])[0] += 1.0 / (config.rrf_k + rank + 1)
            order = sorted(fused, key=lambda i: (-round(fused[i][0], 12), fused[i][1], keys[i]))[:top_k]
            out += [(q, i, _FUSED, fused[i][0], rank) for rank, i in enumerate(order)]
        else:
            out += [(q, i, _DENSE, dense[i, j], -1) for i in first.tolist()] + [(q, i, _LEXICAL, lexical_scores[i], -1) for i in second.tolist()]
    hits = pd.DataFrame(out, columns=["q", "i", "source", "score", "rank"])
    here = group.iloc[hits["i"].to_numpy(np.int64)].reset_index(drop=True)
    hits["run_id"], hits["key"], hits["doc_name"], hits["page"] = here["run_id"], here["key"], here["doc_name"], here["page"]
    hits["quote"] = [t[: config.evidence_chars] for t in here["text"]]
    return hits[columns]


class Corpora:
    """The index (key, run_id, doc_name, page, text) of many runs; keys ascend by run, texts hold more than blanks."""

    def __init__(self, index: DataFrame, config: EngineConfig = DEFAULT):
        self.config = config
        self.docs = index.select("run_id", F.shiftright("key", BLOCK_BITS).alias("block"), "key", "doc_name", "page", "text")
        self.blocks = cut_lineage(self.docs.groupBy("run_id", "block").agg(F.count("*").alias("n")))
        large = self.blocks.groupBy("run_id").agg(F.count("*").alias("k")).filter("k > 1").select("run_id")
        parted = self.docs.join(large, "run_id", "left_semi").select("run_id", X.tokens(F.col("text")).alias("terms"))
        self.size = cut_lineage(parted.groupBy("run_id").agg(F.count("*").alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl")))
        stats = parted.select("run_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("run_id", "term").agg(F.count("*").alias("df"))
        self.weights = cut_lineage(lexical.idf(stats, self.size, config.bm25_epsilon, ("run_id",)).select("run_id", "term", "idf"))

    def hybrid(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(qid, key, score, rank, doc_name, page, quote); queries: run_id, qid, query (few for each run)."""
        config = self.config
        pool = max(top_k, config.rerank_candidates)
        asked = queries.withColumn("q", F.row_number().over(W.partitionBy("run_id").orderBy("qid")))
        words = asked.select("run_id", "q", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term")).join(self.weights, ["run_id", "term"])
        weights = words.groupBy("run_id", "q").agg(F.collect_list(F.struct("term", "idf")).alias("weights"))
        dealt = asked.select("run_id", "q", "query").join(weights, ["run_id", "q"], "left").join(self.size.withColumnRenamed("n", "n_docs"), "run_id", "left").join(self.blocks.select("run_id", "block"), "run_id")
        by = ["run_id", "block"]
        docs = self.docs.join(dealt.select(*by).distinct(), by, "left_semi")

        def score(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return _scored(group, asked, top_k, config)

        own = dealt.select(F.col("run_id").alias("own_run"), F.col("block").alias("own_block"), "q", "query", "weights", "n_docs", "avgdl")  # no column of both sides
        found = cut_lineage(docs.groupBy(*by).cogroup(own.groupBy("own_run", "own_block")).applyInPandas(score, _SCHEMA))
        shown = ["doc_name", "page", "quote"]
        parted = found.filter(F.col("source") != _FUSED).withColumn("qid", F.struct("run_id", "q"))
        dense = lexical.top_k(parted.filter(F.col("source") == _DENSE).select("qid", "key", "score"), pool)
        sparse = lexical.top_k(lexical.positive_or_all(parted.filter(F.col("source") == _LEXICAL).select("qid", "key", "score")), pool)
        fused = retrieval.fused(retrieval.rrf([dense, sparse], config.rrf_k), top_k).join(parted.select("key", *shown).dropDuplicates(["key"]), "key")
        hits = found.filter(F.col("source") == _FUSED).select("run_id", "q", "key", "score", "rank", *shown).unionByName(fused.select("qid.run_id", "qid.q", "key", "score", "rank", *shown))
        return hits.join(asked.select("run_id", "q", "qid"), ["run_id", "q"]).select("qid", "key", "score", "rank", *shown)
