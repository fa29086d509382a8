"""Dense retrieval, rank fusion, query expansion and the hybrid of both."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.config import DEFAULT, EngineConfig
from quaysift.functions import text as X
from quaysift.operators import lexical

#: Section title -> words added to its query.
EXPANSIONS = {
    "executive summary": "overview highlights key findings investment thesis company snapshot transaction summary",
    "key financial metrics": "revenue EBITDA margin ARR ARR growth gross margin operating income cash flow free cash flow FCF net income NRR churn LTV CAC burn runway valuation multiples",
    "financial metrics": "revenue EBITDA margin ARR gross margin operating income cash flow net income FCF",
    "market overview": "TAM SAM SOM market size growth rate industry competitive landscape market share addressable market",
    "company overview": "business description products services founding headquarters customers operations history",
    "business overview": "products services customers go-to-market operations model",
    "competitive landscape": "competitors differentiation moat market share positioning rivals",
    "management team": "CEO CFO founders executives leadership board background experience",
    "risks": "risk factors challenges headwinds customer concentration regulatory litigation dependency",
    "investment highlights": "strengths opportunities growth drivers competitive advantage thesis",
    "customer": "customers retention NRR churn logos cohort concentration expansion",
    "product": "product roadmap features technology platform architecture",
}
#: Words in any other query -> the title whose words are added too.
TRIGGERS = {
    "key financial metrics": ("financial", "metric", "kpi", "ebitda"), "market overview": ("market", "industry", "tam"),
    "management team": ("management", "team", "leadership"), "risks": ("risk",),
}


class Embedder(Protocol):
    """Turns texts into vectors; adapters to remote models implement it."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def expand_query(query: str) -> str:
    """The query followed by the words of its titles which it lacks, each once, in their order.

    A query that is a title has that one; any other has the first title that is part of it or of which it is part, and
    those whose trigger words it contains.
    """
    query = query.strip()
    key = query.lower()
    if key in EXPANSIONS:
        titles = [key]
    else:
        titles = [t for t in EXPANSIONS if key and (t in key or key in t)][:1]
        titles += [t for t, words in TRIGGERS.items() if any(w in key for w in words)]
    fresh: dict[str, str] = {}
    for word in (w for t in titles for w in EXPANSIONS[t].split()):
        fresh.setdefault(word.lower(), word)
    return " ".join([query, *(word for low, word in fresh.items() if low not in key.split())])


def hash_weights(docs: DataFrame, key: str, text: str, dim: int = DEFAULT.embed_dim, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, key, slot, w): hashed signed bag of words, of unit length, without the zeros.

    Without tokens the stripped text, or 'empty', is the token; where all weights cancel, slot 0 has weight 1.
    """
    stripped = F.trim(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(*scope, F.col(key).alias("key"), stripped.alias("stripped"), X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("found"))
    terms = F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.when(F.col("stripped") == "", "empty").otherwise(F.col("stripped"))))
    slots = named.select(*scope, "key", F.explode(terms).alias("term")).groupBy(*scope, "key", X.hash_slot(F.col("term"), dim).alias("slot")).agg(F.sum(X.hash_sign(F.col("term"))).alias("w"))
    packed = slots.groupBy(*scope, "key").agg(F.collect_list(F.when(F.col("w") != 0, F.struct("slot", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    whole = F.when(F.size("v") > 0, F.col("v")).otherwise(F.array(F.struct(F.lit(0).alias("slot"), F.lit(1.0).alias("w"))))
    return packed.select(*scope, "key", F.inline(whole), F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm")).select(*scope, "key", "slot", (F.col("w") / F.col("norm")).alias("w"))


def hash_embedding(docs: DataFrame, key: str, text: str, dim: int = DEFAULT.embed_dim) -> DataFrame:
    """(key, embedding): the hash weights as vectors."""
    packed = hash_weights(docs, key, text, dim).groupBy("key").agg(F.collect_list(F.struct("slot", "w")).alias("v")).select("key", F.col("v.slot").alias("slots"), F.col("v.w").alias("ws"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            dense = np.zeros((len(pdf), dim))
            for i, (slots, ws) in enumerate(zip(pdf["slots"], pdf["ws"])):
                dense[i, slots] = ws
            yield pd.DataFrame({"key": pdf["key"], "embedding": list(dense)})

    return packed.mapInPandas(spread, f"key {dict(packed.dtypes)['key']}, embedding array<double>")


def sparse_top_k(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, dim: int = DEFAULT.embed_dim, scope: tuple[str, ...] = ()) -> DataFrame:
    """(qid, key, score, rank) by cosine of the hash embeddings, without making the vectors.

    Only slots that a query has meet (an equi-join, then a sum). Documents which share no slot score 0; they are looked
    at only for queries with fewer than k positive scores.
    """
    asked = hash_weights(queries, "qid", "query", dim, scope).select(*scope, F.col("key").alias("qid"), "slot", F.col("w").alias("qw"))
    scored = hash_weights(docs, key, text, dim, scope).join(asked, [*scope, "slot"]).groupBy("qid", "key").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    full = scored.filter("score > 0").groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    needy = queries.select(*scope, "qid").join(full.select("qid"), "qid", "left_anti")
    every = docs.select(*scope, F.col(key).alias("key"))
    zeros = (every.join(needy, list(scope)) if scope else every.crossJoin(needy)).join(scored.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", "key", F.lit(0.0).alias("score"))
    return lexical.top_k(scored.unionByName(zeros), k)


def embed(docs: DataFrame, key: str, text: str, embedder: Embedder, config: EngineConfig = DEFAULT) -> DataFrame:
    """Vectors from a pluggable embedder in batches; a wrong number of vectors is an error in strict mode, else the hash embedding stands in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), config.embed_batch_size):
                part = pdf.iloc[at : at + config.embed_batch_size]
                vectors = None
                for _ in range(config.embed_max_retries):
                    try:
                        vectors = embedder(list(part["text"]))
                        break
                    except Exception:
                        if config.strict_embed:
                            raise
                if vectors is None or len(vectors) != len(part):
                    if config.strict_embed:
                        raise ValueError("the embedder gave another number of vectors")
                    vectors = [None] * len(part)
                yield pd.DataFrame({"key": part["key"], "remote": vectors})

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    remote = named.mapInPandas(run, f"key {dict(named.dtypes)['key']}, remote array<double>")
    local = hash_embedding(docs, key, text, config.embed_dim)
    return remote.join(local, "key").select("key", F.coalesce("remote", "embedding").alias("embedding"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(qid, key, score, rank) by cosine; vectors: key, embedding; queries: qid, q_embedding.

    The queries go out in blocks of a fixed size, each against all vectors. A task scores its batches by one matrix
    product and keeps the k best of each query, so that only those are shuffled. Empty vectors, other lengths and norms
    next to nothing score 0.
    """
    types = dict(vectors.dtypes) | dict(queries.dtypes)
    schema = f"qid {types['qid']}, key {types['key']}, score double"
    asked = queries.select("qid", "q_embedding").orderBy("qid")
    n, out = asked.count(), None
    for start in range(0, max(n, 1), block):
        rows = asked.offset(start).limit(block).collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r.qid for r in rows], [None if r.q_embedding is None else np.array(r.q_embedding, float) for r in rows]))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked_vectors = shared.value
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(asked_vectors):
                by_size.setdefault(0 if v is None else len(v), []).append(i)
            for pdf in frames:
                keys = pdf["key"].to_numpy()
                scores = np.zeros((len(ids), len(keys)))
                sizes = np.array([0 if v is None else len(v) for v in pdf["embedding"]])
                for size, at in by_size.items():
                    same = np.flatnonzero(sizes == size)
                    if not size or not len(same):
                        continue
                    d = np.stack([np.asarray(pdf["embedding"].iloc[i], float) for i in same])
                    q = np.stack([asked_vectors[i] for i in at])
                    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
                    tiny = (np.linalg.norm(q, axis=1) < 1e-12)[:, None] | (np.linalg.norm(d, axis=1) < 1e-12)[None, :]
                    scores[np.ix_(at, same)] = np.where(tiny, 0.0, (q @ d.T) / np.where(tiny, 1.0, norms))
                parts = []
                for i, own in enumerate(scores):
                    best = np.lexsort((keys, -np.round(own, 9)))[:k]
                    parts.append(pd.DataFrame({"qid": ids[i], "key": keys[best], "score": own[best]}))
                if parts:
                    yield pd.concat(parts)

        part = vectors.select("key", "embedding").mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return lexical.top_k(out, k)


def rrf(rankings: list[DataFrame], k: int = DEFAULT.rrf_k) -> DataFrame:
    """(qid, key, score): sum of 1 / (k + rank + 1) over rankings of (qid, key, rank); one shuffle."""
    union = None
    for n, ranking in enumerate(rankings):
        part = ranking.select("qid", "key", "rank", F.lit(n).alias("source"))
        union = part if union is None else union.unionByName(part)
    # ties go to the earlier ranking, then to the better rank in it
    return union.groupBy("qid", "key").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("source", "rank")).alias("first"))


def hybrid(docs: DataFrame, key: str, text: str, queries: DataFrame, top_k: int = 5, config: EngineConfig = DEFAULT, scope: tuple[str, ...] = ()) -> DataFrame:
    """(qid, key, score, rank): dense and lexical candidates fused; queries: qid, query (a bounded list for each scope)."""
    pool = max(top_k, config.rerank_candidates)
    dense = sparse_top_k(docs, key, text, queries, pool, config.embed_dim, scope)
    sparse = lexical.top_k(lexical.positive_or_all(lexical.bm25(docs, key, text, queries, config, scope)), pool)
    return fused(rrf([dense, sparse], config.rrf_k), top_k)


def fused(scored: DataFrame, top_k: int) -> DataFrame:
    """(qid, key, score, rank): the best of fused rankings."""
    by = W.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("first"), F.col("key"))
    return scored.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < top_k).select("qid", "key", "score", "rank")
