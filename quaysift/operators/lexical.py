"""Inverted index and BM25 over chunks.

``scope`` names columns that keep corpora apart (of documents and queries alike), each with statistics of its own; without
it all documents are one corpus. Keys are unique over all corpora.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaysift.config import DEFAULT, EngineConfig
from quaysift.functions.text import tokens


def within(left: DataFrame, right: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Each row with the one row of its scope; without a scope there is one in all."""
    return left.join(right, list(scope)) if scope else left.join(F.broadcast(right))


def postings(docs: DataFrame, key: str, text: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, key, term, tf, dl): one partial aggregation by document and term."""
    counted = docs.select(*scope, F.col(key).alias("key"), tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    return counted.select(*scope, "key", "dl", F.explode("terms").alias("term")).groupBy(*scope, "key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_stats(post: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, term, df, cf)."""
    return post.groupBy(*scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_size(docs: DataFrame, text: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row for each scope: n documents, avgdl."""
    return docs.groupBy(*scope).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("double")).alias("avgdl"))


def idf(stats: DataFrame, size: DataFrame, epsilon: float = DEFAULT.bm25_epsilon, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, term, df, idf): negative values are replaced by a share of the vocabulary's mean."""
    raw = within(stats, size, scope).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean"))
    return within(raw, mean, scope).select(*scope, "term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, config: EngineConfig = DEFAULT, scope: tuple[str, ...] = ()) -> DataFrame:
    """(qid, key, score) of all documents that share a term with a query; queries: qid, query (a bounded list).

    The queries' terms meet the documents' before the postings are aggregated, so that only their postings are
    shuffled (a handful of queries is broadcast by its known size); the vocabulary's statistics are aggregated apart.
    """
    size = corpus_size(docs, text, scope)
    weights = idf(term_stats(postings(docs, key, text, scope), scope), size, config.bm25_epsilon, scope)
    asked = queries.select(*scope, "qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy(*scope, "qid", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.join(weights, [*scope, "term"])
    counted = docs.select(*scope, F.col(key).alias("key"), tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    tf = counted.select(*scope, "key", "dl", F.explode("terms").alias("term")).join(asked.select(*scope, "term").distinct(), [*scope, "term"]).groupBy(*scope, "key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    k1, b = config.bm25_k1, config.bm25_b
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return within(tf.join(wanted, [*scope, "term"]), size.select(*scope, "avgdl"), scope).groupBy("qid", "key").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with rank from 0; scores equal to nine places tie and go by key.

    The limit stands on the row number itself, so that each task drops what is not among its own k best before the shuffle.
    """
    by = W.partitionBy("qid").orderBy(F.round(score, 9).desc(), F.col("key"))
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def positive_or_all(scored: DataFrame) -> DataFrame:
    """Positive scores, or all of a query's rows where none is positive.

    Whether a query has a positive score is a partial aggregate of one row a query; a query's rows are never gathered.
    """
    best = scored.groupBy("qid").agg(F.max("score").alias("best"))
    return scored.join(best, "qid").filter((F.col("score") > 0) | (F.col("best") <= 0)).drop("best")
