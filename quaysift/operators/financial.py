"""Offline extraction of figures from chunks, the interface for model-based extraction, and company names."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Extractor(Protocol):
    """Texts of documents -> JSON answers of the schema METRICS; adapters to models implement it."""

    def __call__(self, texts: list[str]) -> list[str]: ...


METRICS = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("metrics", T.ArrayType(T.StructType([
        T.StructField("metric_name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("fiscal_year", T.StringType()),
        T.StructField("source_quote", T.StringType()), T.StructField("page_number", T.IntegerType()),
    ]))),
])


def parse_answers(answers: DataFrame) -> DataFrame:
    """Figures in model answers (doc_name, answer): an answer with any page below 1 or unreadable gives none."""
    parsed = answers.withColumn("a", F.from_json("answer", METRICS, {"mode": "PERMISSIVE"}))
    sound = F.forall(F.coalesce("a.metrics", F.array().cast(METRICS["metrics"].dataType)), lambda m: F.coalesce(m["page_number"], F.lit(1)) >= 1)
    return parsed.filter(sound & F.col("a.metrics").isNotNull()).select("doc_name", F.inline("a.metrics")).withColumn("page_number", F.coalesce("page_number", F.lit(1)))


def first_company(answers: DataFrame) -> DataFrame:
    """The company named by the first document (doc_ord) that names one."""
    named = answers.withColumn("n", F.trim(F.from_json("answer", METRICS)["company_name"]))
    usable = named.filter((F.col("n") != "") & ~F.lower("n").isin("...", "unknown", "none"))
    return usable.agg(F.min_by("n", "doc_ord").alias("company_name"))


def labelled_figures(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Figures in lines 'Label PERIOD: amount' and in sentences 'Label for PERIOD came to amount' of chunks, with their columns ``keep``."""
    period = r"(?:FY ?\d{2,4}|Q[1-4] ?\d{4}|the trailing twelve months|TTM|LTM)"
    amount = r"[$€£]\d[\d,]*(?:\.\d+)?(?: million| billion|K|M|m|bn)?|\d+(?:\.\d+)?(?:%| percent)"
    line = rf"(?m)^\s*([A-Z][A-Za-z ]{{1,40}}?)(?: exiting)? ({period})(?: \(restated\))?: ({amount})\s*$"
    sentence = rf"([A-Z][A-Za-z ]{{1,40}}?) for ({period}) came to ({amount})"
    out = None
    for pattern in (line, sentence):
        found = chunks.select(*keep, "doc_name", "page", "pos", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("source_quote"))
        part = found.select(
            *keep, "doc_name", "page", "pos", "source_quote",
            *[F.trim(F.regexp_extract("source_quote", pattern, k)).alias(c) for k, c in ((1, "metric_name"), (2, "fiscal_year"), (3, "value"))],
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("source_quote", F.trim("source_quote"))


def first_chunks(chunks: DataFrame, by: list[str], order: list[str], n: int = 8) -> DataFrame:
    """The first chunks of each group in their order; a task keeps no more than its own first ones before the shuffle."""
    first = W.partitionBy(*by).orderBy(*order)
    return chunks.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= n).withColumn("rank", F.col("__rank") - 1).drop("__rank")


def company_texts(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """What is read for a company's name where no document gave one: the first 3,000 characters of a group's first two chunks above 300."""
    return first_chunks(chunks.filter(F.length("text") > 300), by, order, 2).withColumn("text", F.substring("text", 1, 3000))
