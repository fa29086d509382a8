"""Queries of this subpackage for the driver, and SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysift.llm import encoding, leakage, linkage, packing, pii, splitting, truncation
from quaysift.session import table


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that state the same fact, with confidence."""
    return linkage.link(table(spark, sf_dir, "financial_evidence"), table(spark, sf_dir, "financials"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that state the same fact."""
    return p1_links(spark, sf_dir).select("evidence_id", "fin_row_id").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal statements, with the rows they stand for."""
    return linkage.classes(table(spark, sf_dir, "financial_evidence"), table(spark, sf_dir, "financials"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their restored text."""
    out = encoding.repair(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "restored", "whole", F.array_join("conversions", ", ").alias("conversions"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents."""
    return encoding.repair(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p1_classes": p1_classes, "p8_found": p8_found, "p8_restored": p8_restored}
SQL: dict[str, str] = {}


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the shares found."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of held-out items and the documents that hold them."""
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


QUERIES |= {"p7_found": p7_found, "p7_leaks": p7_leaks}


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks in the order of their documents."""
    keep = ["run_id", "doc_name", "page", "chunk_id", "pos"]
    return splitting.pieces(table(spark, sf_dir, "doc_chunks"), "chunk_key", "text", keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    cut = splitting.pieces(table(spark, sf_dir, "doc_chunks"), "chunk_key", "text", with_text=False)
    return cut.filter("n_pieces > 1").select("chunk_key").distinct()


QUERIES |= {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL["p2_found"] = "SELECT DISTINCT chunk_key FROM doc_chunks WHERE length(text) > 800"


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.check(truncation.records(table(spark, sf_dir, "doc_chunks"), table(spark, sf_dir, "evidence_chunks")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were cut off."""
    return _p3(spark, sf_dir).filter("cut").select("tbl", "row_key").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows by source."""
    return truncation.shares(_p3(spark, sf_dir))


QUERIES |= {"p3_found": p3_found, "p3_shares": p3_shares}


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document for each capacity."""
    lengths = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(lengths, table(spark, sf_dir, "pack_targets"))


QUERIES |= {"p6_containers": p6_containers}


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with personal data, with the text made anonymous."""
    rows = pii.records(table(spark, sf_dir, "doc_chunks"), table(spark, sf_dir, "evidence_chunks"), table(spark, sf_dir, "financial_evidence"))
    return pii.redact(rows).select("tbl", "row_key", F.array_join("kinds", ",").alias("kinds"), "n_spans", "redacted")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal data in each row."""
    rows = pii.records(table(spark, sf_dir, "doc_chunks"), table(spark, sf_dir, "evidence_chunks"), table(spark, sf_dir, "financial_evidence"))
    return pii.redact(rows).select("tbl", "row_key", F.explode("kinds").alias("pii_kind")).distinct()


QUERIES |= {"p4_found": p4_found, "p4_redacted": p4_redacted}
