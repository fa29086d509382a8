"""Audit appendix and the text blocks of a memo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.functions.normalize import strip
from quaysift.functions.text import clip


def build(claims: DataFrame, evidence: DataFrame, figures: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of the appendix, each key once, first come first kept.

    claims: section, title (its section's where there is none), section_ord, claim_ord, claim_id, text, status, citation_ids; evidence: section, eid, doc, page,
    quote; figures: section, section_ord, fig_ord, metric_name, value, fiscal_year, source_quote, page, doc.
    Keys hold the section; with compat they leave it out, so that equal ids of later sections vanish.
    """
    if "title" not in claims.columns:
        claims = claims.withColumn("title", F.col("section"))
    cited = claims.select("section", "title", "section_ord", "claim_ord", "claim_id", "text", "status", F.posexplode_outer("citation_ids").alias("cite_ord", "eid"))
    joined = cited.join(evidence.select("section", "eid", "doc", "page", "quote"), ["section", "eid"], "left")
    no_citation = F.col("eid").isNull()
    title = F.concat(F.coalesce("title", F.lit("")), F.lit(" · "), "claim_id", F.lit(" ["), "status", F.lit("]"))
    by_claim = joined.filter(no_citation | F.col("doc").isNotNull()).select(
        F.lit("claim").alias("entry_type"), "section", "section_ord", F.col("claim_ord").alias("o1"), F.coalesce("cite_ord", F.lit(0)).alias("o2"),
        "claim_id", F.col("text").alias("claim_text"), "status", F.col("eid").alias("evidence_id"),
        F.when(no_citation, "(uncited)").otherwise(F.col("doc")).alias("doc"), F.when(no_citation, 1).otherwise(F.col("page")).alias("page"),
        F.when(no_citation, "").otherwise(clip(F.col("quote"), 200)).alias("quote"), title.alias("metric"), F.lit(None).cast("string").alias("value"),
    )
    by_figure = figures.select(
        F.lit("fin").alias("entry_type"), "section", "section_ord", F.col("fig_ord").alias("o1"), F.lit(0).alias("o2"), F.lit(None).cast("string").alias("claim_id"),
        F.lit(None).cast("string").alias("claim_text"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("evidence_id"),
        "doc", "page", clip(F.col("source_quote"), 200).alias("quote"), F.col("metric_name").alias("metric"), "value",
    )
    rows = by_claim.unionByName(by_figure)
    is_claim = F.col("entry_type") == "claim"
    key = F.struct(
        F.when(is_claim, F.col("claim_id")).alias("claim"), F.when(is_claim, F.col("evidence_id")).alias("cited"),
        F.when(~is_claim, F.col("doc")).alias("doc"), F.when(~is_claim, F.col("page")).alias("page"), F.when(~is_claim, F.col("metric")).alias("metric"),
    )
    scope = ["entry_type", "key"] if compat else ["section", "entry_type", "key"]
    first = W.partitionBy(*scope).orderBy("section_ord", "o1", "o2")
    return rows.withColumn("key", key).withColumn("k", F.row_number().over(first)).filter("k = 1").drop("key", "k")


def section_key(title: Column) -> Column:
    """Placeholder name of a section: capitals, runs of other signs as one underscore."""
    return F.btrim(F.regexp_replace(F.upper(strip(title)), r"[^A-Za-z0-9_]+", "_"), F.lit("_"))


#: Word in a title -> the memo slot it may fill.
SLOTS = {"market": "MARKET_OVERVIEW", "business": "BUSINESS_OVERVIEW", "financial": "KEY_FINANCIAL_METRICS", "management": "MANAGEMENT_TEAM", "risk": "RISKS"}


def section_slots(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, slot, title): which section fills each slot of a memo. sections: by, section_ord, title.

    A slot of a section's own name goes to the last section of that name; any other slot to the first section whose title
    holds the slot's word, so that one title may fill several.
    """
    low = F.lower("title")
    named = [F.struct(section_key(F.col("title")).alias("slot"), F.lit(1).alias("own"))]
    worded = [F.when(low.contains(word), F.struct(F.lit(slot).alias("slot"), F.lit(0).alias("own"))) for word, slot in SLOTS.items()]
    fills = sections.select(*by, "section_ord", "title", F.explode(F.array_compact(F.array(*named, *worded))).alias("f")).select(*by, "section_ord", "title", "f.slot", "f.own")
    rank = F.struct("own", F.when(F.col("own") == 1, F.col("section_ord")).otherwise(-F.col("section_ord")))
    return fills.groupBy(*by, "slot").agg(F.max_by("title", rank).alias("title"))


def table_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """Figures of each group as lines of metric | period | value."""
    line = F.concat_ws(" | ", "metric_name", "fiscal_year", "value")
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.struct("fig_ord", line.alias("line"))))["line"], "\n").alias("table_text"))
