"""Claims against cited evidence: extraction, verification, summaries, confidence, repair and bracketing.

Claims: section, claim_ord, claim_id, text, citation_ids, status. Evidence: section, eid, doc, page, quote.
``section`` may be any key of a section (a struct or a string).
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaysift.config import DEFAULT
from quaysift.functions import brackets
from quaysift.functions.normalize import strip

STATUSES = ("supported", "unsupported", "contradicted", "insufficient")


class Judge(Protocol):
    """Gives verdicts (section, claim_id, status, ord) on claims with their evidence; adapters to models implement it."""

    def __call__(self, claims: DataFrame, evidence: DataFrame) -> DataFrame: ...


def allowed_status(c: Column) -> Column:
    """The status if it is one, else 'insufficient'."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin(*STATUSES), s).otherwise("insufficient")


def word_set(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+")), "")


def extract_claims(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Given claims pass; a section without any gets one claim from its narrative with the first three evidence ids.

    sections: section, narrative, claims (array of structs claim_id, text, citation_ids, status, or null).
    """
    first = evidence.groupBy("section").agg(F.slice(F.sort_array(F.collect_set(F.struct("e_ord", "eid"))), 1, 3)["eid"].alias("eids"))
    given = F.filter(F.coalesce("claims", F.array().cast("array<struct<claim_id:string,text:string,citation_ids:array<string>,status:string>>")), lambda c: strip(c["text"]) != "")
    one = F.array(F.struct(F.lit("c1").alias("claim_id"), F.substring("narrative", 1, 500).alias("text"), F.coalesce("eids", F.array().cast("array<string>")).alias("citation_ids"), F.lit("insufficient").alias("status")))
    out = sections.join(first, "section", "left").select("section", F.posexplode(F.when(F.size(given) > 0, given).otherwise(one)).alias("claim_ord", "c"))
    return out.select(
        "section", "claim_ord", F.coalesce("c.claim_id", F.concat(F.lit("c"), F.col("claim_ord") + 1)).alias("claim_id"),
        F.col("c.text").alias("text"), F.coalesce("c.citation_ids", F.array().cast("array<string>")).alias("citation_ids"), allowed_status(F.col("c.status")).alias("status"),
    )


def claim_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with each cited piece of evidence that exists in their section."""
    cited = claims.select("section", "claim_ord", "claim_id", "text", F.posexplode("citation_ids").alias("cite_ord", "eid"))
    return cited.join(evidence, ["section", "eid"])


def local_verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(section, claim_id, claim_ord, overlap, local_status): word overlap with the best quote cited."""
    words = F.size(word_set(F.col("text")))
    hits = claim_evidence(claims, evidence).withColumn("hit", F.size(F.array_intersect(word_set(F.col("text")), word_set(F.col("quote")))))
    best = hits.groupBy("section", "claim_ord").agg(F.max("hit").alias("overlap"))
    judged = claims.join(best, ["section", "claim_ord"], "left")
    status = F.when(F.col("overlap").isNull(), "insufficient").when(F.col("overlap") >= F.greatest(F.lit(3), F.floor(words / 4)), "supported").otherwise("unsupported")
    return judged.select("section", "claim_id", "claim_ord", "overlap", status.alias("local_status"))


def verify(claims: DataFrame, evidence: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Claims with the status of their last verdict, or the local one where there is none."""
    local = local_verdicts(claims, evidence)
    base = claims.drop("status").join(local.select("section", "claim_ord", "local_status"), ["section", "claim_ord"])
    if verdicts is None:
        return base.withColumnRenamed("local_status", "status")
    last = verdicts.groupBy("section", "claim_id").agg(F.max_by("status", "ord").alias("verdict"))
    out = base.join(last, ["section", "claim_id"], "left")
    return out.withColumn("status", F.when(F.col("verdict").isNull(), F.col("local_status")).otherwise(allowed_status(F.col("verdict")))).drop("verdict", "local_status")


def summary(claims: DataFrame, threshold: float = DEFAULT.confidence_threshold, sections: DataFrame | None = None) -> DataFrame:
    """Counts by status, rate and confidence of each section; needs_repair tells whether another round is due.

    With ``sections`` (section) those without claims are there too: nothing counted, confidence 0.3, in need of repair.
    """
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    g = claims.groupBy("section").agg(
        F.count("*").alias("total"), *counts,
        F.bool_or((F.col("status") != "supported") | (F.size("citation_ids") == 0)).alias("needs_repair"),
    )
    if sections is not None:
        g = sections.select("section").distinct().join(g, "section", "left").fillna(0, ["total", *(f"n_{s}" for s in STATUSES)]).fillna(True, ["needs_repair"])
    rate = F.col("n_supported") / F.greatest(F.col("total"), F.lit(1))
    return g.withColumn("rate", rate).withColumn("confidence", confidence(F.col("total"), F.col("n_supported"), threshold))


def confidence(total: Column, supported: Column, threshold: float = DEFAULT.confidence_threshold) -> Column:
    """Supported share, held just below the threshold if any claim isn't supported; 0.3 without claims."""
    rate = supported / F.greatest(total, F.lit(1))
    return F.when(total == 0, F.lit(0.3)).when(supported < total, F.least(rate, F.lit(round(threshold - 0.01, 10)))).otherwise(rate)


def gap_queries(claims: DataFrame, most: int = 5, size: int = 500) -> DataFrame:
    """(section, gap_query): the texts of the first claims that need repair."""
    open_claims = claims.filter((F.col("status") != "supported") | (F.size("citation_ids") == 0))
    g = open_claims.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("claim_ord", "text"))).alias("c"))
    return g.select("section", F.substring(F.array_join(F.slice("c", 1, most)["text"], " "), 1, size).alias("gap_query"))


def bracketed(narrative: Column, texts: Column) -> Column:
    """The narrative with the first occurrence of each text in brackets; behind it, the first five texts that the result doesn't hold in brackets.

    Texts that are null count for nothing; without a narrative or texts there is no result. The fold over a row's texts runs in Arrow
    batches (see functions.brackets), once for each row: as a column expression it costs the narrative's length for each text.
    """
    done = _bracketed(narrative, texts)
    notes = F.array_join(F.transform(done["missing"], lambda t: F.substring(t, 1, 120)), "; ")
    return F.when(F.size(done["missing"]) > 0, F.concat(F.regexp_replace(done["content"], r"(?U)\s+$", ""), F.lit("\n\n[Unverified claims: "), notes, F.lit("]"))).otherwise(done["content"])


@F.pandas_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType()))]))
def _bracketed(narratives: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if n is None or ts is None else brackets.bracket(n, [t for t in ts if t is not None]) for n, ts in zip(narratives, texts)]
    return pd.DataFrame(rows, columns=["content", "missing"])


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (section, doc, page) of the evidence used; all evidence of a section that used none."""
    used = claims.select("section", F.explode("citation_ids").alias("eid")).distinct()
    hit = evidence.join(used, ["section", "eid"], "left_semi").select("section", "doc", "page").distinct()
    unused = evidence.join(hit.select("section").distinct(), "section", "left_anti").select("section", "doc", "page").distinct()
    return hit.unionByName(unused)


def dedupe_evidence(evidence: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence by (section, doc, page, first 100 characters), numbered e1.. in order of first sight."""
    from pyspark.sql import Window as W

    head = F.substring(F.coalesce("quote", F.lit("")), 1, 100)
    firsts = evidence.withColumn("head", head).withColumn("k", F.row_number().over(W.partitionBy("section", "doc", "page", "head").orderBy(*order))).filter("k = 1")
    numbered = firsts.withColumn("e_ord", F.row_number().over(W.partitionBy("section").orderBy(*order)))
    return numbered.withColumn("eid", F.concat(F.lit("e"), F.col("e_ord"))).drop("k", "head")
