"""Human review as a fold over an append-only table of actions, and the gate before export.

actions: run_id, seq, action (edit, reverify, approve, export), section, reason, ts. sections: run_id, section,
section_ord, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.config import DEFAULT


def state(sections: DataFrame, actions: DataFrame) -> DataFrame:
    """Review state of every section of the memo: edits reset it, an approval sets it; actions on other titles fall away."""
    touching = actions.filter(F.col("action").isin("edit", "reverify", "approve"))
    last = touching.groupBy("run_id", "section").agg(F.max_by(F.struct("action", "reason", "ts"), "seq").alias("a"))
    joined = sections.join(last, ["run_id", "section"], "left")
    approved = F.coalesce(F.col("a.action") == "approve", F.lit(False))
    reason = F.when(approved & (F.trim("a.reason") != ""), F.trim("a.reason"))
    return joined.select("run_id", "section", "section_ord", "confidence", approved.alias("approved"), reason.alias("override_reason"), F.when(approved, F.col("a.ts")).alias("approved_at"))


def pending(folded: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """Sections below the threshold that nobody cleared."""
    cleared = folded.filter(F.col("approved") | F.col("override_reason").isNotNull()).select("run_id", "section")
    return folded.filter(F.col("confidence") < threshold).join(cleared, ["run_id", "section"], "left_anti")


def gate(folded: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """(run_id, n_pending, export_allowed) of every run."""
    n = pending(folded, threshold).groupBy("run_id").agg(F.count("*").alias("n"))
    return folded.select("run_id").distinct().join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_pending"), (F.coalesce("n", F.lit(0)) == 0).alias("export_allowed"))


def unknown_titles(approvals: DataFrame, sections: DataFrame) -> DataFrame:
    """Approvals of titles that the memo lacks."""
    return approvals.join(sections, ["run_id", "section"], "left_anti")


def versions(sections: DataFrame, actions: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """Export actions with the version they made: those at which no section was pending.

    The state at an export is the last action on each low section before it; a running maximum finds it without
    replaying the log.
    """
    low = sections.filter(F.col("confidence") < threshold).groupBy("run_id").agg(F.count("*").alias("n_low"))
    on_low = actions.join(sections.filter(F.col("confidence") < threshold).select("run_id", "section"), ["run_id", "section"], "left_semi").filter(F.col("action").isin("edit", "reverify", "approve"))
    by_section = W.partitionBy("run_id", "section").orderBy("seq")
    now = (F.col("action") == "approve").cast("int")
    change = on_low.select("run_id", "seq", (now - F.coalesce(F.lag(now).over(by_section), F.lit(0))).alias("change"), F.lit(0).alias("is_export"))
    exports = actions.filter("action = 'export'").select("run_id", "seq", F.lit(0).alias("change"), F.lit(1).alias("is_export"))
    run = W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    log = change.unionByName(exports).withColumn("cleared", F.sum("change").over(run)).filter("is_export = 1").join(low, "run_id", "left")
    allowed = log.withColumn("allowed", F.col("cleared") >= F.coalesce("n_low", F.lit(0)))
    number = F.sum(F.col("allowed").cast("int")).over(run)
    return allowed.select("run_id", "seq", "allowed", F.when(F.col("allowed"), number).alias("version"))


def job_guard(status: Column, has_memo: Column) -> Column:
    """HTTP-like code of a job: 404 missing, 202 running, 500 failed or without memo, 200 ready."""
    return F.when(status.isNull(), 404).when(status.isin("pending", "running"), 202).when((status == "error") | ~has_memo, 500).otherwise(200)


def error_code(message: Column) -> Column:
    """Class of an error text, first rule first (fixed values)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    limited = m.rlike("429|resource_exhausted") | (m.contains("rate") & m.contains("limit"))
    return (
        F.when(m.rlike("gemini_api_key|api key"), "missing_api_key").when(limited, "rate_limited")
        .when(m.contains("embedding"), "embedding_error").when(m.contains("timeout"), "timeout").otherwise("pipeline_error")
    )


def retryable(message: Column, code: Column | None = None) -> Column:
    """Whether an error's text or its status code names a passing condition (fixed values)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    by_text = m.rlike("429|resource_exhausted|503|unavailable|timeout|500|internal|11001|getaddrinfo|connection|network") | (m.contains("rate") & m.contains("limit"))
    return by_text if code is None else by_text | F.coalesce(code.isin(408, 429, 500, 502, 503, 504), F.lit(False))


def find_section(sections: DataFrame, title: str) -> DataFrame:
    """The first section (section_ord) of each run whose title is the one asked for, as it stands or URL-decoded."""
    asked = F.lit(title)
    hit = sections.filter((F.col("section") == asked) | (F.col("section") == F.try_url_decode(asked)))
    return hit.groupBy("run_id").agg(F.min_by("section", "section_ord").alias("section"), F.min("section_ord").alias("section_ord"))
