"""Evaluation metrics: claim rates, flag matching, cost and latency."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysift.config import DEFAULT


def claim_rates(claims: DataFrame, by: list[str]) -> DataFrame:
    """support_rate and unsupported_rate (unsupported or contradicted; not insufficient)."""
    return claims.groupBy(*by).agg(
        F.coalesce(F.avg((F.col("status") == "supported").cast("double")), F.lit(0.0)).alias("support_rate"),
        F.coalesce(F.avg(F.col("status").isin("unsupported", "contradicted").cast("double")), F.lit(0.0)).alias("unsupported_rate"),
    )


_FLAG = r"(?i)(.+?)\s+discrepancy\s+\(([^)]+)\)"


def flag_label(flag: Column) -> Column:
    """Metric named by a flag, else its whole text; lower case, blanks squeezed."""
    named = F.when(flag.rlike(_FLAG), F.regexp_extract(flag, _FLAG, 1)).otherwise(flag)
    return F.regexp_replace(F.lower(F.btrim(named, F.lit(" \t\r\n"))), r"\s+", " ")


def flag_period(flag: Column) -> Column:
    """Period named by a flag, lower case without blanks; empty where it names none."""
    return F.regexp_replace(F.lower(F.regexp_extract(flag, _FLAG, 2)), r"\s+", "")


def flag_scores(predicted: DataFrame, expected: DataFrame, by: str = "case_id") -> DataFrame:
    """(by, tp, fp, fn), counted signature by signature; a flag without metric and period has its text for a signature.

    ``greedy_matches`` also pairs flags of which one contains the other.
    """
    p = predicted.groupBy(by, flag_label(F.col("flag")).alias("label"), flag_period(F.col("flag")).alias("period")).agg(F.count("*").alias("np"))
    e = expected.groupBy(by, flag_label(F.col("flag")).alias("label"), flag_period(F.col("flag")).alias("period")).agg(F.count("*").alias("ne"))
    both = p.join(e, [by, "label", "period"], "full_outer")
    np_, ne = F.coalesce("np", F.lit(0)), F.coalesce("ne", F.lit(0))
    return both.groupBy(by).agg(F.sum(F.least(np_, ne)).alias("tp"), F.sum(np_ - F.least(np_, ne)).alias("fp"), F.sum(ne - F.least(np_, ne)).alias("fn"))


def precision_recall(scores: DataFrame) -> DataFrame:
    """Adds precision, recall and f1: 1 where nothing was predicted and nothing expected, else 0 on an empty side."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / F.greatest(tp + fp, F.lit(1))).when(fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / F.greatest(tp + fn, F.lit(1))).when(fp == 0, 1.0).otherwise(0.0)
    out = scores.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def _signature(flag: str) -> tuple[str, str] | None:
    m = re.search(r"(.+?)\s+discrepancy\s+\(([^)]+)\)", flag, re.I)
    return (re.sub(r"\s+", " ", m[1].lower()).strip(), re.sub(r"\s+", "", m[2].lower())) if m else None


def flags_match(a: str, b: str) -> bool:
    """Equal signatures, or equal or contained texts."""
    sa, sb = _signature(a), _signature(b)
    if sa and sb and sa == sb:
        return True
    na, nb = (re.sub(r"\s+", " ", x.lower()).strip() for x in (a, b))
    return na == nb or (bool(na) and bool(nb) and (na in nb or nb in na))


def greedy_matches(flags: DataFrame, by: str = "case_id") -> DataFrame:
    """(by, tp, fp, fn) by one-to-one matching in order, also of flags without a signature; flags: by, side (p or e), ord, flag.

    One case's flags are a memo's: a handful.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        predicted, expected = list(pdf.loc[pdf["side"] == "p", "flag"]), list(pdf.loc[pdf["side"] == "e", "flag"])
        left, tp = list(expected), 0
        for p in predicted:
            hit = next((k for k, e in enumerate(left) if flags_match(p, e)), None)
            if hit is not None:
                del left[hit]
                tp += 1
        return pd.DataFrame({by: [pdf[by].iloc[0]], "tp": [tp], "fp": [len(predicted) - tp], "fn": [len(left)]})

    return flags.groupBy(by).applyInPandas(match, f"{by} {dict(flags.dtypes)[by]}, tp bigint, fp bigint, fn bigint")


def cost_events(events: DataFrame, rate: float = DEFAULT.cost_per_1k_tokens) -> DataFrame:
    """Adds tokens and cost: a quarter of the characters where tokens are unknown. events: name, ord, latency_ms, chars, tokens_known."""
    tokens = F.coalesce("tokens_known", F.expr("greatest(coalesce(chars, 0), 0) div 4"))
    return events.withColumn("tokens", tokens.cast("bigint")).withColumn("cost", F.round(F.col("tokens") / 1000.0 * rate, 8))


def cost_summary(events: DataFrame) -> DataFrame:
    """Calls, latency, tokens and cost over all events."""
    return events.agg(F.count("*").alias("calls"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 8).alias("cost"))


def cost_by_name(events: DataFrame) -> DataFrame:
    """The last event of each name, and the number of its calls."""
    return events.groupBy("name").agg(F.max_by(F.struct("latency_ms", "tokens", "cost"), "ord").alias("e"), F.count("*").alias("calls")).select("name", "calls", "e.*")


def score_bundle(rates: DataFrame, matched: DataFrame, min_support: float = 0.5, max_unsupported: float = 0.25, min_f1: float = 1.0) -> DataFrame:
    """One row with the rates, the F1 and whether all thresholds hold."""
    ok = (F.col("support_rate") >= min_support) & (F.col("unsupported_rate") <= max_unsupported) & (F.col("f1") >= min_f1)
    return rates.join(F.broadcast(matched.select("precision", "recall", "f1"))).withColumn("passed", ok)
