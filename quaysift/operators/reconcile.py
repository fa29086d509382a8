"""Reconciliation: figures of one metric and period that differ beyond a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.functions import normalize as N


def normalised(evidence: DataFrame) -> DataFrame:
    """evidence_id, run_id, metric, period, num, raw, doc_name of extracted figures."""
    d = evidence.select("evidence_id", "run_id", "metric_name", "fiscal_year", "value", "value_kind", "doc_name")
    d = N.with_numeric(N.with_period(N.with_metric(d, "metric_name"), "fiscal_year"), "value", "value_kind")
    return d.select("evidence_id", "run_id", "metric", "period", "num", N.strip(F.coalesce("value", F.lit(""))).alias("raw"), "doc_name")


def disagreeing_groups(rows: DataFrame, tolerance: float = 0.01, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Groups in which some pair disagrees, found without any pairs.

    If all values parse, the group agrees iff its least and greatest value agree; else two different raw texts
    disagree as soon as one of the two is unparseable.
    """
    key = [*by, "metric", "period"]
    g = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count("num").alias("n_num"), F.min("num").alias("lo"), F.max("num").alias("hi"),
        F.min(F.when(F.col("num").isNull(), F.col("raw"))).alias("u_lo"), F.max(F.when(F.col("num").isNull(), F.col("raw"))).alias("u_hi"),
    )
    numbers = (F.col("n_num") >= 2) & ~N.values_agree(F.col("lo"), F.col("hi"), tolerance)
    texts = (F.col("n") > F.col("n_num")) & ((F.col("n_num") > 0) | (F.col("u_lo") != F.col("u_hi")))
    return g.filter((F.col("n") >= 2) & (numbers | texts)).select(*key, "n", F.coalesce(numbers, F.lit(False)).alias("numeric"))


def worst_pairs(rows: DataFrame, tolerance: float = 0.01, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The worst pair of each disagreeing group: the greatest delta, an unknown delta counting as 1; ties go to the least ids.

    No pairs are formed. Only distinct values matter, each at its first row, and the worst pair is one of three:
    values of one sign differ most at the group's extremes; values of opposite signs differ most between neighbours
    by magnitude; and where a delta is 1 or unknown (a zero or an unparseable value takes part), the group's first row
    is in the first such pair.
    """
    key = [*by, "metric", "period"]
    bad = disagreeing_groups(rows, tolerance, by).select(*key)
    row = F.struct(F.col("f.evidence_id").alias("id"), F.col("f.doc_name").alias("doc"), "raw", "num")
    firsts = rows.join(bad, key, "left_semi").groupBy(*key, "num", F.when(F.col("num").isNull(), F.col("raw")).alias("text")).agg(
        F.min(F.struct("evidence_id", "doc_name", "raw")).alias("f")
    )
    firsts = firsts.withColumn("raw", F.col("f.raw")).select(*key, row.alias("r"))
    group, by_size = W.partitionBy(*key), W.partitionBy(*key).orderBy(F.abs(F.col("r.num")), F.col("r.num"))
    seen = firsts.withColumn("r1", F.min("r").over(group)).withColumn("before", F.lag("r").over(by_size))
    mine, one, prev = F.col("r.num"), F.col("r1.num"), F.col("before.num")
    partner = (F.col("r.id") != F.col("r1.id")) & (mine.isNull() | one.isNull() | (mine == 0) | (one == 0))
    opposite = (mine * prev) < 0

    def pair(x, y, delta):
        swap = x["id"] > y["id"]
        return F.struct(delta.alias("delta"), F.when(swap, y).otherwise(x).alias("a"), F.when(swap, x).otherwise(y).alias("b"))

    across = pair(F.col("before"), F.col("r"), N.relative_delta(mine, prev))
    found = seen.groupBy(*key).agg(
        F.first("r1").alias("r1"), F.min(F.when(partner, F.col("r"))).alias("p1"),
        F.min_by("r", mine).alias("lo"), F.max_by("r", mine).alias("hi"),
        F.max_by(across, F.when(opposite, F.struct(N.relative_delta(mine, prev), -F.least("r.id", "before.id"), -F.greatest("r.id", "before.id")))).alias("x"),
    )
    known = F.col("r1.num").isNotNull() & F.col("p1.num").isNotNull()
    one_pair = pair(F.col("r1"), F.col("p1"), F.when(known, N.relative_delta(F.col("r1.num"), F.col("p1.num"))))
    extremes = pair(F.col("lo"), F.col("hi"), N.relative_delta(F.col("lo.num"), F.col("hi.num")))
    candidates = F.array(
        F.when(F.col("p1").isNotNull(), one_pair),
        F.when((F.col("lo.num") < F.col("hi.num")) & (F.col("lo.num") * F.col("hi.num") >= 0), extremes),
        F.when(F.col("x").isNotNull(), F.col("x")),
    )
    rank = lambda c: F.struct(F.coalesce(c["delta"], F.lit(1.0)).alias("d"), (-c["a"]["id"]).alias("i"), (-c["b"]["id"]).alias("j"), c.alias("c"))
    best = F.array_max(F.transform(F.filter(candidates, lambda c: c.isNotNull()), rank))["c"]
    w = found.select(*key, best.alias("w")).filter(F.col("w.delta").isNull() | (F.col("w.delta") > tolerance))
    return w.select(*key, *[F.col(f"w.{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("id", "doc", "raw", "num")], F.col("w.delta").alias("delta"))


def flags(worst: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The text of each flag."""
    d = N.with_shown(N.with_shown(worst, "a_num", "a_shown"), "b_num", "b_shown")

    def side(s: str):
        number = F.when(F.col(f"{s}_num").isNull(), "(unparseable)").otherwise(F.concat(F.lit("(norm="), F.col(f"{s}_shown"), F.lit(")")))
        return F.concat(F.coalesce(F.col(f"{s}_doc"), F.lit("unknown")), F.lit("="), F.col(f"{s}_raw"), F.lit(" "), number)

    text = F.concat(N.label(F.col("metric")), F.lit(" discrepancy ("), F.col("period"), F.lit("): "), side("a"), F.lit(" vs "), side("b"))
    delta = F.when(F.col("delta").isNull(), "").otherwise(F.format_string(", delta=%.2f%%", F.col("delta") * 100))
    return d.select(*by, "metric", "period", F.concat(text, delta).alias("flag"))
