"""Normalisation of metrics, periods and amounts as native column expressions.

These keep the established semantics of the engine (percentages stay in points, words are no numbers); the richer
resolution for record linkage and unit conversion is in ``ontology`` and ``quantities``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cleaned spelling -> canonical metric.
METRIC_ALIASES = {
    "rev": "revenue", "revenue": "revenue", "revenues": "revenue", "sales": "revenue", "net sales": "revenue", "netsales": "revenue",
    "total revenue": "revenue", "total revenues": "revenue", "ebitda": "ebitda", "adj ebitda": "ebitda", "adjusted ebitda": "ebitda",
    "net income": "net_income", "netincome": "net_income", "net profit": "net_income", "profit": "net_income", "earnings": "net_income",
    "gross profit": "gross_profit", "gross margin": "gross_margin", "operating income": "operating_income", "operating profit": "operating_income",
    "arr": "arr", "mrr": "mrr",
}
# Suffix -> factor.
MULTIPLIERS = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9, "bn": 1e9, "t": 1e12}

_TRIM = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _TRIM, "")


def clean_metric_key(c: Column) -> Column:
    """Lower case, separators as blanks, other signs dropped, blanks squeezed."""
    c = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"[_\-/]+", " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def with_metric(df: DataFrame, source: str, name: str = "metric") -> DataFrame:
    """Adds the canonical metric key; unknown spellings become snake case, blank ones 'unknown'.

    The steps are columns of their own, so that no expression is evaluated twice and generated code stays small.
    """
    known = F.create_map(*[F.lit(x) for x in chain(*METRIC_ALIASES.items())])
    key = F.col("__key")
    short = F.when(key.startswith("total "), F.regexp_replace(key, "^total ", ""))
    out = F.when(key == "", "unknown").otherwise(F.coalesce(F.try_element_at(known, key), F.try_element_at(known, short), F.regexp_replace(key, " ", "_")))
    return df.withColumn("__key", clean_metric_key(F.col(source))).withColumn(name, out).drop("__key")


def _year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < 80, "20").otherwise("19"), y)).otherwise(y)


def with_period(df: DataFrame, source: str, name: str = "period") -> DataFrame:
    """Adds TTM, FYyyyy or QnFYyyyy where the text is such a period, else the text in capitals without blanks.

    A quarter may be parted from its year by blanks, hyphens, underscores and slashes.
    """
    s, c = F.col("__spaced"), F.col("__compact")
    out = F.when(s == "", "unknown").when(s.rlike(r"^(?:TTM|LTM|TRAILING TWELVE MONTHS)$"), "TTM")
    out = out.when(s.rlike(r"^(?:FY ?'?)?\d{4}$"), F.concat(F.lit("FY"), F.right(s, F.lit(4))))
    out = out.when(s.rlike(r"^FY ?'?\d{2}$"), F.concat(F.lit("FY"), _year(F.right(s, F.lit(2)))))
    quarter = r"^Q([1-4])(?:FY)?'?(\d{4}|\d{2})$"
    turned = r"^([1-4])Q(?:FY)?'?(\d{4}|\d{2})$"
    last = r"^(?:FY)?'?(\d{4}|\d{2})Q([1-4])$"
    for pattern, q, y in ((quarter, 1, 2), (turned, 1, 2), (last, 2, 1)):
        out = out.when(c.rlike(pattern), F.concat(F.lit("Q"), F.regexp_extract(c, pattern, q), F.lit("FY"), _year(F.regexp_extract(c, pattern, y))))
    spaced = F.upper(F.regexp_replace(strip(F.coalesce(F.col(source), F.lit(""))), r"(?U)\s+", " "))
    d = df.withColumn("__spaced", spaced).withColumn("__compact", F.regexp_replace("__spaced", r"[ _/\-]+", ""))
    return d.withColumn(name, out.otherwise(F.replace(s, F.lit(" "), F.lit("")))).drop("__spaced", "__compact")


def with_numeric(df: DataFrame, source: str, kind: str | None = None, name: str = "num") -> DataFrame:
    """Adds the amount as a double, null where the text is none; values of kind bool are none."""
    # Currency words and signs.
    money = r"(?i)\b(?:usd|eur|gbp|cad|aud)\b|[$€£¥]"
    pattern = r"^([+-]?)(\d+(?:\.\d+)?|\.\d+)\s*([A-Za-z]*)$"
    s, body = F.col("__s"), F.col("__body")
    d = df.withColumn("__s", strip(F.regexp_replace(strip(F.col(source)), money, "")))
    d = d.withColumn("__wrapped", s.rlike(r"^\(.*\)$"))
    inner = strip(F.regexp_replace(F.regexp_replace(s, r"^\(|\)$", ""), money, ""))
    d = d.withColumn("__s", F.when(F.col("__wrapped"), inner).otherwise(s))
    d = d.withColumn("__s", F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(s, ",", ""), r"%$", "")), r"^\+", ""))
    d = d.withColumn("__minus", s.startswith("-")).withColumn("__body", strip(F.regexp_replace(s, r"^-", "")))
    d = d.withColumn("__sign", F.regexp_extract(body, pattern, 1)).withColumn("__digits", F.regexp_extract(body, pattern, 2)).withColumn("__unit", F.lower(F.regexp_extract(body, pattern, 3)))
    factor = F.when(F.col("__unit") == "", 1.0)
    for u, f in MULTIPLIERS.items():
        factor = factor.when(F.col("__unit") == u, f)
    number = F.col("__digits").try_cast("double") * factor * F.when(F.col("__sign") == "-", -1.0).otherwise(1.0)
    plain = F.when(body.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), body.try_cast("double"))
    sign = F.when(F.col("__wrapped"), -1.0).otherwise(1.0) * F.when(F.col("__minus"), -1.0).otherwise(1.0)
    out = F.when(body.rlike(pattern), number).otherwise(plain) * sign
    if kind is not None:
        out = F.when(F.coalesce(F.col(kind), F.lit("")) != "bool", out)
    return d.withColumn(name, out).drop("__s", "__wrapped", "__minus", "__body", "__sign", "__digits", "__unit")


def relative_delta(a: Column, b: Column) -> Column:
    """|a - b| over the greater magnitude; 0 where both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


def values_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return relative_delta(a, b) <= tolerance


def with_shown(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds a short text of an amount: four significant digits with B, M or K, up to six below a thousand.

    Rounding follows the exact binary value: the product's rounding error decides what looks like a tie.
    """
    n, x, t = F.col(source), F.col("__x"), lambda c: F.col(f"__{c}")
    size = F.abs(n)
    mark = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")
    d = df.withColumn("__mark", mark).withColumn("__x", n / F.when(t("mark") == "B", 1e9).when(t("mark") == "M", 1e6).when(t("mark") == "K", 1e3).otherwise(1.0))
    d = d.withColumn("__power", F.when((t("mark") == "B") & (F.abs(x) >= 10000), F.floor(F.log10(F.abs(x))).cast("int")).otherwise(0))
    d = d.withColumn("__x", F.when(t("power") > 0, x / F.pow(F.lit(10.0), t("power").cast("double"))).otherwise(x))
    top = F.when(x == 0, 0).otherwise(F.greatest(F.floor(F.log10(F.abs(x))).cast("int"), F.lit(-12)))
    d = d.withColumn("__places", F.greatest(F.when(t("mark") == "", 5).otherwise(3) - top, F.lit(0)))
    d = d.withColumn("__scale", F.pow(F.lit(10.0), t("places").cast("double"))).withColumn("__v", F.abs(x)).withColumn("__p", t("v") * t("scale"))
    d = d.withColumn("__hi", F.lit(134217729.0) * t("v") - (F.lit(134217729.0) * t("v") - t("v"))).withColumn("__whole", F.floor(t("p")))
    d = d.withColumn("__rest", (t("p") - t("whole")) + ((t("hi") * t("scale") - t("p")) + (t("v") - t("hi")) * t("scale")))
    up = (t("rest") > 0.5) | ((t("rest") == 0.5) & (t("whole") % 2 == 1))
    d = d.withColumn("__text", F.format_string("%.6f", F.signum(x) * (t("whole") + up.cast("int")) / t("scale")))
    d = d.withColumn("__text", F.regexp_replace(F.regexp_replace(t("text"), r"0+$", ""), r"\.$", ""))
    # from ten thousand billions on, the four digits come with a power of ten
    power = F.concat(F.lit("e+"), F.lpad(t("power").cast("string"), 2, "0"))
    text = F.when(t("power") > 0, F.concat("__text", power)).when(F.abs(t("text").try_cast("double")) >= 10000, F.lit("1e+04")).otherwise(t("text"))
    plain = F.when((t("mark") == "") & (n == F.floor(n)), n.cast("bigint").cast("string")).otherwise(F.concat(F.when(t("mark") == "", t("text")).otherwise(text), "__mark"))
    return d.withColumn(name, F.when(n.isNotNull(), plain)).drop(*[f"__{c}" for c in ("mark", "x", "power", "places", "scale", "v", "p", "hi", "whole", "rest", "text")])


def label(metric: Column) -> Column:
    """A metric key as a title."""
    return F.initcap(F.regexp_replace(metric, "_", " "))
