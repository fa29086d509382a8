"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaysift.operators import units
from quaysift.session import table


def p5_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of both tables in common units."""
    records = units.financial_evidence_records(table(spark, sf_dir, "financial_evidence")).unionByName(
        units.financials_records(table(spark, sf_dir, "financials"))
    )
    return units.common_units(records)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures given in another unit or scale than the common one."""
    return units.converted(p5_decoded(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_decoded": p5_decoded}
