"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslane.operators import packed
from corpuslane.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(table(spark, sf_dir, "flat_papers"))


QUERIES = {"p2_found": p2_found}
ORACLE: dict[str, str] = {}
