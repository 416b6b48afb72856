"""Queries on lines of worksheets that render each other (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.alignment import aligned_lines
from leafmill.session import read_table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_lines(read_table(spark, folder, "worksheets", ["worksheet_id", "text", "target"]))


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
