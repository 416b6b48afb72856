"""Queries on sentence units (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.sentences import sentence_ends
from leafmill.session import read_table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_ends(read_table(spark, folder, "documents", ["doc_id", "text"]))


def p10_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units and their mean length per document."""
    ends = p10_found(spark, folder)
    return ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.max("end_pos").alias("last_end"))


QUERIES = {"p10_found": p10_found, "p10_units": p10_units}
ORACLE: dict[str, str] = {}
