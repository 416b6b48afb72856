"""Queries on long spans shared between blocks (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.shared_spans import shared_shares, shared_spans
from leafmill.session import read_table


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "blocks", ["block_key", "text", "target"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = shared_spans(_blocks(spark, folder), "block_key", ["text", "target"])
    return spans.select(F.col("a").alias("block_key_a"), F.col("b").alias("block_key_b")).distinct()


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every block stands elsewhere."""
    return shared_shares(_blocks(spark, folder), "block_key", ["text", "target"]).withColumnRenamed("key", "block_key")


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares}
ORACLE: dict[str, str] = {}
