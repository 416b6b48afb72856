"""Queries on targets cut off by their channel (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.truncation import channel_shares, truncated
from leafmill.session import read_table


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    blocks = read_table(spark, folder, "blocks", ["block_key", "book_id", "source", "text", "target", "loaded_at"])
    return truncated(blocks, "block_key", "book_id", "source", "text", "target", "loaded_at")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder)[0].select(F.col("key").alias("block_key"))


def p6_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Targets, cut targets and their share per channel."""
    return channel_shares(*_judged(spark, folder)).withColumnRenamed("channel", "source")


QUERIES = {"p6_found": p6_found, "p6_channels": p6_channels}
ORACLE: dict[str, str] = {}
