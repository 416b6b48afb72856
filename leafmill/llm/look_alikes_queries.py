"""Queries on targets that look the same (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.look_alikes import consistent_form, same_look_classes, same_look_pairs
from leafmill.session import read_table


def latest_targets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per block: its target as delivered last."""
    blocks = read_table(spark, folder, "blocks", ["block_key", "book_id", "target", "loaded_at"])
    latest = F.max(F.struct("loaded_at", "book_id", "target"))
    return blocks.groupBy("block_key").agg(latest.alias("r")).select("block_key", "r.book_id", "r.target")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = same_look_pairs(latest_targets(spark, folder), "block_key", "book_id", "target")
    return pairs.select(F.col("a").alias("block_key_a"), F.col("b").alias("block_key_b"))


def p1_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every block whose target changes, with its consistent form."""
    return consistent_form(latest_targets(spark, folder), "block_key", "target").withColumnRenamed("form", "target_form")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks whose target stands in their book in other characters too, one row each, with their class."""
    classes = same_look_classes(latest_targets(spark, folder), "block_key", "book_id", "target")
    return classes.withColumnRenamed("key", "block_key")


QUERIES = {"p1_found": p1_found, "p1_targets": p1_targets, "p1_classes": p1_classes}
ORACLE: dict[str, str] = {}
