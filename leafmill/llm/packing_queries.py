"""Queries on containers filled with documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.packing import fill_report, packed
from leafmill.llm.tokens import token_counts
from leafmill.session import checkpoint, read_table


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece."""
    documents = read_table(spark, folder, "documents", ["doc_id", "lang", "text"])
    items = checkpoint(token_counts(documents, "doc_id", "text", ["lang"]))
    return packed(items, read_table(spark, folder, "pack_sizes"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used by each pack, the fewest possible, and the share of their space that is used."""
    return fill_report(p8_containers(spark, folder), read_table(spark, folder, "pack_sizes"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLE: dict[str, str] = {}
