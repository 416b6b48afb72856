"""Queries on pages recognised from scans (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.scanned_pages import damaged_lines, repaired_pages, whole_paragraphs
from leafmill.session import checkpoint, read_table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page with its book's language."""
    pages = read_table(spark, folder, "ocr_pages", ["page_key", "book_id", "page", "text"])
    once = pages.groupBy("page_key").agg(F.max(F.struct("book_id", "page", "text")).alias("p")).select("page_key", "p.*")
    books = read_table(spark, folder, "books", ["book_id", "lang_source"]).groupBy("book_id").agg(F.max("lang_source").alias("lang"))
    return checkpoint(once.join(books, "book_id", "left"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_lines(_pages(spark, folder), read_table(spark, folder, "wordlist"))


def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired paragraphs of every book in reading order."""
    parts = checkpoint(repaired_pages(_pages(spark, folder), read_table(spark, folder, "wordlist")))
    return whole_paragraphs(parts)


QUERIES = {"p7_found": p7_found, "p7_paragraphs": p7_paragraphs}
ORACLE: dict[str, str] = {}
