"""Tables as the queries use them, each record once, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import read_table

BLOCK = ["block_key", "book_id", "pos", "id", "type", "level", "text", "target", "page"]


def blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "blocks", [*BLOCK, *columns]).dropDuplicates(["block_key"])


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "footnotes", ["book_id", "id", "anchor_block", "origin", "text", "target"]).dropDuplicates(["book_id", "id"])


def books(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "books").dropDuplicates(["book_id"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents", ["doc_id", "text", "lang", "source"]).where(F.col("text").isNotNull())


#: CTEs with the same content for the SQL oracles.
SQL = """
WITH B AS (SELECT DISTINCT block_key, book_id, pos, id, type, level, text, target, page FROM blocks),
N AS (SELECT DISTINCT book_id, id, anchor_block, origin, text, target FROM footnotes),
K AS (SELECT DISTINCT book_id, title, title_target, author, author_target FROM books),
T AS (SELECT * FROM B WHERE type IN ('heading','paragraph','blockquote','listitem','caption','verse')),
R AS (SELECT book_id, id AS block_id, pos, note_id, row_number() OVER (PARTITION BY book_id, id ORDER BY n) AS ref_no FROM (
        SELECT book_id, id, pos, unnest(refs) AS note_id, generate_subscripts(refs, 1) AS n FROM (
          SELECT *, regexp_extract_all(regexp_replace(text, '`[^`]*`', '', 'g'), '\\[\\[fn:([A-Za-z0-9_-]+)\\]\\]', 1) AS refs FROM B WHERE text IS NOT NULL))),
U AS (
  SELECT book_id, 0 AS part_no, 0 AS pos, 'title' AS id, 'metadata' AS part, 'title' AS kind, title AS source, title_target AS target FROM K
  UNION ALL SELECT book_id, 0, 1, 'author', 'metadata', 'author', author, author_target FROM K
  UNION ALL SELECT book_id, 1, pos, id, CASE WHEN type = 'caption' THEN 'caption' ELSE 'body' END,
    CASE type WHEN 'heading' THEN 'heading' || coalesce(level, 1) WHEN 'paragraph' THEN 'para' WHEN 'blockquote' THEN 'quote' WHEN 'listitem' THEN 'list' ELSE type END,
    text, target FROM T
  UNION ALL SELECT book_id, 2, 0, id, 'note', 'note', text, target FROM N
), P AS (SELECT * FROM U WHERE coalesce(trim(source), '') <> '' OR coalesce(trim(target), '') <> '')
"""
