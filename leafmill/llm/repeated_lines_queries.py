"""Queries on lines repeated within a source (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.repeated_lines import repeated_lines, without_repeated_lines
from leafmill.session import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents", ["doc_id", "source", "text"])
    return repeated_lines(documents).select("doc_id", "line_no")


def p2_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents", ["doc_id", "source", "text"])
    return without_repeated_lines(documents).select("doc_id", "text_clean", "lines_removed")


_LINES = r"""
WITH docs AS (SELECT DISTINCT doc_id, source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
parts AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs
), lines AS (
  SELECT doc_id, source, line, line_no, regexp_replace(trim(regexp_replace(lower(upper(line)), '[\s\p{Z}\x{0b}\x{85}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') AS content
  FROM parts
), sized AS (SELECT source, count(DISTINCT doc_id) AS docs FROM docs GROUP BY 1),
repeated AS (
  SELECT source, content FROM lines JOIN sized USING (source)
  WHERE regexp_matches(content, '\p{L}') GROUP BY source, content, docs
  HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 100 >= docs * 3
)
"""

QUERIES = {"p2_found": p2_found, "p2_cleaned": p2_cleaned}
ORACLE = {
    "p2_found": _LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN repeated USING (source, content)",
    "p2_cleaned": _LINES
    + """SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE r.source IS NULL), '') AS text_clean,
         count(r.source) AS lines_removed
         FROM lines l LEFT JOIN repeated r ON l.source = r.source AND l.content = r.content GROUP BY doc_id""",
}
