"""Queries on recognised pages, figures and first mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import recognition as op
from leafmill.plans.common import SQL, blocks
from leafmill.plans.glossary import entries
from leafmill.session import read_table


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of scans; a word's confidence is its page's, less its length."""
    pages = read_table(spark, folder, "ocr_pages").dropDuplicates(["page_key"])
    lines = pages.select("page_key", "confidence", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("page_key", "line_no", "confidence", F.posexplode(F.split("line", " ")).alias("word_no", "text")).where("text <> ''")
    return words.withColumn("conf", F.col("confidence") - 3 * F.length("text"))


def page_recognition(spark: SparkSession, folder: str) -> DataFrame:
    return op.page_state(_words(spark, folder)).select("page_key", "n_high", "n_medium", "n_low", "n_unknown", "least", F.col("n_more").cast("long"), F.array_join("notes", "/").alias("notes"))


def joined_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "ocr_pages").dropDuplicates(["page_key"]).where("text is not null")
    return pages.select("page_key", op.joined_lines(F.split("text", "\n")).alias("text"))


def line_groups(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder, "bbox").where("page > 0 and bbox is not null")
    lines = b.select(F.concat("book_id", F.lit("/"), "page").alias("page_key"), F.col("pos").alias("line_no"), (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))).alias("size"))
    return op.grouped_lines(lines)


def placed_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Captions taken out and put before the block three places on."""
    b = blocks(spark, folder)
    figures = b.where("type = 'caption'").select("book_id", (F.col("pos") + 3).alias("slot"), F.col("id").alias("key"))
    return op.placed_figures(b.where("type <> 'caption'"), figures).select("book_id", F.col("pos").cast("long").alias("pos"), "id")


def first_mention_findings(spark: SparkSession, folder: str) -> DataFrame:
    return op.first_mention_gate(blocks(spark, folder), entries(spark, folder))


QUERIES = {"page_recognition": page_recognition, "joined_lines": joined_lines, "line_groups": line_groups, "placed_figures": placed_figures, "first_mention_findings": first_mention_findings}

ORACLE = {
    "placed_figures": SQL + " SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY r, id) AS pos, id FROM (SELECT book_id, CAST(pos AS DOUBLE) AS r, id FROM B WHERE type <> 'caption' UNION ALL SELECT book_id, pos + 3 - 1 + row_number() OVER (PARTITION BY book_id, pos ORDER BY id) / (count(*) OVER (PARTITION BY book_id, pos) + 1), id FROM B WHERE type = 'caption')",
    "first_mention_findings": SQL.rstrip() + """, E AS (SELECT DISTINCT ON (book_id, id) * FROM glossary WHERE source IS NOT NULL), X AS (SELECT E.book_id, E.id AS entry, B.pos, (length(B.target) - length(replace(B.target, E.first_form, ''))) // length(E.first_form) AS t FROM E JOIN B ON E.book_id = B.book_id AND contains(B.target, E.target) WHERE E.first_form <> '' AND E.target <> '' AND B.target <> ''),
    G AS (SELECT book_id, entry, CAST(sum(t) AS INTEGER) AS n, min(pos) AS first_pos, min(pos) FILTER (WHERE t > 0) AS formed_pos FROM X GROUP BY 1, 2)
    SELECT * FROM (SELECT 'warning' AS severity, CASE WHEN n = 0 THEN 'first-mention-missing' WHEN n > 1 THEN 'first-mention-repeated' WHEN formed_pos > first_pos THEN 'first-mention-misplaced' END AS code, book_id, entry AS unit, CAST(n AS VARCHAR) AS detail FROM G) WHERE code IS NOT NULL""",
    "page_recognition": """WITH O AS (SELECT DISTINCT ON (page_key) * FROM ocr_pages), L AS (SELECT page_key, confidence, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM O), W0 AS (SELECT page_key, confidence, ln, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS wn FROM L),
    W AS (SELECT *, confidence - 3 * length(w) AS conf FROM W0 WHERE w <> ''), C AS (SELECT page_key, count(*) FILTER (WHERE conf >= 85) AS n_high, count(*) FILTER (WHERE conf >= 60 AND conf < 85) AS n_medium, count(*) FILTER (WHERE conf < 60) AS n_low, count(*) FILTER (WHERE conf IS NULL) AS n_unknown, min(conf) AS least FROM W GROUP BY 1),
    N AS (SELECT page_key, ln, array_to_string(list(w ORDER BY wn)[1:6], ' ') AS note, row_number() OVER (PARTITION BY page_key ORDER BY ln) AS place FROM W WHERE conf < 60 GROUP BY 1, 2), M AS (SELECT page_key, string_agg(note, '/' ORDER BY ln) FILTER (WHERE place <= 8) AS notes, count(*) FILTER (WHERE place > 8) AS n_more FROM N GROUP BY 1)
    SELECT C.*, coalesce(n_more, 0) AS n_more, coalesce(notes, '') AS notes FROM C LEFT JOIN M USING (page_key)""",
}
