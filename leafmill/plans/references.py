"""Queries on references to missing records (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.references import orphan_counts, orphan_references
from leafmill.session import read_table


def _references(spark: SparkSession, folder: str) -> DataFrame:
    links = read_table(spark, folder, "links").select(
        F.lit("links").alias("ref_table"), F.col("link_key").alias("ref_key"), F.col("book_id").alias("owner"),
        F.col("target").alias("ref_id"), "seen_at",
    )
    reviews = read_table(spark, folder, "reviews").select(
        F.lit("reviews").alias("ref_table"), F.col("review_key").alias("ref_key"), F.col("book_id").alias("owner"),
        F.col("id").alias("ref_id"), "seen_at",
    )
    return links.unionByName(reviews)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    blocks = read_table(spark, folder, "blocks").select(F.col("book_id").alias("owner"), "id", "loaded_at", "deleted_at")
    notes = read_table(spark, folder, "footnotes").select(F.col("book_id").alias("owner"), "id", "loaded_at")
    return blocks.unionByName(notes.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(_references(spark, folder), _records(spark, folder)).select("ref_table", "ref_key")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = orphan_counts(_references(spark, folder), _records(spark, folder))
    return counts.select(
        "ref_table", F.date_format("period", "yyyy-MM").alias("period"),
        F.col("references").alias("n_references"), F.col("orphans").alias("n_orphans"),
    )


_ID = "trim(regexp_replace(lower({0}), '#.*$', ''))"
_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT 'links' AS ref_table, link_key AS ref_key, book_id, {_ID.format('target')} AS rid, seen_at
  FROM links WHERE target IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'reviews', review_key, book_id, {_ID.format('id')}, seen_at FROM reviews WHERE id IS NOT NULL
), records AS (
  SELECT book_id, {_ID.format('id')} AS rid, min(loaded_at) AS loaded_at, max(deleted_at) AS deleted_at
  FROM (SELECT book_id, id, loaded_at, deleted_at FROM blocks
        UNION ALL SELECT book_id, id, loaded_at, NULL FROM footnotes)
  GROUP BY 1, 2
), judged AS (
  SELECT r.*, (c.rid IS NULL OR coalesce(c.loaded_at > r.seen_at, false)
               OR coalesce(c.deleted_at <= r.seen_at, false)) AS orphan
  FROM refs r LEFT JOIN records c ON r.book_id = c.book_id AND r.rid = c.rid
)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
ORACLE = {
    "p5_found": _ORPHANS + "SELECT ref_table, ref_key FROM judged WHERE orphan",
    "p5_counts": _ORPHANS
    + """SELECT ref_table, strftime(seen_at, '%Y-%m') AS period, count(*) AS n_references,
         count(*) FILTER (WHERE orphan) AS n_orphans FROM judged GROUP BY 1, 2""",
}
