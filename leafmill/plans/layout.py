"""Queries on the layout of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import layout as op
from leafmill.plans.common import SQL, blocks
from leafmill.session import read_table


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    b = blocks(spark, folder, "bbox").where("page > 0 and bbox is not null")
    return b.select("book_id", "page", "pos", F.col("block_key").alias("key"), at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return boxes(spark, folder).groupBy("book_id", "page").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "ocr_pages").dropDuplicates(["page_key"])


def repeated_heads(spark: SparkSession, folder: str) -> DataFrame:
    return op.repeated_heads(_scans(spark, folder).select("book_id", "page", F.get(F.split("text", "\n"), F.lit(0)).alias("line")))


def weighted_mode(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents", ["doc_id", "source", "n_chars"]).withColumn("size", F.floor(F.col("n_chars") / 100).cast("int"))
    return op.weighted_mode(d, "source", "size", "n_chars", "doc_id")


def geometry_census(spark: SparkSession, folder: str) -> DataFrame:
    return op.geometry_census(_pages(spark, folder))


def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    return op.upper_median(read_table(spark, folder, "documents", ["source", "n_chars"]), "source", "n_chars")


def page_classes(spark: SparkSession, folder: str) -> DataFrame:
    """A book's scans by the share of pages with 1,000 characters and whether a poor page is among the others."""
    pages = _scans(spark, folder).withColumn("texty", F.length("text") >= 1000)
    per = pages.groupBy("book_id").agg(F.avg(F.col("texty").cast("int")).alias("share"), F.max(~F.col("texty") & F.coalesce(F.col("confidence") < 80, F.lit(False))).alias("covered"), F.max("texty").alias("some"))
    return per.select("book_id", op.text_class(F.col("share"), F.col("covered"), F.col("some")).alias("class"))


def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).join(blocks(spark, folder).select(F.col("block_key").alias("key"), "type", "text"), "key").where("text is not null")
    level = op.heading_level((F.col("y1") - F.col("y0")) / 12, F.col("type") == "heading", F.length("text"), F.upper("text") == F.col("text"), F.col("y0") > 100)
    return b.select("key", level.alias("level"))


def joined_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return op.joined_paragraphs(blocks(spark, folder).where("text is not null"))


def gaps_above(spark: SparkSession, folder: str) -> DataFrame:
    return op.gaps_above(boxes(spark, folder)).select("key", "gap", "starts_page", "left", "right")


def best_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes against the boxes of their page moved down by 20 points."""
    b = boxes(spark, folder)
    return op.best_overlaps(b, b.withColumns({"y0": F.col("y0") + 20, "y1": F.col("y1") + 20}))


def overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks grown by 10 points against the images and tables of their page."""
    kinds = blocks(spark, folder).select(F.col("block_key").alias("key"), "type")
    b = boxes(spark, folder).join(kinds, "key")
    pictures = b.where(F.col("type").isin("image", "table"))
    texts = b.where("type not in ('image', 'table')").withColumns({"y0": F.col("y0") - 10, "y1": F.col("y1") + 10})
    return op.overlapping(texts, pictures)


def nearest_geometry(spark: SparkSession, folder: str) -> DataFrame:
    declared = spark.createDataFrame([(0, 360.0, 500.0), (1, 350.0, 560.0), (2, 350.0, 300.0)], "size_no int, width double, height double")
    return op.nearest_geometry(_pages(spark, folder), declared)


def blank_bands(spark: SparkSession, folder: str) -> DataFrame:
    return op.blank_bands(boxes(spark, folder), 60.0, 560.0)


def margin_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    return b.select("key", op.furniture(F.col("y0"), F.col("y1"), F.lit(80.0), F.lit(500.0)).alias("furniture"), op.illustration(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("illustration"))


def page_grades(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).select("page_key", op.grade(F.col("confidence")).alias("grade"))


def line_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The words of a scan's lines; short ones count as unknown."""
    lines = _scans(spark, folder).select("page_key", "confidence", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("page_key", "line_no", "confidence", F.explode(F.split("line", " ")).alias("text")).where("text <> ''")
    return op.confidence_of_pages(words.withColumn("conf", F.when(F.length("text") > 2, F.col("confidence"))))


QUERIES = {
    "repeated_heads": repeated_heads, "weighted_mode": weighted_mode, "geometry_census": geometry_census, "upper_median": upper_median, "page_classes": page_classes,
    "heading_levels": heading_levels, "joined_paragraphs": joined_paragraphs, "gaps_above": gaps_above, "best_overlaps": best_overlaps, "overlapping": overlapping,
    "nearest_geometry": nearest_geometry, "blank_bands": blank_bands, "margin_boxes": margin_boxes, "page_grades": page_grades, "line_confidence": line_confidence,
}

_X = "WITH X AS (SELECT DISTINCT book_id, page, pos, block_key AS key, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1, type, text FROM blocks WHERE page > 0 AND bbox IS NOT NULL), G AS (SELECT book_id, page, max(x1) AS width, max(y1) AS height FROM X GROUP BY 1, 2), O AS (SELECT DISTINCT page_key, book_id, page, text, confidence FROM ocr_pages)"
_SHARE = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) / nullif(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 0)"
ORACLE = {
    "repeated_heads": _X + r""", L AS (SELECT book_id, page, split_part(text, chr(10), 1) AS line FROM O), H AS (SELECT book_id, lower(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS head, count(DISTINCT page) AS n_pages FROM L WHERE length(trim(line)) BETWEEN 1 AND 90 GROUP BY 1, 2)
    SELECT H.* FROM H JOIN (SELECT book_id, count(DISTINCT page) AS pages FROM L GROUP BY 1) USING (book_id) WHERE n_pages >= greatest(3, floor(pages * 0.25))""",
    "weighted_mode": "SELECT source, arg_max(size, w * 1000000000 - first_seen) AS mode FROM (SELECT source, CAST(n_chars // 100 AS INTEGER) AS size, CAST(sum(n_chars) AS BIGINT) AS w, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2) GROUP BY 1",
    "geometry_census": _X + ", C AS (SELECT book_id, CAST(round_even(width / 2, 0) * 2 AS INTEGER) AS width, CAST(round_even(height / 2, 0) * 2 AS INTEGER) AS height, count(*) AS n_pages, min(page) AS first_page FROM G GROUP BY 1, 2, 3) SELECT book_id, width, height, n_pages, row_number() OVER (PARTITION BY book_id ORDER BY n_pages DESC, first_page, width, height) = 1 AS dominant FROM C",
    "upper_median": "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents WHERE n_chars IS NOT NULL GROUP BY 1",
    "page_classes": _X + " SELECT book_id, CASE WHEN NOT bool_or(length(text) >= 1000) THEN 'scanned' WHEN avg(CASE WHEN length(text) >= 1000 THEN 1 ELSE 0 END) < 0.92 OR bool_or(length(text) < 1000 AND coalesce(confidence < 80, false)) THEN 'mixed' ELSE 'digital' END AS class FROM O GROUP BY 1",
    "heading_levels": _X + " SELECT key, CASE WHEN length(text) > 120 THEN NULL WHEN (y1 - y0) / 12 >= 1.8 THEN 1 WHEN (y1 - y0) / 12 >= 1.45 THEN 2 WHEN (y1 - y0) / 12 >= 1.18 THEN 3 WHEN type = 'heading' AND length(text) <= 60 THEN 3 WHEN upper(text) = text AND y0 > 100 AND length(text) <= 60 THEN 3 END AS level FROM X WHERE text IS NOT NULL",
    "joined_paragraphs": SQL.rstrip() + r""", A AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px FROM B WHERE text IS NOT NULL AND type <> 'pagebreak' WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
    I AS (SELECT *, sum(CASE WHEN coalesce(type = 'paragraph' AND pt = 'paragraph' AND NOT regexp_matches(rtrim(px), '[.!?؟…:»”"'')]$') AND NOT regexp_matches(ltrim(text), '^\p{Lu}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY pos) AS island FROM A)
    SELECT book_id, min(pos) AS pos, string_agg(trim(text), ' ' ORDER BY pos) AS text, count(*) AS n FROM I GROUP BY book_id, island""",
    "gaps_above": _X + ' SELECT key, y0 - lag(y1) OVER w AS gap, row_number() OVER w = 1 AS starts_page, min(x0) OVER p AS "left", max(x1) OVER p AS "right" FROM X WINDOW p AS (PARTITION BY book_id, page), w AS (PARTITION BY book_id, page ORDER BY y0, pos)',
    "best_overlaps": _X + f" SELECT book_id, page, key, other_key, share FROM (SELECT a.book_id, a.page, a.key, b.key AS other_key, share, row_number() OVER (PARTITION BY a.key ORDER BY share DESC, b.pos) AS place FROM (SELECT a, b, {_SHARE} AS share FROM X a JOIN (SELECT * REPLACE (y0 + 20 AS y0, y1 + 20 AS y1) FROM X) b ON a.book_id = b.book_id AND a.page = b.page) WHERE share >= 0.35) WHERE place = 1",
    "overlapping": _X + f", Y AS (SELECT * REPLACE (y0 - 10 AS y0, y1 + 10 AS y1) FROM X WHERE type NOT IN ('image', 'table')), Z AS (SELECT * FROM X WHERE type IN ('image', 'table')) SELECT a.book_id, a.page, a.key, b.key AS other_key FROM Y a JOIN Z b ON a.book_id = b.book_id AND a.page = b.page WHERE {_SHARE} > 0.15",
    "nearest_geometry": _X + " SELECT book_id, page, arg_min(size_no, abs(width - w) + abs(height - h) + size_no * 1e-9) AS size_no FROM G, (VALUES (0, 360.0, 500.0), (1, 350.0, 560.0), (2, 350.0, 300.0)) d(size_no, w, h) GROUP BY 1, 2",
    "blank_bands": _X + ", A AS (SELECT book_id, page, coalesce(max(y1) OVER (PARTITION BY book_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 60.0) AS from_y, y0 AS to_y FROM X UNION ALL SELECT book_id, page, max(y1), 560.0 FROM X GROUP BY 1, 2 HAVING max(y1) < 548) SELECT * FROM A WHERE to_y - from_y > 0.35 * 500",
    "margin_boxes": _X + " SELECT key, y1 <= 86 OR y0 >= 494 AS furniture, x1 - x0 >= 24 AND y1 - y0 >= 24 AS illustration FROM X",
    "page_grades": _X + " SELECT page_key, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 85 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS grade FROM O",
    "line_confidence": _X + ", L AS (SELECT page_key, confidence, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM O), W AS (SELECT page_key, line_no, confidence, unnest(string_split(line, ' ')) AS w FROM L) SELECT page_key, line_no, CAST(sum(length(w)) AS BIGINT) AS n_chars, sum(length(w) * confidence) FILTER (WHERE length(w) > 2 AND confidence IS NOT NULL) / sum(length(w)) FILTER (WHERE length(w) > 2 AND confidence IS NOT NULL) AS confidence FROM W WHERE w <> '' GROUP BY 1, 2",
}
