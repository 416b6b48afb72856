"""Queries on rendered pages and on what is exchanged with translators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.naming import rtl_share
from leafmill.operators import exchange as ex
from leafmill.operators import rendering as rd
from leafmill.operators.references import reference_key
from leafmill.plans.common import SQL, blocks
from leafmill.plans.layout import boxes
from leafmill.session import read_table


def outside_page(spark: SparkSession, folder: str) -> DataFrame:
    return rd.outside_page(boxes(spark, folder), 352.0, 540.0)


def text_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a page looked for in the text of the page's other blocks and their own."""
    b = blocks(spark, folder).where("page > 0 and text is not null")
    pages = b.groupBy("book_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("shown"))
    return rd.presence(b.select("book_id", "page", F.col("id").alias("unit"), "text"), pages)


def repeated_figures(spark: SparkSession, folder: str) -> DataFrame:
    return rd.repeated_figures(boxes(spark, folder)).select("key")


def reading_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Slots for boxes moved down by 30 points, among the blocks of their page."""
    b = boxes(spark, folder)
    return rd.reading_slots(b.withColumn("y0", F.col("y0") + 30), b)


def first_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of a book's blocks in order against their order without captions."""
    b = blocks(spark, folder).select(F.col("book_id").alias("owner"), "pos", F.col("type").alias("value"))
    return rd.first_differences(b, b.where("value <> 'caption'"))


def eligibility(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks as jobs, answered by their targets; lists expect another request, headings moved since."""
    b = blocks(spark, folder)
    jobs = b.select(F.col("block_key").alias("job_id"), F.concat(F.lit("t"), F.when(F.col("type") == "listitem", "x").otherwise("")).alias("token"), F.coalesce("text", F.lit("")).alias("source_digest"))
    replies = b.where("target is not null").select(F.col("block_key").alias("job_id"), F.lit("t").alias("token"), F.when(F.col("target") == "", "empty").otherwise("answered").alias("verdict"))
    live = b.where("text is not null").select(F.col("block_key").alias("job_id"), F.when(F.col("type") == "heading", F.lower("text")).otherwise(F.col("text")).alias("digest"))
    return ex.eligibility(jobs, replies, live)


def review_coverage(spark: SparkSession, folder: str) -> DataFrame:
    units = blocks(spark, folder).select(F.concat("book_id", F.lit("/"), "id").alias("unit"))
    r = read_table(spark, folder, "reviews").dropDuplicates(["review_key"]).where("book_id is not null and id is not null")
    return ex.review_coverage(units, r.select(F.concat("book_id", F.lit("/"), reference_key(F.col("id"))).alias("unit")))


def page_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages by the grade of their recognition."""
    p = read_table(spark, folder, "ocr_pages").dropDuplicates(["page_key"])
    state = F.when(F.col("confidence") >= 85, "accepted").when(F.col("confidence").isNull(), "stale").otherwise("failed")
    return ex.progress(p.select("book_id", "page", state.alias("state"), F.length("text").alias("payload")))


def request_tokens(spark: SparkSession, folder: str) -> DataFrame:
    w = read_table(spark, folder, "worksheets", ["worksheet_id", "text"]).where("text is not null").dropDuplicates(["worksheet_id"])
    return ex.request_tokens(w.select(F.col("worksheet_id").alias("sheet"), "text"))


def target_direction(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder).where("target <> ''").select("book_id", rtl_share(F.col("target")).alias("share"))
    return b.groupBy("book_id").agg(F.count_if(F.col("share") > 0.5).alias("n_rtl"), F.count_if(F.col("share") <= 0.5).alias("n_ltr"))


QUERIES = {
    "outside_page": outside_page, "text_presence": text_presence, "repeated_figures": repeated_figures, "reading_slots": reading_slots, "first_differences": first_differences,
    "eligibility": eligibility, "review_coverage": review_coverage, "page_progress": page_progress, "request_tokens": request_tokens, "target_direction": target_direction,
}

_X = "WITH X AS (SELECT DISTINCT book_id, page, pos, block_key AS key, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM blocks WHERE page > 0 AND bbox IS NOT NULL)"
_ID = "trim(regexp_replace(lower({0}), '#.*$', ''))"
ORACLE = {
    "outside_page": _X + " SELECT * FROM (SELECT book_id, page, key, CASE WHEN x0 < 0 OR y0 < 0 OR x1 > 352 OR y1 > 540 THEN 'text-clipped' WHEN x1 > 346 OR y1 > 534 THEN 'text-overflow' END AS problem FROM X) WHERE problem IS NOT NULL",
    "text_presence": SQL.rstrip() + r""", A AS (SELECT *, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 48) AS p FROM B WHERE page > 0 AND text IS NOT NULL), G AS (SELECT book_id, page, regexp_replace(string_agg(text, ' ' ORDER BY pos), '\s+', ' ', 'g') AS shown FROM A GROUP BY 1, 2),
    Z AS (SELECT A.book_id, A.id AS unit, p, CASE WHEN length(p) = 0 THEN 0 ELSE (length(shown) - length(replace(shown, p, ''))) // length(p) END AS found FROM A JOIN G USING (book_id, page))
    SELECT book_id, unit, CAST(found AS INTEGER) AS found, CASE WHEN length(p) < 4 THEN 'text-unverified' WHEN found = 0 THEN 'text-missing' WHEN found > 1 THEN 'text-duplicated' END AS problem FROM Z""",
    "repeated_figures": _X + ", Y AS (SELECT *, [round_even(x0 / 8, 0), round_even(y0 / 8, 0), round_even(x1 / 8, 0), round_even(y1 / 8, 0)] AS place FROM X), S AS (SELECT book_id, place, count(DISTINCT page) AS n FROM Y GROUP BY 1, 2), P AS (SELECT book_id, count(DISTINCT page) AS pages FROM Y GROUP BY 1 HAVING count(DISTINCT page) >= 4) SELECT key FROM Y WHERE NOT EXISTS (SELECT 1 FROM S JOIN P USING (book_id) WHERE S.book_id = Y.book_id AND S.place = Y.place AND n >= greatest(3, floor(pages * 0.25)))",
    "reading_slots": _X + " SELECT a.key, coalesce(min(b.pos) FILTER (WHERE b.y0 >= a.y0 + 30), max(b.pos) + 1) AS slot FROM X a JOIN X b ON a.book_id = b.book_id AND a.page = b.page GROUP BY 1",
    "first_differences": SQL.rstrip() + ", L AS (SELECT book_id AS owner, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS at_, type AS v FROM B), M AS (SELECT book_id AS owner, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS at_, type AS v FROM B WHERE type <> 'caption'), D AS (SELECT coalesce(L.owner, M.owner) AS owner, coalesce(L.at_, M.at_) AS at_, L.v AS left_value, M.v AS right_value FROM L FULL JOIN M ON L.owner = M.owner AND L.at_ = M.at_ WHERE L.v IS DISTINCT FROM M.v) SELECT owner, at_ AS at, left_value, right_value FROM D QUALIFY row_number() OVER (PARTITION BY owner ORDER BY at_) = 1",
    "eligibility": SQL + " SELECT job_id, state, state IN ('missing', 'empty', 'malformed', 'invalid', 'partial', 'wrong-request', 'stale-source') AS retryable FROM (SELECT block_key AS job_id, CASE WHEN target IS NULL THEN 'missing' WHEN type = 'listitem' THEN 'wrong-request' WHEN text IS NULL THEN 'unverified' WHEN type = 'heading' AND lower(text) <> text THEN 'stale-source' WHEN target = '' THEN 'empty' ELSE 'answered' END AS state FROM B)",
    "review_coverage": SQL.rstrip() + f", Y AS (SELECT book_id || '/' || id AS unit FROM B), V AS (SELECT book_id || '/' || {_ID.format('id')} AS unit FROM (SELECT DISTINCT ON (review_key) * FROM reviews) WHERE book_id IS NOT NULL AND id IS NOT NULL) SELECT DISTINCT unit, 'foreign' AS problem FROM V WHERE unit NOT IN (SELECT unit FROM Y) UNION ALL SELECT unit, 'twice' FROM V GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT unit, 'missing' FROM Y WHERE unit NOT IN (SELECT unit FROM V)",
    "page_progress": "WITH O AS (SELECT DISTINCT ON (page_key) *, CASE WHEN confidence >= 85 THEN 'accepted' WHEN confidence IS NULL THEN 'stale' ELSE 'failed' END AS state FROM ocr_pages) SELECT book_id, count(*) AS n_pages, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'stale') AS stale, max(length(text)) AS most_payload, min(page) FILTER (WHERE state <> 'accepted') AS next_page FROM O GROUP BY 1",
    "request_tokens": r"SELECT worksheet_id AS sheet, 'req1:' || substr(sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^<!--.*-->\s*$')), chr(10))), 1, 16) AS token FROM (SELECT DISTINCT ON (worksheet_id) * FROM worksheets WHERE text IS NOT NULL)",
}
