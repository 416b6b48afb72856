"""Queries that cut books into jobs and check the cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import jobs as op
from leafmill.plans.common import SQL, blocks, documents

#: A budget small enough for the test books to have many chunks.
BUDGET = 1400


def chunk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return op.chunks(blocks(spark, folder), BUDGET).select("book_id", "id", "chunk_no")


def neighbour_context(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of the runs of blocks on one sheet of 20 (no chunks, so that SQL can follow)."""
    b = blocks(spark, folder)
    runs = op.batches(b, ["pos"]).select("book_id", "pos", "id", F.col("sheet").alias("chunk_no"))
    return op.neighbours(runs, b)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    split = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return split.select(F.col("doc_id").alias("owner"), "seq", "text")


def unit_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return op.unit_offsets(_lines(spark, folder)).select("owner", "seq", "offset", F.col("length").cast("long"))


def span_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as spans of their document, shifted where their number is divisible by five, so that all problems occur."""
    spans = op.unit_offsets(_lines(spark, folder)).join(documents(spark, folder).select(F.col("doc_id").alias("owner"), F.length("text").alias("whole")), "owner")
    shifted = F.when(F.col("seq") % 5 == 4, F.col("offset") + F.col("seq") % 3 - 1).otherwise(F.col("offset"))
    spans = spans.select("owner", shifted.cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.col("whole").cast("long").alias("whole"))
    return op.span_problems(spans)


def segment_ids(spark: SparkSession, folder: str) -> DataFrame:
    r = spark.read.parquet(f"{folder}/reviews.parquet").select("id").where("id is not null").distinct()
    return r.select("id", op.segment_owner(F.col("id")).alias("owner"), op.segment_index(F.col("id")).alias("segment"))


def rejoined_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines as numbered segments, put together again."""
    parts = _lines(spark, folder).select(F.concat(F.lit("d"), "owner", F.lit("#"), F.col("seq") + 1).alias("unit"), "text")
    return op.rejoined(parts)


def segment_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of documents against those that come with a letter, and every tenth also whole."""
    lines = _lines(spark, folder)
    unit = F.concat(F.lit("d"), "owner", F.lit("#"), F.col("seq") + 1).alias("unit")
    answered = lines.where(F.col("text").rlike("[A-Za-z]")).select(unit)
    whole = lines.where("owner % 10 = 0").select(F.concat(F.lit("d"), "owner").alias("unit")).distinct()
    return op.segment_problems(lines.select(unit), answered.unionByName(whole))


def sheet_batches(spark: SparkSession, folder: str) -> DataFrame:
    return op.batches(blocks(spark, folder), ["pos"]).select("book_id", "id", "sheet")


def next_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The first block of each book that has a text and no target."""
    jobs = blocks(spark, folder).where("text <> ''").withColumn("done", F.coalesce(F.col("target") != "", F.lit(False)))
    return op.next_jobs(jobs)


def book_digests(spark: SparkSession, folder: str) -> DataFrame:
    return op.book_digests(blocks(spark, folder), ["id", "type", "text"], "source1")


QUERIES = {
    "chunk_blocks": chunk_blocks, "neighbour_context": neighbour_context, "unit_offsets": unit_offsets, "span_problems": span_problems,
    "segment_ids": segment_ids, "rejoined_segments": rejoined_segments, "segment_problems": segment_problems, "sheet_batches": sheet_batches,
    "next_jobs": next_jobs, "book_digests": book_digests,
}

_CAP, _QUARTER = int(BUDGET * 1.35), BUDGET * 0.25
_LINES = """WITH L AS (SELECT doc_id AS owner, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, text AS whole_text FROM documents WHERE text IS NOT NULL)"""
_OFFSETS = "SELECT owner, seq, text, whole_text, coalesce(sum(length(text)) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\", length(text) AS length FROM L"
ORACLE = {
    "chunk_blocks": SQL.replace("WITH B", "WITH RECURSIVE B", 1)
    + f""", Q AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS n, id, coalesce(length(text), 0) AS cost, (type = 'heading' AND coalesce(level, 9) <= 2) AS opens, (type IN ('paragraph', 'blockquote', 'verse') AND coalesce(length(text), 0) > 120) AS prose FROM B),
    S AS (
      SELECT book_id, n, id, 1 AS chunk_no, CASE WHEN cost >= {BUDGET} AND NOT opens THEN 2 ELSE 1 END AS open_no, CASE WHEN cost >= {BUDGET} AND NOT opens THEN 0 ELSE cost END AS size, CASE WHEN cost >= {BUDGET} AND NOT opens THEN 0 ELSE 1 END AS held, prose AND NOT (cost >= {BUDGET} AND NOT opens) AS pr FROM Q WHERE n = 1
      UNION ALL
      SELECT book_id, n, id, no, CASE WHEN full_ THEN no + 1 ELSE no END, CASE WHEN full_ THEN 0 ELSE total END, CASE WHEN full_ THEN 0 ELSE kept + 1 END, NOT full_ AND (prose OR had)
      FROM (SELECT *, total >= {BUDGET} AND NOT opens AS full_ FROM (
        SELECT Q.book_id, Q.n, Q.id, Q.opens, Q.prose, CASE WHEN c THEN open_no + 1 ELSE open_no END AS no, CASE WHEN c THEN 0 ELSE size END + Q.cost AS total, CASE WHEN c THEN 0 ELSE held END AS kept, NOT c AND pr AS had
        FROM (SELECT S.*, S.held > 0 AND (Q2.opens OR S.size + Q2.cost > {_CAP}) AND NOT (Q2.opens AND S.size < {_QUARTER} AND NOT S.pr) AS c FROM S JOIN Q Q2 ON S.book_id = Q2.book_id AND Q2.n = S.n + 1) S JOIN Q ON S.book_id = Q.book_id AND Q.n = S.n + 1))
    ) SELECT book_id, id, chunk_no FROM S""",
    "neighbour_context": SQL + """, G AS (SELECT book_id, (rn - 1) // 20 AS chunk_no, string_agg(text, chr(10) ORDER BY pos) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS rn FROM B) GROUP BY 1, 2)
    SELECT book_id, CAST(chunk_no AS INTEGER) AS chunk_no, coalesce(lag("right"(whole, 450)) OVER w, '') AS before, coalesce(lead("left"(whole, 450)) OVER w, '') AS after FROM G WINDOW w AS (PARTITION BY book_id ORDER BY chunk_no)""",
    "unit_offsets": _LINES + f' SELECT owner, seq, CAST("offset" AS BIGINT) AS "offset", length FROM ({_OFFSETS})',
    "span_problems": _LINES + f""", O AS (SELECT owner, CASE WHEN seq % 5 = 4 THEN "offset" + seq % 3 - 1 ELSE "offset" END AS "offset", length, length(whole_text) AS whole FROM ({_OFFSETS})),
    J AS (SELECT *, coalesce(max("offset" + length) OVER (PARTITION BY owner ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM O)
    SELECT owner, CAST("offset" AS BIGINT) AS at, CASE WHEN "offset" < reached THEN 'overlap' ELSE 'gap' END AS problem FROM J WHERE "offset" <> reached
    UNION ALL SELECT owner, CAST(max("offset" + length) AS BIGINT), 'uncovered' FROM O GROUP BY owner, whole HAVING max("offset" + length) < whole""",
    "segment_ids": "SELECT DISTINCT id, coalesce(nullif(regexp_extract(id, '^(.+)#[0-9]+$', 1), ''), id) AS owner, TRY_CAST(nullif(regexp_extract(id, '#([0-9]+)$', 1), '') AS INTEGER) AS segment FROM reviews WHERE id IS NOT NULL",
    "rejoined_segments": _LINES + " SELECT 'd' || owner AS owner, coalesce(string_agg(trim(text), ' ' ORDER BY seq) FILTER (WHERE trim(text) <> ''), '') AS text FROM L GROUP BY L.owner",
    "segment_problems": _LINES + """ SELECT DISTINCT 'd' || owner AS owner, 'missing' AS problem FROM L WHERE NOT regexp_matches(text, '[A-Za-z]')
    UNION SELECT DISTINCT 'd' || owner, 'whole and split' FROM L WHERE owner % 10 = 0 AND regexp_matches(text, '[A-Za-z]')""",
    "sheet_batches": SQL + " SELECT book_id, id, CAST((row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) // 20 AS INTEGER) AS sheet FROM B",
    "next_jobs": SQL + " SELECT book_id, min_by(id, pos) AS next_id FROM B WHERE text <> '' AND coalesce(target, '') = '' GROUP BY 1",
    "book_digests": SQL + """ SELECT book_id, 'source1:' || sha256(string_agg(d, chr(10) ORDER BY range_)) AS digest FROM (SELECT book_id, floor(pos / 1024) AS range_, sha256(string_agg(sha256(concat_ws(chr(31), coalesce('=' || id, '-'), coalesce('=' || type, '-'), coalesce('=' || text, '-'))), chr(10) ORDER BY pos, id)) AS d FROM B GROUP BY 1, 2) GROUP BY 1""",
}
