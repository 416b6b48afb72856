"""Queries on the units of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import blocks as op
from leafmill.plans.common import SQL, blocks, books, documents, notes


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = op.text_blocks(blocks(spark, folder), blank=False)
    return b.select("block_key", op.unit_kind(F.col("type"), F.col("level")).alias("kind"), F.length("text").alias("n_chars"))


def published_units(spark: SparkSession, folder: str) -> DataFrame:
    return op.published_units(books(spark, folder), blocks(spark, folder), notes(spark, folder))


def _published(spark: SparkSession, folder: str) -> DataFrame:
    return published_units(spark, folder)


def pending_units(spark: SparkSession, folder: str) -> DataFrame:
    return op.pending_units(_published(spark, folder)).select("book_id", "part", "id", "kind")


def unit_slots(spark: SparkSession, folder: str) -> DataFrame:
    return op.unit_slots(_published(spark, folder))


def blind_targets(spark: SparkSession, folder: str) -> DataFrame:
    return op.blind_targets(_published(spark, folder)).select("book_id", "id", "kind", "target")


def translatable_units(spark: SparkSession, folder: str) -> DataFrame:
    return op.translatable_units(blocks(spark, folder), notes(spark, folder)).select("book_id", "id", "kind")


def structure_projection(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).where("type in ('heading', 'listitem')").select("book_id", "pos", "type", "level")


def chapter_of_block(spark: SparkSession, folder: str) -> DataFrame:
    return op.chapter_of_block(blocks(spark, folder)).select("block_key", "chapter")


def page_of_block(spark: SparkSession, folder: str) -> DataFrame:
    return op.page_of_block(blocks(spark, folder)).select("block_key", "on_page")


def sections_in_force(spark: SparkSession, folder: str) -> DataFrame:
    """Sections begin at the headings of a book here."""
    b = blocks(spark, folder)
    starts = b.where("type = 'heading'").select("book_id", F.col("pos").alias("section_no"), F.col("id").alias("start_block"))
    return op.sections_in_force(b, starts).select("block_key", "section")


def note_pages(spark: SparkSession, folder: str) -> DataFrame:
    return op.note_pages(blocks(spark, folder), notes(spark, folder))


def referenced_notes(spark: SparkSession, folder: str) -> DataFrame:
    n = notes(spark, folder)
    used = op.note_references(blocks(spark, folder), "text").select("book_id", F.col("note_id").alias("id"))
    return n.join(used, ["book_id", "id"], "left_semi").select("book_id", "id")


def note_references(spark: SparkSession, folder: str) -> DataFrame:
    return op.note_references(blocks(spark, folder), "text").select("book_id", "block_id", F.col("ref_no").cast("long"), "note_id")


def unused_notes(spark: SparkSession, folder: str) -> DataFrame:
    return op.unused_notes(blocks(spark, folder), notes(spark, folder)).select("book_id", "id")


def undefined_notes(spark: SparkSession, folder: str) -> DataFrame:
    return op.undefined_notes(blocks(spark, folder), notes(spark, folder)).select("book_id", "block_id", "note_id")


def book_stats(spark: SparkSession, folder: str) -> DataFrame:
    return op.book_stats(blocks(spark, folder), notes(spark, folder))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return op.coverage(_published(spark, folder)).withColumn("part", F.coalesce("part", F.lit("all")))


def script_ratios(spark: SparkSession, folder: str) -> DataFrame:
    persian, latin = op.script_ratio(F.col("text"))
    return documents(spark, folder).select("doc_id", persian.alias("persian"), latin.alias("latin"))


def bbox_unions(spark: SparkSession, folder: str) -> DataFrame:
    return op.bbox_unions(blocks(spark, folder, "bbox"))


def repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that stand in several books, with how many."""
    return blocks(spark, folder).groupBy("id").agg(F.countDistinct("book_id").alias("n_books")).where("n_books > 1")


_SO_FAR = "OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_RATIO = "CASE WHEN p + l > 0 THEN {0} / (p + l) ELSE 0.0 END"
_ENTRIES = {
    "text_blocks": (text_blocks, "SELECT block_key, kind, n FROM (SELECT block_key, CASE type WHEN 'heading' THEN 'heading' || coalesce(level, 1) WHEN 'paragraph' THEN 'para' WHEN 'blockquote' THEN 'quote' WHEN 'listitem' THEN 'list' ELSE type END AS kind, length(text) AS n, text FROM T) WHERE coalesce(trim(text), '') <> ''".replace(" n FROM", " n AS n_chars FROM", 1)),
    "published_units": (published_units, "SELECT * FROM P"),
    "pending_units": (pending_units, "SELECT book_id, part, id, kind FROM P WHERE coalesce(trim(source), '') <> '' AND coalesce(trim(target), '') = '' AND trim(regexp_replace(source, '`[^`]*`', '', 'g')) <> ''"),
    "unit_slots": (unit_slots, "SELECT book_id, id, CASE part WHEN 'metadata' THEN 'books' WHEN 'note' THEN 'footnotes' ELSE 'blocks' END AS table_name, CASE part WHEN 'metadata' THEN id || '_target' ELSE 'target' END AS field FROM P"),
    "blind_targets": (blind_targets, "SELECT book_id, id, kind, target FROM P WHERE coalesce(trim(target), '') <> ''"),
    "translatable_units": (translatable_units, "SELECT book_id, id, kind FROM U WHERE part_no = 1 UNION ALL SELECT book_id, id, 'note' FROM N WHERE (book_id, id) IN (SELECT R.book_id, note_id FROM R JOIN T ON R.book_id = T.book_id AND R.block_id = T.id)"),
    "structure_projection": (structure_projection, "SELECT book_id, pos, type, level FROM B WHERE type IN ('heading', 'listitem')"),
    "chapter_of_block": (chapter_of_block, f"SELECT block_key, coalesce(last_value(CASE WHEN type = 'heading' AND coalesce(level, 9) <= 2 THEN id END IGNORE NULLS) {_SO_FAR}, 'front') AS chapter FROM B"),
    "page_of_block": (page_of_block, f"SELECT block_key, coalesce(last_value(CASE WHEN page > 0 THEN page END IGNORE NULLS) {_SO_FAR}, 1) AS on_page FROM B"),
    "sections_in_force": (sections_in_force, f"SELECT block_key, last_value(CASE WHEN type = 'heading' THEN pos END IGNORE NULLS) {_SO_FAR} AS section FROM B"),
    "note_pages": (note_pages, f", G AS (SELECT *, coalesce(last_value(CASE WHEN page > 0 THEN page END IGNORE NULLS) {_SO_FAR}, 1) AS on_page FROM B), "
        "F AS (SELECT R.book_id, note_id, min_by(on_page, R.pos * 1000000 + ref_no) AS ref_page FROM R JOIN G ON R.book_id = G.book_id AND R.block_id = G.id GROUP BY 1, 2) "
        "SELECT N.book_id, N.id, coalesce(F.ref_page, G.on_page) AS on_page FROM N LEFT JOIN F ON N.book_id = F.book_id AND N.id = F.note_id LEFT JOIN G ON N.book_id = G.book_id AND N.anchor_block = G.id"),
    "referenced_notes": (referenced_notes, "SELECT book_id, id FROM N WHERE (book_id, id) IN (SELECT book_id, note_id FROM R)"),
    "note_references": (note_references, "SELECT book_id, block_id, ref_no, note_id FROM R"),
    "unused_notes": (unused_notes, "SELECT book_id, id FROM N WHERE (book_id, id) NOT IN (SELECT book_id, note_id FROM R)"),
    "undefined_notes": (undefined_notes, "SELECT book_id, block_id, note_id FROM R WHERE (book_id, note_id) NOT IN (SELECT book_id, id FROM N)"),
    "book_stats": (book_stats, "SELECT b.*, coalesce(n.n, 0) AS n_notes FROM (SELECT book_id, count(*) AS n_blocks, count(*) FILTER (WHERE type = 'heading') AS n_headings, count(*) FILTER (WHERE type = 'paragraph') AS n_paragraphs, count(*) FILTER (WHERE type = 'caption') AS n_captions, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, count(*) FILTER (WHERE type IN ('heading','paragraph','blockquote','listitem','caption','verse') AND coalesce(trim(target), '') <> '') AS n_translated FROM B GROUP BY 1) b LEFT JOIN (SELECT book_id, count(*) AS n FROM N GROUP BY 1) n USING (book_id)"),
    "coverage": (coverage, "SELECT book_id, coalesce(part, 'all') AS part, count(*) AS n_units, count(*) FILTER (WHERE coalesce(trim(target), '') <> '') AS n_translated FROM P WHERE coalesce(trim(source), '') <> '' GROUP BY GROUPING SETS ((book_id, part), (book_id))"),
    "bbox_unions": (bbox_unions, ", X AS (SELECT DISTINCT block_key, book_id, page, bbox FROM blocks) SELECT book_id, page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM X WHERE page > 0 AND bbox IS NOT NULL GROUP BY 1, 2"),
    "repeated_ids": (repeated_ids, "SELECT id, count(DISTINCT book_id) AS n_books FROM B GROUP BY 1 HAVING count(DISTINCT book_id) > 1"),
}

QUERIES = {name: query for name, (query, _) in _ENTRIES.items()} | {"script_ratios": script_ratios}
ORACLE = {name: SQL.rstrip() + (sql if sql.startswith(",") else "\n" + sql) for name, (_, sql) in _ENTRIES.items()} | {
    "script_ratios": "SELECT doc_id, " + _RATIO.format("p") + " AS persian, " + _RATIO.format("l") + " AS latin FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS p, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents WHERE text IS NOT NULL)"
}
