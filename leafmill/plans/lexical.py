"""Queries of text functions: markup, Persian typography, cutting, scripts, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import markup, persian, segments
from leafmill.plans.common import blocks, documents
from leafmill.sources.files import markdown_blocks
from leafmill.sources.html import html_blocks


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).where("target <> ''").select("block_key", "target")


def markup_signatures(spark: SparkSession, folder: str) -> DataFrame:
    t = markup.spans_of(_targets(spark, folder), "target").withColumn("e", markup.emphasis_signature(F.col("spans")))
    return t.select("block_key", "e.*", F.length(markup.plain_of(F.col("spans"))).alias("n_plain"))


def document_notes(spark: SparkSession, folder: str) -> DataFrame:
    d = markup.spans_of(documents(spark, folder), "text").select("doc_id", markup.notes_of(F.col("spans")).alias("notes"))
    return d.select("doc_id", F.posexplode("notes").alias("at", "note_id"))


def normalised_sources(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).where("text is not null").select("block_key", markup.normalised_source(F.col("text")).alias("text"))


def fixed_targets(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark, folder).where(F.col("target").rlike("[؀-ۿ]"))
    return t.select("block_key", "target", persian.fa_fix(F.col("target")).alias("fixed")).where("fixed <> target").select("block_key", "fixed")


def typography_lint(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark, folder).select("block_key", persian.fa_lint(F.col("target")).alias("codes"))
    return t.select("block_key", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def typography_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark, folder).select("block_key", persian.fa_suggestions(F.col("target")).alias("codes"))
    return t.select("block_key", F.explode("codes").alias("code")).groupBy("block_key", "code").agg(F.count(F.lit(1)).alias("n"))


def normalised_targets(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark, folder).where(F.col("target").rlike("[؀-ۿ]"))
    return t.select("block_key", "target", persian.fa_normalize(F.col("target")).alias("normalised")).where("normalised <> target").select("block_key", "normalised")


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).where(F.col("text").rlike("[؀-ۿ]")).select(persian.fa_rule_hits(F.col("text")).alias("hits"))
    return d.select(F.explode("hits").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_documents"))


def text_pieces(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).select("doc_id", segments.pieces_of(900)(F.col("text")).alias("pieces"))
    return d.select("doc_id", F.posexplode("pieces").alias("piece", "text")).select("doc_id", "piece", F.length("text").alias("n_chars"))


def packed_units(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder).select("book_id", "pos", F.coalesce(F.length("text"), F.lit(0)).alias("cost"))
    return segments.pack(b, "book_id", "pos", "cost", 900)


def script_runs(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark, folder).select("block_key", segments.script_runs(F.col("target")).alias("runs"))
    return t.select("block_key", F.size("runs").alias("n_runs"), F.size(F.filter("runs", lambda r: r["latin"])).alias("n_latin"))


def html_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages with a heading, paragraphs and a list, read back as blocks."""
    d = read_pages(documents(spark, folder)).select("doc_id", html_blocks(F.col("html")).alias("blocks"))
    return d.select("doc_id", F.explode("blocks").alias("b")).groupBy("doc_id", F.col("b.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def read_pages(d: DataFrame) -> DataFrame:
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    paragraphs = F.array_join(F.transform(F.filter(F.split(escaped, "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav>n</nav><h1>"), F.col("source"), F.lit("</h1>"), paragraphs, F.lit("<ul><li>a</li></ul></body></html>"))
    return d.where("source is not null").select("doc_id", html.alias("html"))


def markdown_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as Markdown: neighbouring lines are one paragraph."""
    lines = documents(spark, folder).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return markdown_blocks(lines).select("doc", "pos", "type", F.length("text").alias("n_chars"))


QUERIES = {
    "markup_signatures": markup_signatures, "document_notes": document_notes, "normalised_sources": normalised_sources, "fixed_targets": fixed_targets,
    "typography_lint": typography_lint, "typography_suggestions": typography_suggestions, "normalised_targets": normalised_targets, "rule_hits": rule_hits, "text_pieces": text_pieces, "packed_units": packed_units, "script_runs": script_runs,
    "html_of_documents": html_of_documents, "markdown_of_documents": markdown_of_documents,
}

_LINES = "WITH L AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)"
ORACLE = {
    "document_notes": r"WITH R AS (SELECT doc_id, regexp_extract_all(text, '\[\[fn:(fn\d{4,})\]\]', 1) AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, generate_subscripts(r, 1) - 1 AS at, unnest(r) AS note_id FROM R",
    "packed_units": """WITH RECURSIVE B AS (SELECT DISTINCT block_key, book_id, pos, coalesce(length(text), 0) AS cost FROM blocks), Q AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS n FROM B),
    S AS (SELECT book_id, pos, n, 0 AS job_no, cost AS size FROM Q WHERE n = 1 UNION ALL SELECT Q.book_id, Q.pos, Q.n, CASE WHEN size > 0 AND size + cost > 900 THEN job_no + 1 ELSE job_no END, CASE WHEN size > 0 AND size + cost > 900 THEN cost ELSE size + cost END FROM S JOIN Q ON S.book_id = Q.book_id AND Q.n = S.n + 1)
    SELECT book_id, pos, job_no FROM S""",
    "html_of_documents": "SELECT doc_id, 'paragraph' AS type, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')) > 0 UNION ALL SELECT doc_id, unnest(['heading', 'listitem']), 1 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
}
