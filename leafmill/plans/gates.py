"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators import gates as op
from leafmill.operators.blocks import published_units
from leafmill.plans.common import SQL, blocks, books, notes
from leafmill.session import checkpoint


def qa_structure(spark: SparkSession, folder: str) -> DataFrame:
    return op.structure_gate(blocks(spark, folder))


def qa_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return op.coverage_gate(published_units(books(spark, folder), blocks(spark, folder), notes(spark, folder)))


def qa_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return op.length_gate(blocks(spark, folder))


def qa_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return op.duplicate_gate(blocks(spark, folder))


def qa_copied_runs(spark: SparkSession, folder: str) -> DataFrame:
    return op.copied_gate(blocks(spark, folder))


def qa_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Note markers and code spans; emphasis, which SQL cannot parse, is `qa_emphasis`."""
    return op.marker_gate(blocks(spark, folder))


def qa_emphasis(spark: SparkSession, folder: str) -> DataFrame:
    return op.emphasis_gate(blocks(spark, folder))


def qa_notes(spark: SparkSession, folder: str) -> DataFrame:
    return op.note_gate(blocks(spark, folder), notes(spark, folder))


def qa_typography(spark: SparkSession, folder: str) -> DataFrame:
    return op.typography_gate(blocks(spark, folder))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    """All gates over one reading of each table, deliveries settled once."""
    b, n = checkpoint(blocks(spark, folder)), checkpoint(notes(spark, folder))
    units = published_units(books(spark, folder), b, n)
    per_block = (op.structure_gate, op.length_gate, op.duplicate_gate, op.copied_gate, op.parity_gate, op.typography_gate)
    return op.all_findings(*(gate(b) for gate in per_block), op.coverage_gate(units), op.note_gate(b, n))


def qa_summary(spark: SparkSession, folder: str) -> DataFrame:
    return op.summary(_all(spark, folder))


def qa_report(spark: SparkSession, folder: str) -> DataFrame:
    return op.shown_findings(_all(spark, folder)).select("book_id", "place", "severity", "code", "unit")


QUERIES = {
    "qa_structure": qa_structure, "qa_coverage": qa_coverage, "qa_lengths": qa_lengths, "qa_duplicates": qa_duplicates,
    "qa_copied_runs": qa_copied_runs, "qa_parity": qa_parity, "qa_emphasis": qa_emphasis, "qa_notes": qa_notes, "qa_typography": qa_typography,
    "qa_summary": qa_summary, "qa_report": qa_report,
}

_F = "SELECT '{sev}' AS severity, '{code}' AS code, book_id, {unit} AS unit, substr({detail}, 1, 200) AS detail FROM {rows}"
_f = lambda sev, code, unit, detail, rows: _F.format(sev=sev, code=code, unit=unit, detail=detail, rows=rows)
_BLANK = "coalesce(trim({0}), '') = ''"
_TREFS = "(SELECT R.* FROM R JOIN T ON R.book_id = T.book_id AND R.block_id = T.id)"
_MARKS = r"list_sort(regexp_extract_all(regexp_replace({0}, '`[^`]*`', '', 'g'), '\[\[fn:([A-Za-z0-9_-]+)\]\]', 1))"
_CODE = "list_sort(regexp_extract_all({0}, '`([^`]*)`', 1))"
_SQL = {
    "qa_structure": " UNION ALL ".join([
        _f("error", "missing-id", "CAST(pos AS VARCHAR)", "type", f"B WHERE {_BLANK.format('id')}"),
        _f("error", "unknown-type", "id", "coalesce(type, '')", "B WHERE coalesce(type NOT IN ('heading','paragraph','blockquote','listitem','caption','verse','image','pagebreak','separator','table','layout'), true)"),
        _f("error", "heading-level", "id", "coalesce(CAST(level AS VARCHAR), 'none')", "B WHERE type = 'heading' AND NOT coalesce(level BETWEEN 1 AND 6, false)"),
        _f("error", "duplicate-id", "id", "CAST(n AS VARCHAR)", f"(SELECT book_id, id, count(*) AS n FROM B WHERE NOT ({_BLANK.format('id')}) GROUP BY 1, 2 HAVING count(*) > 1)"),
    ]),
    "qa_coverage": "SELECT 'error' AS severity, CASE part WHEN 'note' THEN 'untranslated-note' WHEN 'caption' THEN 'untranslated-alt' ELSE 'untranslated-block' END AS code, book_id, id AS unit, substr(source, 1, 200) AS detail FROM P WHERE coalesce(trim(source), '') <> '' AND coalesce(trim(target), '') = ''",
    "qa_lengths": "SELECT CASE WHEN r < 0.55 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN r < 0.55 THEN 'possible-omission' ELSE 'possible-padding' END AS code, book_id, id AS unit, length(target) || '/' || length(text) AS detail FROM (SELECT *, length(target) / length(text) AS r FROM B WHERE coalesce(trim(target), '') <> '' AND length(text) >= 120) WHERE r < 0.55 OR r > 2.4",
    "qa_duplicates": "SELECT 'error' AS severity, 'duplicate-translation' AS code, book_id, id AS unit, first_id AS detail FROM (SELECT *, first_value(id) OVER w AS first_id, first_value(text) OVER w AS first_text FROM B WHERE length(target) > 120 WINDOW w AS (PARTITION BY book_id, target ORDER BY pos)) WHERE id <> first_id AND text IS DISTINCT FROM first_text",
    "qa_copied_runs": r"SELECT 'warning' AS severity, 'copied-source-run' AS code, book_id, id AS unit, run AS detail FROM (SELECT *, list_filter(list_transform(range(1, length(text) - 38), lambda i: substr(text, i, 40)), lambda x: regexp_matches(x, '\p{L}') AND contains(target, x))[1] AS run FROM T WHERE length(text) >= 40 AND length(target) >= 40) WHERE run IS NOT NULL",
    "qa_parity": f", M AS (SELECT *, {_MARKS.format('text')} AS s, {_MARKS.format('target')} AS t, {_CODE.format('text')} AS sv, {_CODE.format('target')} AS tv FROM T WHERE coalesce(trim(text), '') <> '' AND coalesce(trim(target), '') <> ''), "
        "L AS (SELECT *, list_distinct(list_filter(s, lambda x: NOT list_contains(t, x))) AS lost, list_distinct(list_filter(t, lambda x: NOT list_contains(s, x))) AS made FROM M) "
        + " UNION ALL ".join([
            _f("error", "footnote-marker-lost", "id", "array_to_string(list_sort(lost), ',')", "L WHERE len(lost) > 0"),
            _f("error", "footnote-marker-invented", "id", "array_to_string(list_sort(made), ',')", "L WHERE len(made) > 0"),
            _f("error", "verbatim-content-changed", "id", "array_to_string(sv, ',')", "L WHERE sv <> tv"),
        ]),
    "qa_notes": f", E AS (SELECT * FROM {_TREFS}) " + " UNION ALL ".join([
        _f("error", "footnote-undefined", "block_id", "note_id", "E WHERE (book_id, note_id) NOT IN (SELECT book_id, id FROM N)"),
        _f("error", "footnote-multiple-anchors", "note_id", "CAST(n AS VARCHAR)", "(SELECT book_id, note_id, count(*) AS n FROM E GROUP BY 1, 2 HAVING count(*) > 1)"),
        _f("error", "footnote-body-empty", "id", "coalesce(anchor_block, '')", f"N WHERE (book_id, id) IN (SELECT book_id, note_id FROM E) AND {_BLANK.format('text')} AND {_BLANK.format('target')}"),
        _f("warning", "footnote-unreferenced", "id", "coalesce(anchor_block, '')", "N WHERE (book_id, id) NOT IN (SELECT book_id, note_id FROM E)"),
        _f("error", "footnote-anchor-mismatch", "id", "coalesce(anchor_block, '')", "N WHERE (book_id, id) IN (SELECT book_id, note_id FROM E) AND (book_id, id, coalesce(anchor_block, '')) NOT IN (SELECT book_id, note_id, block_id FROM E)"),
        _f("error", "footnote-untranslated", "id", "text", f"N WHERE NOT ({_BLANK.format('text')}) AND {_BLANK.format('target')}"),
    ]),
    "qa_typography": ", Y AS (SELECT *, regexp_replace(target, '`[^`]*`', '', 'g') AS plain FROM T WHERE coalesce(trim(target), '') <> '') " + " UNION ALL ".join(
        _f("warning", code, "id", "''", f"Y WHERE {test}") for code, test in [
            ("arabic-forms", "regexp_matches(plain, '[يكىـ٠-٩]')"),
            ("guillemets", "length(replace(plain, '«', '')) <> length(replace(plain, '»', ''))"),
            ("latin-quotes", "regexp_matches(plain, '[\"“”]')"),
            ("double-punctuation", "regexp_matches(plain, '[،؛؟!]{2,}|،،|\\.{2}$')"),
            ("script-collision", "regexp_matches(plain, '[ء-غف-يٮ-ۓۺ-ۿ][A-Za-z]|[A-Za-z][ء-غف-يٮ-ۓۺ-ۿ]')"),
        ]),
}
ORACLE = {name: SQL.rstrip() + (sql if sql.startswith(",") else "\n" + sql) for name, sql in _SQL.items()}
