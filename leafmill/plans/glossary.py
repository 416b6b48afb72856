"""Queries on names and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import glossary as op
from leafmill.plans.common import SQL, blocks, documents
from leafmill.session import read_table

#: A small bank of terms for the query; a user passes their own.
TERMS = ["market day", "harbour record", "lamp", "copper kettle", "See", "ship", "witness"]


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "glossary").where("source is not null").dropDuplicates(["book_id", "id"])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("book_id", F.col("id").alias("unit"), "text")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("doc_id").alias("unit"), "text")


def form_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return op.form_frequencies(_texts(spark, folder), entries(spark, folder))


def form_places(spark: SparkSession, folder: str) -> DataFrame:
    return op.form_places(_texts(spark, folder), op.entry_forms(entries(spark, folder))).select("book_id", "unit", "id", "form").distinct()


def name_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return op.name_candidates(_documents(spark, folder))


def absorbed_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return op.absorbed_aliases(op.name_candidates(_documents(spark, folder)))


def term_hits(spark: SparkSession, folder: str) -> DataFrame:
    return op.term_hits(_documents(spark, folder), spark.createDataFrame([(t,) for t in TERMS], "term string"))


def glossary_drift(spark: SparkSession, folder: str) -> DataFrame:
    return op.drift(blocks(spark, folder), entries(spark, folder))


def first_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return op.first_mentions(blocks(spark, folder), entries(spark, folder))


def first_forms(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select("book_id", "id", op.parenthetical(F.col("first_form")).alias("shown"))


def allocated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids for the aliases of a book as if they were new entries."""
    e = entries(spark, folder)
    fresh = e.select("book_id", F.explode("aliases").alias("name")).distinct()
    return op.allocated_ids(e, fresh)


def alias_maps(spark: SparkSession, folder: str) -> DataFrame:
    mapped = op.alias_maps(entries(spark, folder))
    return mapped.select("book_id", "id", F.explode("aliases").alias("alias", "target"))


def voice_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that name entries by id, by source, and by an alias that no entry has as its source."""
    e = entries(spark, folder)
    cards = e.select("book_id", F.explode(F.concat(F.array("id", "source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    return op.owners_of_voices(cards.withColumn("card", F.col("name")), e)


QUERIES = {
    "form_frequencies": form_frequencies, "form_places": form_places, "name_candidates": name_candidates, "absorbed_aliases": absorbed_aliases, "term_hits": term_hits,
    "glossary_drift": glossary_drift, "first_mentions": first_mentions, "first_forms": first_forms, "allocated_ids": allocated_ids,
    "alias_maps": alias_maps, "voice_owners": voice_owners,
}

_SEP = r"[^\p{L}\p{N}\p{M}\x{200c}\x{200d}_]"
_twice = lambda c: rf"(' ' || regexp_replace({c}, '({_SEP})', '\1\1', 'g') || ' ')"
_pat = lambda c: rf"'{_SEP}' || regexp_replace(trim({_twice(c)}), '([.*+?^$()\[\]{{}}|\\])', '\\\1', 'g') || '{_SEP}'"
_E = SQL.rstrip() + ", E AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, id) AS rn FROM glossary WHERE source IS NOT NULL) WHERE rn = 1)"
_FORMS = _E + ", M AS (SELECT DISTINCT book_id, id, form FROM (SELECT book_id, id, unnest(list_distinct(list_concat([source], coalesce(aliases, [])))) AS form FROM E) WHERE trim(form) <> '')"
_NAME = r"\p{Lu}[\p{L}’''-]+(?: \p{Lu}[\p{L}’''-]+)*"
_CAND = rf"""WITH D AS (SELECT doc_id AS unit, unnest(string_split(regexp_replace(text, '[.!?…]+[”»"'')]*\s+', chr(10), 'g'), chr(10))) AS sentence FROM documents WHERE text IS NOT NULL),
S AS (SELECT unit, regexp_extract_all(sentence, '({_NAME})', 1) AS runs, regexp_extract(sentence, '^[\p{{P}}\s]*({_NAME})', 1) AS opened FROM D),
W AS (SELECT unit, opened, unnest(runs) AS name, generate_subscripts(runs, 1) AS k FROM S),
C AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE NOT (k = 1 AND opened = name)) AS n_inside, min(unit) AS first_unit FROM W GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE NOT (k = 1 AND opened = name)) >= greatest(1, count(*) // 4))
"""
_TERM = " UNION ALL ".join(
    "SELECT doc_id AS unit, '{0}' AS term FROM documents WHERE regexp_matches(text, '{1}')".format(t, rf"\b{t}\b" if t.split()[-1].isupper() or len(t.split()[-1]) <= 2 else rf"(?i)\b{t}(?:es|s|ed|ing|d)?\b") for t in TERMS
)
ORACLE = {
    "form_frequencies": _FORMS + f" SELECT E.book_id, E.id, coalesce(CAST(x.n AS BIGINT), 0) AS n FROM E LEFT JOIN (SELECT M.book_id, M.id, sum(len(regexp_extract_all({_twice('B.text')}, {_pat('M.form')}))) AS n FROM M JOIN B ON M.book_id = B.book_id AND contains(B.text, M.form) GROUP BY 1, 2) x ON E.book_id = x.book_id AND E.id = x.id",
    "form_places": _FORMS + f" SELECT DISTINCT M.book_id, B.id AS unit, M.id, M.form FROM M JOIN B ON M.book_id = B.book_id AND contains(B.text, M.form) WHERE regexp_matches({_twice('B.text')}, {_pat('M.form')})",
    "name_candidates": _CAND + "SELECT * FROM C",
    "absorbed_aliases": _CAND + "SELECT alias, name FROM (SELECT s.name AS alias, l.name, row_number() OVER (PARTITION BY s.name ORDER BY length(l.name) DESC, l.name) AS place FROM C s JOIN C l ON NOT contains(s.name, ' ') AND list_contains(string_split(l.name, ' '), s.name) AND contains(l.name, ' ')) WHERE place = 1",
    "term_hits": _TERM,
    "glossary_drift": _FORMS + f" SELECT DISTINCT M.book_id, B.id AS unit, M.id, M.form FROM M JOIN B ON M.book_id = B.book_id AND contains(B.text, M.form) JOIN E ON E.book_id = M.book_id AND E.id = M.id WHERE B.target <> '' AND E.target <> '' AND NOT contains(B.target, E.target) AND regexp_matches({_twice('B.text')}, {_pat('M.form')})",
    "first_mentions": _E + f" SELECT book_id, id, unit AS owner FROM (SELECT E.book_id, E.id, B.id AS unit, row_number() OVER (PARTITION BY E.book_id, E.id ORDER BY (B.id <> coalesce(E.first_block_id, '')), B.pos) AS place FROM E JOIN B ON E.book_id = B.book_id AND contains(B.target, E.target) WHERE E.target <> '' AND B.target <> '' AND regexp_matches({_twice('B.target')}, {_pat('E.target')})) WHERE place = 1",
    "first_forms": _E + r" SELECT book_id, id, nullif(regexp_extract(first_form, '\(([^()]{2,})\)', 1), '') AS shown FROM E",
    "allocated_ids": _E + " SELECT book_id, name, 'g' || lpad(CAST(top + row_number() OVER (PARTITION BY book_id ORDER BY name) AS VARCHAR), 4, '0') AS id FROM (SELECT DISTINCT book_id, unnest(aliases) AS name FROM E) JOIN (SELECT book_id, max(CAST(regexp_extract(id, '([0-9]+)$', 1) AS INTEGER)) AS top FROM E GROUP BY 1) USING (book_id)",
    "alias_maps": _E + " SELECT DISTINCT book_id, id, unnest(aliases) AS alias, target FROM E",
    "voice_owners": _E + ", C AS (SELECT DISTINCT book_id, unnest(list_concat([id, source], coalesce(aliases, []))) AS card FROM E) SELECT C.book_id, C.card, min_by(E.id, CASE WHEN C.card = E.id THEN '0' ELSE '1' END || E.id) AS entry_id, count(E.id) AS n_matches FROM C LEFT JOIN E ON C.book_id = E.book_id AND (C.card = E.id OR C.card = E.source) GROUP BY 1, 2",
}
