"""Queries on states, merging, graphs and grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import state as op
from leafmill.operators.references import reference_key
from leafmill.plans.common import SQL, blocks, notes
from leafmill.plans.glossary import entries
from leafmill.session import read_table


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "reviews").dropDuplicates(["review_key"])


def _links(spark: SparkSession, folder: str) -> DataFrame:
    links = read_table(spark, folder, "links", ["link_key", "book_id", "id", "target"]).dropDuplicates(["link_key"]).where("target is not null")
    end = lambda c: F.concat("book_id", F.lit("/"), reference_key(F.col(c)))
    return links.select(end("id").alias("a"), end("target").alias("b"))


def repair_episodes(spark: SparkSession, folder: str) -> DataFrame:
    r = _reviews(spark, folder)
    reports = r.select(
        F.concat_ws("/", "book_id", reference_key(F.col("id")), "rubric").alias("key"), F.col("seen_at").alias("at"), F.col("review_key").cast("string").alias("event"),
        F.col("book_id").alias("source"), F.sha2(F.coalesce("target", F.lit("")), 256).alias("wording"), F.when(F.col("state") == "closed", "absent").otherwise("report").alias("kind"),
    )
    return op.repair_episodes(reports)


def page_states(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    state = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return op.page_states(e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), state.alias("state"), F.floor(F.col("value") / 50).cast("string").alias("source_hash"), F.lit("t").alias("target_hash")))


def stale_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks whose text differs from their target, as inputs of their book that moved."""
    b = blocks(spark, folder)
    side = lambda c: b.where(F.col(c).isNotNull()).select(F.col("book_id").alias("stage"), F.col("id").alias("key"), F.sha2(c, 256).alias("digest"))
    return op.stale_keys(side("text"), side("target"))


def review_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    r = _reviews(spark, folder)
    verdict = op.review_verdict(F.col("detail").isNotNull(), F.col("rubric") == "note-lost", F.col("target").isNotNull(), F.col("seen_at") >= F.lit("2025-01-01").cast("timestamp_ntz"), F.col("state") == "rejected")
    return r.select("review_key", verdict.alias("verdict"))


def events_once(spark: SparkSession, folder: str) -> DataFrame:
    return op.events_once(read_table(spark, folder, "reviews"), ["review_key"]).select("review_key", "rubric", "state")


def merged_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of reviews as replies; blocks and footnotes are units of their book."""
    units = blocks(spark, folder).select("book_id", "id", "target").unionByName(notes(spark, folder).select("book_id", "id", "target"))
    replies = _reviews(spark, folder).where("target is not null").select("book_id", reference_key(F.col("id")).alias("id"), "target")
    return op.merged_replies(units, replies)


def superseded_replies(spark: SparkSession, folder: str) -> DataFrame:
    e = entries(spark, folder).select(F.concat("book_id", F.lit("/"), "id").alias("id"), "first_form", "later_form", "category")
    return op.superseded_replies(e.select("id", F.col("first_form").alias("token")), e.where("category <> 'person'").select("id", F.coalesce("later_form", "first_form").alias("token")))


def conflicting_edits(spark: SparkSession, folder: str) -> DataFrame:
    return op.conflicting_edits(_reviews(spark, folder).select(F.concat_ws("/", "book_id", reference_key(F.col("id"))).alias("id"), "target"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    return op.components(_links(spark, folder))


def parent_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return op.parent_cycles(_links(spark, folder).select(F.col("a").alias("id"), F.col("b").alias("parent")))


def grid_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a page as cells of a table of four columns."""
    b = blocks(spark, folder).where("page > 0")
    cells = b.select(F.concat("book_id", F.lit("/"), "page").alias("table_id"), F.floor((F.col("pos") % 13) / 4).cast("int").alias("row"), (F.col("pos") % 4).alias("column"), F.when(F.col("type") == "caption", 2).otherwise(1).alias("row_span"), F.when(F.col("type") == "heading", 2).otherwise(1).alias("column_span"))
    sizes = cells.select("table_id").distinct().withColumns({"rows": F.lit(4), "columns": F.lit(4)})
    return op.grid_problems(cells, sizes)


def graded_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Per category, how often later forms are the target, the source, or neither."""
    e = entries(spark, folder).withColumn("key", F.concat("book_id", F.lit("/"), "id"))
    cases = e.select(F.col("key").alias("id"), F.coalesce("category", F.lit("none")).alias("axis"), F.array("target").alias("accepts"), F.array("source").alias("fails"))
    graded = op.graded(cases, e.select(F.col("key").alias("id"), F.col("later_form").alias("answer")))
    return graded.groupBy("axis").pivot("verdict", ["pass", "fail", "unknown"]).count().fillna(0)


def adjudicated(spark: SparkSession, folder: str) -> DataFrame:
    verdict = F.when(F.col("state") == "closed", "accept").when(F.col("state") == "rejected", "reject").otherwise("unknown")
    return op.adjudicated(_reviews(spark, folder).select(F.concat_ws("/", "book_id", reference_key(F.col("id"))).alias("id"), verdict.alias("verdict")))


QUERIES = {
    "repair_episodes": repair_episodes, "page_states": page_states, "stale_keys": stale_keys, "review_verdicts": review_verdicts, "events_once": events_once,
    "merged_replies": merged_replies, "superseded_replies": superseded_replies, "conflicting_edits": conflicting_edits, "components": components,
    "parent_cycles": parent_cycles, "grid_problems": grid_problems, "graded_cases": graded_cases, "adjudicated": adjudicated,
}

_ID = "trim(regexp_replace(lower({0}), '#.*$', ''))"
_V = "WITH V AS (SELECT DISTINCT ON (review_key) * FROM reviews)"
_EDGE = f"V AS (SELECT DISTINCT book_id || '/' || {_ID.format('id')} AS a, book_id || '/' || {_ID.format('target')} AS b FROM links WHERE target IS NOT NULL AND book_id IS NOT NULL AND id IS NOT NULL)"
_ENT = "WITH E AS (SELECT DISTINCT ON (book_id, id) *, book_id || '/' || id AS key FROM glossary WHERE source IS NOT NULL)"
_KEYED = r"trim(regexp_replace(lower(translate({0}, 'يك', 'یک')), '[\p{{P}}\s]+', ' ', 'g'))"
ORACLE = {
    "page_states": "WITH A AS (SELECT user_id AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END AS state, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS h FROM events), M AS (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS moved FROM A WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)), S AS (SELECT *, sum(moved) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM M) SELECT key, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (WHERE state = 'failed') AS attempts FROM S WHERE (key, stretch) IN (SELECT key, max(stretch) FROM S GROUP BY 1) GROUP BY 1",
    "stale_keys": SQL + " SELECT book_id AS stage, string_agg(DISTINCT id, ',' ORDER BY id) AS moved FROM B WHERE text IS DISTINCT FROM target GROUP BY 1",
    "review_verdicts": _V + " SELECT review_key, CASE WHEN detail IS NULL THEN 'not-reviewed' WHEN rubric = 'note-lost' THEN 'recovery' WHEN target IS NULL THEN 'unverified-digest' WHEN seen_at < TIMESTAMP '2025-01-01' THEN 'stale-review' WHEN state = 'rejected' THEN 'rejected' ELSE 'ok' END AS verdict FROM V",
    "events_once": _V + " SELECT review_key, rubric, state FROM V",
    "merged_replies": SQL.rstrip() + f", X AS (SELECT book_id, id, target FROM B UNION ALL SELECT book_id, id, target FROM N), V AS (SELECT DISTINCT book_id, {_ID.format('id')} AS id, target FROM reviews WHERE target IS NOT NULL), A AS (SELECT V.book_id, V.id, max(V.target) AS answer, count(DISTINCT V.target) AS n, bool_or(trim(V.target) = '') AS blank, bool_or(X.id IS NULL) AS f FROM V LEFT JOIN X ON V.book_id = X.book_id AND V.id = X.id GROUP BY 1, 2), Z AS (SELECT book_id, bool_or(n > 1 OR blank OR f) AS refused FROM A GROUP BY 1) SELECT X.book_id, X.id, CASE WHEN NOT coalesce(refused, true) AND answer IS NOT NULL THEN answer ELSE target END AS target, (NOT coalesce(refused, true) AND answer IS NOT NULL) AS merged FROM X LEFT JOIN A ON X.book_id = A.book_id AND X.id = A.id LEFT JOIN Z ON X.book_id = Z.book_id",
    "superseded_replies": _ENT + " SELECT o.key AS id, CASE WHEN n.key IS NULL THEN 'gone' ELSE 'changed' END AS why FROM E o LEFT JOIN (SELECT * FROM E WHERE category <> 'person') n ON o.key = n.key WHERE o.first_form IS DISTINCT FROM CASE WHEN n.key IS NULL THEN NULL ELSE coalesce(n.later_form, n.first_form) END",
    "conflicting_edits": _V + f" SELECT concat_ws('/', book_id, {_ID.format('id')}) AS id, count(DISTINCT target) AS n_wordings FROM V GROUP BY 1 HAVING count(DISTINCT target) > 1",
    "components": f"WITH RECURSIVE {_EDGE}, Y AS (SELECT a, b FROM V UNION SELECT b, a FROM V), C AS (SELECT a AS node, a AS seen FROM Y UNION SELECT C.node, Y.b FROM C JOIN Y ON C.seen = Y.a) SELECT node, min(seen) AS component FROM C GROUP BY 1",
    "parent_cycles": f"WITH RECURSIVE {_EDGE}, Q AS (SELECT a AS id, min(b) AS parent FROM V GROUP BY 1), C AS (SELECT id, parent AS p FROM Q UNION SELECT C.id, Q.parent FROM C JOIN Q ON C.p = Q.id) SELECT DISTINCT id FROM C WHERE id = p",
    "grid_problems": SQL.rstrip() + """, C AS (SELECT book_id || '/' || page AS table_id, CAST(floor((pos % 13) / 4) AS INTEGER) AS r, pos % 4 AS c, CASE type WHEN 'caption' THEN 2 ELSE 1 END AS rs, CASE type WHEN 'heading' THEN 2 ELSE 1 END AS cs FROM B WHERE page > 0),
    X AS (SELECT table_id, at_row, unnest(range(c, c + cs)) AS at_column FROM (SELECT *, unnest(range(r, r + rs)) AS at_row FROM C)), Y AS (SELECT table_id, at_row, at_column, count(*) AS n, lead(at_column) OVER (PARTITION BY table_id, at_row ORDER BY at_column) AS nx FROM X GROUP BY 1, 2, 3)
    SELECT table_id, at_row, at_column, 'overlap' AS problem FROM Y WHERE n > 1 UNION ALL SELECT table_id, at_row, at_column, 'out of bounds' FROM Y WHERE at_row >= 4 OR at_column >= 4 UNION ALL SELECT table_id, at_row, unnest(range(at_column + 1, nx)), 'hole' FROM Y WHERE nx > at_column + 1""",
    "graded_cases": _ENT + f", Z AS (SELECT coalesce(category, 'none') AS axis, CASE WHEN later_form IS NULL THEN 'unknown' WHEN {_KEYED.format('later_form')} = {_KEYED.format('target')} THEN 'pass' WHEN {_KEYED.format('later_form')} = {_KEYED.format('source')} THEN 'fail' ELSE 'unknown' END AS v FROM E) SELECT axis, count(*) FILTER (WHERE v = 'pass') AS pass, count(*) FILTER (WHERE v = 'fail') AS fail, count(*) FILTER (WHERE v = 'unknown') AS unknown FROM Z GROUP BY 1",
    "adjudicated": _V + f" SELECT id, CASE WHEN a AND r THEN 'disputed' WHEN a THEN 'accept' WHEN r THEN 'reject' ELSE 'pending' END AS status FROM (SELECT concat_ws('/', book_id, {_ID.format('id')}) AS id, bool_or(coalesce(state = 'closed', false)) AS a, bool_or(coalesce(state = 'rejected', false)) AS r FROM V GROUP BY 1)",
}
