"""Queries of digests, anchors, worksheets and the smaller rules. Where no table fits a rule, its inputs are made up from others, as said beside the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import anchors, digests, gates, glossary, jobs, layout, worksheets
from leafmill.operators.blocks import is_text, published_units, unit_kind
from leafmill.plans.common import SQL, blocks, books, documents, notes
from leafmill.plans.glossary import entries
from leafmill.session import read_table

BUDGET = 1400


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return published_units(books(spark, folder), blocks(spark, folder), notes(spark, folder))


def bilingual_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests.bilingual_digests(_units(spark, folder))


def target_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests.target_digests(_units(spark, folder))


def _sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Units of sheets of 20 blocks (no chunks, so that SQL can follow)."""
    b = blocks(spark, folder).where(is_text(F.col("type")))
    placed = jobs.batches(b, ["pos"])
    return placed.select("book_id", F.col("sheet").alias("chunk_no"), "pos", "id", unit_kind(F.col("type"), F.col("level")).alias("kind"), "text", "target")


def unit_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests.unit_digests(_sheets(spark, folder))


def request_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets as review requests of one stage, with their number as revision."""
    units = _sheets(spark, folder).withColumn("sheet", F.concat("book_id", F.lit("/"), "chunk_no")).withColumnRenamed("text", "source")
    sheets = units.select("sheet", F.lit("meaning").alias("stage"), F.col("chunk_no").cast("string").alias("revision")).distinct()
    return digests.request_digests(sheets, units, "p1")


def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests.page_digests(blocks(spark, folder))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "ocr_pages", ["page_key", "book_id", "page", "text", "confidence", "grade"]).dropDuplicates(["page_key"])


def evidence_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised pages as evidence files of their book; those without a confidence are not there."""
    files = _pages(spark, folder).where("book_id is not null").select(F.col("book_id").alias("subject"), F.col("page_key").alias("pos"), F.concat(F.lit("p"), F.col("page").cast("string")).alias("name"), F.when(F.col("confidence").isNotNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"))
    return digests.evidence_digests(files)


def page_source_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised pages with the hash of their text for that of their bytes, and one size."""
    p = _pages(spark, folder).select("page_key", "book_id", "page", F.col("text").alias("prose"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit(420).alias("width"), F.lit(595).alias("height"))
    return digests.page_source_digests(p)


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of blocks as fragments, books as documents."""
    return blocks(spark, folder).where("id is not null and id <> ''").select(F.concat(F.lit("t/"), "book_id", F.lit(".xhtml")).alias("document"), F.col("id").alias("fragment")).distinct()


def named_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.named_anchors(_anchors(spark, folder))


def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of links as fragments of their own book's document, some by way of another folder."""
    rows = read_table(spark, folder, "links", ["link_key", "book_id", "target", "href"]).dropDuplicates(["link_key"])
    path = F.when(F.col("link_key") % 3 == 0, F.concat(F.lit("../t/"), "book_id", F.lit(".xhtml"))).when(F.col("link_key") % 3 == 1, F.concat(F.lit("./"), "book_id", F.lit(".xhtml"))).otherwise("")
    href = F.when(F.col("target").isNull(), F.col("href")).otherwise(F.concat(path, F.lit("#"), "target"))
    given = rows.select("link_key", F.concat(F.lit("t/"), "book_id", F.lit(".xhtml")).alias("document"), href.alias("href"))
    return anchors.resolved_links(given, _anchors(spark, folder)).select("link_key", "name", "resolved")


def settled_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of blocks, and their first two characters and last digit, as names; targets of links, shortened likewise, are wanted."""
    short = lambda c: F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(2)))
    held = blocks(spark, folder).where("id <> ''").select("book_id", "pos", "id", F.explode(F.array(F.col("id"), short(F.col("id")))).alias("name"))
    wanted = read_table(spark, folder, "links", ["book_id", "target"]).where("target is not null").select("book_id", F.explode(F.array(F.col("target"), short(F.col("target")))).alias("name"))
    return anchors.settled_anchors(held, wanted)


def section_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of books with one of three sizes by their number, against three declared sections."""
    pages = blocks(spark, folder).where("page > 0").select(F.col("book_id").alias("document"), "page").distinct()
    size = F.when(F.col("page") % 7 < 4, 400).when(F.col("page") % 7 < 6, 500).otherwise(600)
    views = pages.select("document", "page", size.alias("width"), F.lit(600).alias("height"))
    declared = pages.select("document").distinct().select("document", F.explode(F.array(*[F.struct(F.lit(n).alias("no"), F.lit(w).alias("width"), F.lit(600).alias("height")) for n, w in ((1, 400), (2, 500), (3, 600))])).alias("d")).select("document", "d.*")
    return anchors.section_order(views, declared)


def part_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.part_neighbours(_units(spark, folder))


def cut_separators(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut before every fifth line and in the middle of a text."""
    d = documents(spark, folder).select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    parts = jobs.unit_offsets(d.select(F.col("doc_id").alias("owner"), "seq", F.col("line").alias("text")))
    offsets = parts.where("seq % 5 = 0").select("owner", "seq", (F.col("offset") + F.col("seq")).cast("int").alias("offset"))
    cuts = offsets.join(documents(spark, folder).select(F.col("doc_id").alias("owner"), "text"), "owner")
    return anchors.separators(cuts.select("owner", F.col("seq").alias("id"), "offset", "text")).select("owner", "id", F.length("gap").alias("n"))


def worksheet_texts(spark: SparkSession, folder: str) -> DataFrame:
    return worksheets.worksheets(_sheets(spark, folder)).select("book_id", "chunk_no", "n_units", "n_chars", F.sha2("sheet", 256).alias("sha256"))


def rendered_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered length of each unit, by which sheets are to be packed."""
    u = _sheets(spark, folder)
    return u.select("book_id", "id", "pos", worksheets.rendered_size(F.col("id"), F.col("kind"), F.col("text")).alias("size"))


def term_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Entries on the sheet of their first block."""
    e = entries(spark, folder)
    present = e.select("book_id", "id", F.col("first_block_id").alias("block")).join(_sheets(spark, folder).select("book_id", F.col("id").alias("block"), "chunk_no"), ["book_id", "block"])
    return worksheets.term_tables(e, present.select("book_id", "chunk_no", "id"))


def voice_cards(spark: SparkSession, folder: str) -> DataFrame:
    """People of the glossary, with their category as register and their later form as note."""
    e = entries(spark, folder)
    return worksheets.voice_cards(e.select("book_id", "id", F.col("source").alias("name"), F.col("category").alias("register"), F.col("later_form").alias("note")))


def logged_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as log events; values stand for counts."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "click", "stage").otherwise("other")
    given = e.select("event_id", F.col("ts").alias("at"), kind.alias("kind"), F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("cause"), (F.floor("value") - 20).cast("long").alias("blocks"), F.lit("text").alias("manuscript"))
    return worksheets.log_events(given).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("blocks").alias("n_counts"))


def strict_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Times of reviews as stamps, some in other forms."""
    r = read_table(spark, folder, "reviews", ["review_key", "seen_at"]).dropDuplicates(["review_key"])
    form = F.when(F.col("review_key") % 4 == 0, F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss")).when(F.col("review_key") % 4 == 1, F.date_format("seen_at", "yyyy-13-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return r.select("review_key", worksheets.strict_stamp(form).isNotNull().alias("valid"))


def fluency_states(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews as passes over a unit's wording: targets are edits, closed ones applied, rejected ones refused; the last is asked to apply."""
    r = read_table(spark, folder, "reviews", ["review_key", "book_id", "target", "state"]).dropDuplicates(["review_key"])
    per = r.groupBy("book_id").agg(F.count("target").alias("edits"), F.max(F.coalesce(F.col("state") == "closed", F.lit(False))).alias("applied"), F.min(F.coalesce(F.col("state") == "rejected", F.lit(False))).alias("refused"), (F.max("review_key") % 2 == 0).alias("current"))
    per = per.withColumn("state", worksheets.fluency_state(F.col("edits"), F.col("applied"), F.col("refused")))
    return per.select("book_id", "state", worksheets.fluency_refusal(F.col("state"), F.lit("apply"), F.col("current")).alias("apply_refused"), worksheets.fluency_refusal(F.col("state"), F.lit("verdict"), F.col("current")).alias("verdict_refused"))


def asset_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Images as pictures named after their id; those on odd places are there, some with another hash."""
    images = blocks(spark, folder).where("type = 'image'").select("book_id", "id", "pos", F.concat("book_id", F.lit("/"), "id").alias("asset"))
    held = images.where("pos % 2 = 1").select(F.col("asset").alias("path"), F.sha2(F.concat("asset", (F.col("pos") % 3 == 0).cast("string")), 256).alias("sha256"))
    return gates.asset_gate(images.select("book_id", "id", "asset", F.sha2(F.concat("asset", F.lit("false")), 256).alias("sha256")), held)


def geometry_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Books with sizes made up from their number of blocks."""
    n = blocks(spark, folder).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    variant = lambda w, k: F.struct(F.lit(w).alias("width"), F.lit(600.0).alias("height"), k.alias("n"))
    given = n.select("book_id", (F.col("n") % 2 == 0).alias("recovered"), F.lit(None).cast("string").alias("reason"), F.lit(420.0).alias("width"), F.lit(600.0).alias("height"),
                     F.when(F.col("n") % 3 > 0, F.array(variant(420.0, F.col("n")), variant(500.4, F.col("n") % 3))).otherwise(F.array(variant(420.0, F.col("n")))).alias("variants"),
                     F.when(F.col("n") % 3 == 1, F.array(F.lit(3), F.lit(7))).otherwise(F.array().cast("array<int>")).alias("rotated"))
    return gates.geometry_gate(given)


FONTS = ["Garamond-BoldItalic", "GlyphLessFont", "Arial-Black", "Times", "Courier-Oblique"]


def span_styles(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks as spans with flags and fonts made up from their place."""
    font = F.element_at(F.array(*map(F.lit, FONTS)), (F.col("pos") % 5 + 1).cast("int"))
    style = layout.span_style((F.col("pos") % 32).cast("int"), font, F.col("pos") % 11 == 0)
    return blocks(spark, folder).select("block_key", style.alias("s")).select("block_key", "s.*")


def body_rects(spark: SparkSession, folder: str) -> DataFrame:
    """Body areas of books with margins made up from their number of blocks."""
    n = blocks(spark, folder).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    r = layout.body_rect(F.lit(420), F.lit(600), F.col("n") % 40, F.lit(30), F.when(F.col("n") % 2 == 0, 25), F.lit(40))
    return n.select("book_id", r.alias("r")).select("book_id", "r.*")


def coloured_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Code points of recognised pages as saturations."""
    p = _pages(spark, folder).where("text <> ''").select("page_key", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return layout.coloured_share(p.groupBy("page_key", (F.ascii("c") % 40).alias("saturation")).agg(F.count(F.lit(1)).alias("n")))


BANK = [("idioms", 1, "market day", "روز بازار", "a"), ("idioms", 2, "lamp", "چراغ / فانوس", None), ("idioms", 3, "lamp", "لامپ", "later"), ("terms", 1, "ship", "کشتی", None), ("terms", 2, "witness", "شاهد", None)]


def term_briefs(spark: SparkSession, folder: str) -> DataFrame:
    bank = spark.createDataFrame(BANK, "bank string, seq int, en string, fa string, note string")
    return glossary.term_briefs(documents(spark, folder).select(F.col("doc_id").alias("unit"), "text").distinct(), bank)


def persian_hits(spark: SparkSession, folder: str) -> DataFrame:
    bank = spark.createDataFrame(BANK, "bank string, seq int, en string, fa string, note string")
    return glossary.persian_hits(blocks(spark, folder).select(F.col("block_key").alias("unit"), F.col("target").alias("text")), bank)


def trimmed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the glossary with words around them that do not belong to a name."""
    e = entries(spark, folder)
    return e.select("book_id", "id", glossary.trimmed_name(F.concat(F.lit("Then the "), "source", F.lit("'s"))).alias("name"))


def name_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by the text of their first block."""
    e = entries(spark, folder).select("book_id", F.col("id").alias("entry"), "source", F.col("first_block_id").alias("id"))
    j = e.join(blocks(spark, folder).where("text is not null").groupBy("book_id", "id").agg(F.max("text").alias("text")), ["book_id", "id"])
    return j.select("book_id", "entry", glossary.name_category(F.col("source"), F.array("text")).alias("category"))


QUERIES = {q.__name__: q for q in (
    bilingual_digests, target_digests, unit_digests, request_digests, page_digests, evidence_digests, page_source_digests, named_anchors, resolved_links, settled_anchors, section_walk, part_neighbours,
    cut_separators, worksheet_texts, rendered_packing, term_tables, voice_cards, logged_events, strict_stamps, fluency_states, asset_findings, geometry_findings, span_styles, body_rects, coloured_pages,
    term_briefs, persian_hits, trimmed_names, name_categories,
)}


def _hash(*columns: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}, '-')" for c in columns) + "))"


def _ordered(rows: str, by: str, part: str, pos: str, columns: list[str], tag: str) -> str:
    """The SQL of `digests.ordered_digests`."""
    return (
        f"SELECT k, '{tag}:' || sha256(string_agg(d, chr(10) ORDER BY part_, range_)) AS digest FROM (SELECT k, part_, range_, sha256(string_agg(d, chr(10) ORDER BY pos_, also_)) AS d FROM "
        f"(SELECT {by} AS k, {part} AS part_, {pos} AS pos_, id AS also_, floor({pos} / 1024) AS range_, {_hash(*columns)} AS d FROM {rows}) GROUP BY 1, 2, 3) GROUP BY 1"
    )


_KIND = "CASE type WHEN 'heading' THEN 'heading' || coalesce(level, 1) WHEN 'paragraph' THEN 'para' WHEN 'blockquote' THEN 'quote' WHEN 'listitem' THEN 'list' ELSE type END"
_SHEET = f", S AS (SELECT book_id, CAST(floor((row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) / 20) AS INTEGER) AS chunk_no, pos, id, {_KIND} AS kind, text, target FROM T)"
_UNIT = r"'@@ ' || id || ' <' || kind || '>' || chr(10) || regexp_replace(coalesce(text, ''), '(^|\n)(\\*)(@@ |`{3}|~{3}|<!--)', '\1\\\2\3', 'g') || chr(10)"
_PAGES = "SELECT DISTINCT page_key, book_id, page, text, confidence, grade FROM ocr_pages"
_A = ", A AS (SELECT DISTINCT 't/' || book_id || '.xhtml' AS document, id AS fragment FROM B WHERE id <> '')"
_NAMED = _A + ", M AS (SELECT document, fragment, CASE WHEN count(*) OVER (PARTITION BY fragment) > 1 THEN 'epub-' || left(sha256(document), 12) || '-' || fragment ELSE fragment END AS name FROM A)"
_NAMED_ALL = "(SELECT document, fragment, CASE WHEN name <> fragment AND name IN (SELECT fragment FROM A) THEN name || '-2' ELSE name END AS name FROM M)"
_E = ", E AS (SELECT DISTINCT book_id, id, source, target, later_form, category, first_block_id FROM glossary WHERE source IS NOT NULL)"
_STAMP = "CASE review_key % 4 WHEN 0 THEN strftime(seen_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(seen_at, '%Y-13-%dT%H:%M:%SZ') ELSE strftime(seen_at, '%Y-%m-%dT%H:%M:%SZ') END"
_find = lambda severity, code, unit, detail, rows: f"SELECT '{severity}' AS severity, '{code}' AS code, book_id, {unit} AS unit, substr({detail}, 1, 200) AS detail FROM {rows}"
_ORDINARY = "|".join(sorted(glossary.STOPWORDS, key=lambda w: (-len(w), w)))
_SQL = {
    "bilingual_digests": " SELECT k AS book_id, digest FROM (" + _ordered("P", "book_id", "part_no", "pos", ["id", "part", "kind", "source", "target"], "meaning4") + ")",
    "target_digests": " SELECT k AS book_id, digest FROM (" + _ordered("(SELECT * FROM P WHERE NOT (part = 'note' AND coalesce(trim(target), '') = ''))", "book_id", "part_no", "pos", ["id", "part", "kind", "target"], "fluency4") + ")",
    "unit_digests": _SHEET + " SELECT k.book_id, k.chunk_no, digest FROM (" + _ordered("S", "{'book_id': book_id, 'chunk_no': chunk_no}", "chunk_no", "pos", ["id", "kind", "text"], "units5") + ")",
    "request_digests": _SHEET + ", D AS (" + _ordered("S", "book_id || '/' || chunk_no", "0", "pos", ["id", "text", "target"], "u") + "), H AS (SELECT DISTINCT book_id || '/' || chunk_no AS sheet, CAST(chunk_no AS VARCHAR) AS revision FROM S) SELECT sheet, 'rev1:' || " + _hash("'meaning'", "sheet", "revision", "'p1'", "digest") + " AS digest FROM H LEFT JOIN D ON k = sheet",
    "page_digests": ", X AS (" + _ordered("(SELECT * FROM B WHERE page > 0)", "{'book_id': book_id, 'page': page}", "0", "pos", ["id", "type", "CAST(level AS VARCHAR)", "text"], "page-request2") + "), Y AS (" + _ordered("(SELECT * FROM B WHERE page > 0)", "{'book_id': book_id, 'page': page}", "0", "pos", ["id", "target"], "page5") + ") SELECT X.k.book_id AS book_id, X.k.page AS page, X.digest AS request, Y.digest AS translation FROM X JOIN Y ON X.k = Y.k",
    "named_anchors": _NAMED + f" SELECT document, fragment, name FROM {_NAMED_ALL}",
    "resolved_links": _NAMED + f", V AS (SELECT DISTINCT link_key, book_id, target, href FROM links), G AS (SELECT link_key, 't/' || book_id || '.xhtml' AS document, target FROM V WHERE target IS NOT NULL AND target <> '') SELECT G.link_key, N2.name, N2.name IS NOT NULL AS resolved FROM G LEFT JOIN {_NAMED_ALL} N2 ON G.document = N2.document AND G.target = N2.fragment",
    "settled_anchors": ", H AS (SELECT book_id, pos, id, unnest([id, left(id, 1) || right(id, 2)]) AS name FROM B WHERE id <> ''), W AS (SELECT DISTINCT book_id, unnest([target, left(target, 1) || right(target, 2)]) AS name FROM links WHERE target IS NOT NULL) SELECT book_id, arg_min(pos, (pos, id)) AS pos, arg_min(id, (pos, id)) AS id, name FROM H JOIN W USING (book_id, name) GROUP BY book_id, name",
    "section_walk": ", G AS (SELECT DISTINCT book_id AS document, page, CASE WHEN page % 7 < 4 THEN 1 WHEN page % 7 < 6 THEN 2 ELSE 3 END AS s FROM B WHERE page > 0), L AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY document ORDER BY page), 1) AS reached FROM G) SELECT document, page, s AS back_to, reached FROM L WHERE s < reached",
    "part_neighbours": " SELECT book_id, part, id, CASE WHEN lag(part) OVER w = part THEN coalesce(lag(target) OVER w, '') ELSE '' END AS before, CASE WHEN lead(part) OVER w = part THEN coalesce(lead(target) OVER w, '') ELSE '' END AS after FROM P WINDOW w AS (PARTITION BY book_id ORDER BY part_no, pos, id)",
    "worksheet_texts": _SHEET + f" SELECT book_id, chunk_no, count(*) AS n_units, sum(length(coalesce(text, ''))) AS n_chars, sha256('<!-- worksheet ' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') || ' | units ' || count(*) || ' | ' || CAST(sum(length(coalesce(text, ''))) AS VARCHAR) || ' source chars -->' || chr(10) || string_agg({_UNIT}, chr(10) ORDER BY pos)) AS sha256 FROM S GROUP BY 1, 2",
    "rendered_packing": _SHEET + f" SELECT book_id, id, pos, length({_UNIT}) + 1 AS size FROM S",
    "term_tables": _SHEET + _E + " SELECT E.book_id, chunk_no, count(*) AS n_terms, string_agg(E.source || ' | ' || E.target || ' | ' || coalesce(category, '-'), chr(10) ORDER BY E.source, E.id) AS \"table\" FROM (SELECT DISTINCT E.*, S.chunk_no FROM E JOIN S ON E.book_id = S.book_id AND E.first_block_id = S.id) E WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2",
    "voice_cards": _E + " SELECT book_id, id, concat_ws(chr(10), CASE WHEN trim(source) <> '' THEN 'name: ' || trim(source) END, CASE WHEN trim(category) <> '' THEN 'register: ' || trim(category) END, CASE WHEN trim(later_form) <> '' THEN 'note: ' || trim(later_form) END) AS card FROM E",
    "asset_findings": ", G AS (SELECT book_id, id, pos, book_id || '/' || id AS asset FROM B WHERE type = 'image') " + " UNION ALL ".join([
        _find("error", "asset-missing", "id", "asset", "G WHERE asset NOT IN (SELECT asset FROM G WHERE pos % 2 = 1)"),
        _find("error", "asset-modified", "id", "asset || ' no longer matches its extraction hash'", "G WHERE pos % 2 = 1 AND pos % 3 = 0"),
    ]),
    "geometry_findings": ", G AS (SELECT book_id, count(*) AS n FROM B GROUP BY 1) " + " UNION ALL ".join([
        _find("warning", "emphasis-unrecoverable", "'source'", "'the source''s emphasis could not be read'", "G WHERE n % 2 = 1"),
        _find("warning", "page-geometry-mixed", "'source'", "'several sizes: 420x600pt on ' || n || ' page(s), 500x600pt on ' || (n % 3) || ' page(s); built at 420x600pt'", "G WHERE n % 3 > 0"),
        _find("warning", "page-rotated", "'source'", "'3,7'", "G WHERE n % 3 = 1"),
    ]),
    "span_styles": " SELECT block_key, pos % 11 <> 0 AND pos % 5 <> 1 AND (CAST(pos % 32 AS INTEGER) & 16 <> 0 OR pos % 5 IN (0, 2)) AS bold, pos % 11 <> 0 AND pos % 5 <> 1 AND (CAST(pos % 32 AS INTEGER) & 2 <> 0 OR pos % 5 IN (0, 4)) AS italic FROM B",
    "body_rects": " SELECT book_id, CAST(count(*) % 40 AS DOUBLE) AS \"left\", CAST(30 AS DOUBLE) AS top, CAST(CASE WHEN count(*) % 2 = 0 THEN 395 ELSE 420 END AS DOUBLE) AS \"right\", CAST(560 AS DOUBLE) AS bottom FROM B GROUP BY 1",
    "persian_hits": " SELECT block_key AS unit, en FROM B, (VALUES ('market day', 'روز بازار'), ('lamp', 'چراغ'), ('lamp', 'لامپ'), ('ship', 'کشتی'), ('witness', 'شاهد')) AS K(en, form) WHERE contains(target, form) GROUP BY 1, 2",
    "trimmed_names": _E + rf" SELECT book_id, id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace('Then the ' || source || '''s', '\s+', ' ', 'g')), '(''s|’s)$', ''), '^((({_ORDINARY})( |$))+)', '', 'i'), '(((^| )({_ORDINARY}))+)$', '', 'i')) AS name FROM E",
}
ORACLE = {name: SQL.rstrip() + sql for name, sql in _SQL.items()}
ORACLE |= {
    "evidence_digests": f"WITH G AS ({_PAGES}) SELECT book_id AS subject, sha256(string_agg(coalesce('p' || page, '') || ':' || CASE WHEN confidence IS NULL THEN 'absent' ELSE sha256(coalesce(text, '')) END, chr(10) ORDER BY page_key)) AS digest FROM G WHERE book_id IS NOT NULL GROUP BY 1",
    "page_source_digests": f"WITH G AS ({_PAGES}) SELECT book_id, page, 'page-source:' || {_hash('text', 'h', '420', '595')} AS digest FROM (SELECT *, sha256(coalesce(text, '')) AS h FROM G)",
    "cut_separators": "WITH D AS (SELECT doc_id AS owner, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), L AS (SELECT owner, text, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS seq, row_number() OVER () AS n FROM D), O AS (SELECT owner, text, seq, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM L) "
        r"SELECT owner, seq AS id, length(regexp_extract(substr(text, 1, o), '([\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]*)$', 1) || regexp_extract(substr(text, o + 1), '^([\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]*)', 1)) AS n FROM O WHERE o > 0 AND seq % 5 = 0",
    "logged_events": "SELECT CASE event_type WHEN 'error' THEN 'refused' ELSE 'stage' END AS kind, count(*) AS n, count(*) FILTER (WHERE floor(value) - 20 BETWEEN 0 AND 1000000) AS n_counts FROM events WHERE event_type IN ('error', 'click') GROUP BY 1",
    "strict_stamps": "SELECT review_key, review_key % 4 >= 2 AND seen_at IS NOT NULL AS valid FROM (SELECT DISTINCT review_key, seen_at FROM reviews)",
    "fluency_states": "WITH V AS (SELECT DISTINCT review_key, book_id, target, state FROM reviews), G AS (SELECT book_id, count(target) AS edits, bool_or(coalesce(state = 'closed', false)) AS applied, bool_and(coalesce(state = 'rejected', false)) AS refused, max(review_key) % 2 = 0 AS current FROM V GROUP BY 1), H AS (SELECT *, CASE WHEN refused THEN 'refused' WHEN edits > 0 AND NOT applied THEN 'proposed' WHEN edits > 0 THEN 'applied' ELSE 'approved-no-change' END AS st FROM G) "
        "SELECT book_id, st AS state, CASE WHEN st = 'refused' THEN 'refused' WHEN st = 'applied' THEN 'already-applied' WHEN NOT current THEN 'stale-edits' END AS apply_refused, CASE WHEN st = 'refused' THEN 'refused' WHEN st = 'proposed' THEN 'edits-unapplied' END AS verdict_refused FROM H",
    "term_briefs": "WITH K(bank, en, fa, note, p) AS (VALUES ('idioms', 'market day', 'روز بازار', 'a', '(?i)\\bmarket day(?:es|s|ed|ing|d)?\\b'), ('idioms', 'lamp', 'چراغ / فانوس', NULL, '(?i)\\blamp(?:es|s|ed|ing|d)?\\b'), ('terms', 'ship', 'کشتی', NULL, '(?i)\\bship(?:es|s|ed|ing|d)?\\b'), ('terms', 'witness', 'شاهد', NULL, '(?i)\\bwitness(?:es|s|ed|ing|d)?\\b')) SELECT DISTINCT doc_id AS unit, bank, en, fa, note FROM documents, K WHERE regexp_matches(text, p)",
}
