"""What recognition of scanned pages leaves to check: states of pages, agreement with blocks, lines put together."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leafmill.operators.gates import all_findings, finding
from leafmill.operators.layout import grade
from leafmill.session import checkpoint, small_or_shuffled

#: Notes of a page's state and words of a note; agreement from which a recognised block is taken.
NOTES, NOTE_WORDS, AGREEMENT = 8, 6, 0.6
ARTWORK = 0.06


def page_state(words: DataFrame) -> DataFrame:
    """(page_key, n_high, n_medium, n_low, n_unknown, least, notes, n_more): words (page_key, line_no, word_no, text, conf) by grade.

    Notes are the poor words of a line, at most eight lines of six words; n_more
    counts the other lines with poor words. The caps belong to the report.
    """
    graded = words.withColumn("grade", grade(F.col("conf")))
    counts = graded.groupBy("page_key").agg(
        *[F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in ("high", "medium", "low", "unknown")], F.min("conf").alias("least")
    )
    poor = graded.where("grade = 'low'").groupBy("page_key", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("ws"))
    note = F.array_join(F.slice(F.transform("ws", lambda w: w["text"]), 1, NOTE_WORDS), " ")
    placed = poor.withColumn("place", F.row_number().over(Window.partitionBy("page_key").orderBy("line_no")))
    kept = placed.groupBy("page_key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= NOTES, F.struct("line_no", note.alias("note"))))), lambda x: x["note"]).alias("notes"),
        F.count_if(F.col("place") > NOTES).alias("n_more"),
    )
    joined = counts.join(kept, "page_key", "left")
    return joined.withColumn("notes", F.coalesce("notes", F.array().cast("array<string>"))).withColumn("n_more", F.coalesce("n_more", F.lit(0)))


def agreement(a: str | None, b: str | None) -> float:
    """Share of letters and digits that two texts have in common, in order."""
    bare = [re.sub(r"[^0-9a-z؀-ۿ]", "", (x or "").lower()) for x in (a, b)]
    return difflib.SequenceMatcher(None, *bare).ratio() if all(bare) else 0.0


@F.pandas_udf(DoubleType())
def text_agreement(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([agreement(a, b) for a, b in zip(left, right, strict=True)])


def recognition_gate(blocks: DataFrame) -> DataFrame:
    """Findings for blocks (book_id, id, text, seen, conf) that recognition disputes or reads with low confidence."""
    judged = blocks.where("seen is not null").withColumn("share", text_agreement("text", "seen"))
    disputed = judged.where(F.col("share") < AGREEMENT)
    low = judged.where((F.col("share") >= AGREEMENT) & (grade(F.col("conf")) == "low"))
    return all_findings(
        finding(disputed, "error", "ocr-disputed-text", F.col("id"), F.col("seen")),
        finding(low, "warning", "ocr-low-confidence", F.col("id"), F.col("conf").cast("string")),
        finding(blocks.where("seen is null"), "warning", "ocr-coverage-unverified", F.col("id"), F.lit("")),
    )


def joined_lines(lines: Column) -> Column:
    """An array of lines as one text: a single hyphen at a line end goes with the break, else a space stands for it."""
    step = lambda acc, line: F.when(acc == "", F.trim(line)).when(acc.rlike(r"[^-]-$"), F.concat(F.regexp_replace(acc, "-$", ""), F.trim(line))).otherwise(F.concat_ws(" ", acc, F.trim(line)))
    return F.aggregate(lines, F.lit(""), step)


def line_groups(sizes: list[float], scanned: bool = False) -> list[int]:
    """The group of each line in order: a line joins while its size is near the greatest of the group so far (6 %, 28 % on scans)."""
    tolerance, groups, top = 0.28 if scanned else 0.06, [], 0.0
    for size in sizes:
        near = groups and abs(size - top) <= tolerance * max(top, size)
        groups.append(groups[-1] if near else (groups[-1] + 1 if groups else 0))
        top = max(top, size) if near else size
    return groups


def grouped_lines(lines: DataFrame, scanned: bool = False) -> DataFrame:
    """(page_key, line_no, group_no) of lines (page_key, line_no, size); the running maximum makes it a fold over a page's lines."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        return rows[["page_key", "line_no"]].assign(group_no=line_groups(rows["size"].tolist(), scanned))

    kinds = dict(lines.dtypes)
    return lines.groupBy("page_key").applyInPandas(fold, f"page_key {kinds['page_key']}, line_no {kinds['line_no']}, group_no int")


def running_pieces(runs: DataFrame) -> DataFrame:
    """(para, piece_no, kind, text) of runs (para, pos, kind, text): fields by depth, only the outermost instruction kept.

    Kinds are begin, instruction, separate, end, tab and text. Text inside a field
    is a cached result and is dropped; tabs and fields keep their place in prose.
    """
    order = Window.partitionBy("para").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)).over(order)
    marked = runs.withColumn("depth", depth)
    kept = marked.where(((F.col("depth") == 0) & F.col("kind").isin("text", "tab")) | ((F.col("depth") == 1) & (F.col("kind") == "instruction")))
    step = Window.partitionBy("para").orderBy("pos")
    opens = (F.col("kind") != "text") | (F.coalesce(F.lag("kind").over(step), F.lit("")) != "text")
    islands = kept.withColumn("opens", opens.cast("int")).withColumn("piece_no", F.sum("opens").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    kind = F.min(F.when(F.col("kind") == "instruction", "field").otherwise(F.col("kind")))
    return islands.groupBy("para", "piece_no").agg(kind.alias("kind"), text.alias("text"))


def scan_verdicts(pages: DataFrame) -> DataFrame:
    """(verdict, n) of measured scans (rasters, coloured): what cleaning would do with each page."""
    verdict = F.when(F.col("rasters") != 1, "not-single-raster").when(F.col("coloured") > ARTWORK, "artwork").when(F.col("coloured") == 0, "no-colour").otherwise("would-clean")
    return pages.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def output_problems(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page, problem): pages of a recognised file against its source: missing, foreign, text changed, geometry moved, draws changed.

    Both have page, role, text, width, height, draws. Text pages keep their text
    (white space aside); sizes may differ by half a point.
    """
    s, o = source.alias("s"), output.alias("o")
    j = s.join(o, F.col("s.page") == F.col("o.page"), "full")
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    moved = (F.abs(F.col("s.width") - F.col("o.width")) > 0.5) | (F.abs(F.col("s.height") - F.col("o.height")) > 0.5)
    checks = [
        ("missing", F.col("o.page").isNull()), ("foreign", F.col("s.page").isNull()), ("geometry", moved),
        ("text", (F.col("s.role") == "text") & ~flat(F.col("s.text")).eqNullSafe(flat(F.col("o.text")))), ("draws", ~F.col("s.draws").eqNullSafe(F.col("o.draws")) & F.col("s.page").isNotNull() & F.col("o.page").isNotNull()),
    ]
    found = F.filter(F.array(*[F.when(test, name) for name, test in checks]), lambda x: x.isNotNull())
    return j.select(F.coalesce("s.page", "o.page").alias("page"), F.explode(found).alias("problem"))


def package_problems(notes: DataFrame, links: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(unit, problem): of a written package: notes referred to and absent, present and unused, dead links, bookmarks twice.

    ``notes`` has id, defined (bool), referred (bool); ``links`` has unit, target; ``bookmarks`` has name.
    """
    lost = notes.where("referred and not defined").select(F.col("id").alias("unit"), F.lit("footnote-missing").alias("problem"))
    idle = notes.where("defined and not referred").select(F.col("id").alias("unit"), F.lit("footnote-unused").alias("problem"))
    dead = links.join(bookmarks.withColumnRenamed("name", "target"), "target", "left_anti").where("target is not null").select("unit", F.lit("dead-link").alias("problem"))
    twice = bookmarks.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias("unit"), F.lit("bookmark-repeated").alias("problem"))
    return lost.unionByName(idle).unionByName(dead).unionByName(twice)


def placed_figures(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks of a book with figures (book_id, slot, key) put in before the block at their slot, renumbered.

    Figures are ranked between blocks by fractions of a place and then all are
    numbered again; a slot past the last block appends.
    """
    own = blocks.select("book_id", F.col("pos").cast("double").alias("rank"), "id", "type")
    half = F.row_number().over(Window.partitionBy("book_id", "slot").orderBy("key"))
    many = F.count(F.lit(1)).over(Window.partitionBy("book_id", "slot"))
    put = figures.select("book_id", (F.col("slot") - 1 + half / (many + 1)).alias("rank"), F.col("key").cast("string").alias("id"), F.lit("image").alias("type"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "id"))
    return own.unionByName(put).select("book_id", place.alias("pos"), "id", "type")


def signoff(books: DataFrame, verdicts: DataFrame, pending: DataFrame) -> DataFrame:
    """Findings for books whose reviews reject them, are not verified, or that have units pending; verdicts has book_id, stage, verdict."""
    rejected = verdicts.where("verdict = 'rejected'")
    sound = verdicts.where("verdict = 'ok'").select("book_id").distinct()
    unverified = books.join(sound, "book_id", "left_anti").join(rejected.select("book_id").distinct(), "book_id", "left_anti")
    waiting = pending.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    return all_findings(
        finding(rejected, "error", "semantic-rejected", F.col("stage"), F.col("verdict")),
        finding(unverified, "error", "semantic-unverified", F.col("book_id"), F.lit("")),
        finding(waiting, "error", "publication-pending", F.col("book_id"), F.col("n").cast("string")),
    )


def first_mention_gate(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings for names (book_id, id, first_form, target) whose first form is missing, repeated, or behind the plain name."""
    formed = entries.where("first_form <> '' and target <> ''").select("book_id", F.col("id").alias("entry"), "first_form", F.col("target").alias("name"))
    texts = blocks.where("target <> ''").select("book_id", "pos", "id", F.col("target").alias("shown"))
    # the first three characters of a name find the texts that may hold it
    keyed = formed.withColumn("start", F.left("name", F.lit(3)))
    grams = F.transform(F.sequence(F.lit(1), F.length("shown")), lambda k: F.substring("shown", k, F.lit(3)))
    shorter = F.flatten(F.transform(grams, lambda x: F.array(x, F.left(x, F.lit(2)), F.left(x, F.lit(1)))))
    near = texts.select("book_id", "pos", "id", F.explode(F.array_distinct(shorter)).alias("start")).join(small_or_shuffled(checkpoint(keyed)), ["book_id", "start"]).drop("start").distinct()
    used = near.join(texts, ["book_id", "pos", "id"]).where(F.contains(F.col("shown"), F.col("name")))
    times = (F.length("shown") - F.length(F.replace("shown", F.col("first_form"), F.lit("")))) / F.length("first_form")
    per = used.groupBy("book_id", "entry").agg(F.sum(times).cast("int").alias("n"), F.min("pos").alias("first_pos"), F.min(F.when(times > 0, F.col("pos"))).alias("formed_pos"))
    code = F.when(F.col("n") == 0, "first-mention-missing").when(F.col("n") > 1, "first-mention-repeated").when(F.col("formed_pos") > F.col("first_pos"), "first-mention-misplaced")
    return finding(per.withColumn("code", code).where("code is not null"), "warning", F.col("code"), F.col("entry"), F.col("n").cast("string"))
