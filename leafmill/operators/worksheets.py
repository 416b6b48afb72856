"""Worksheets and reference tables as text, and the records that go beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of events and numbers that a log may hold; no text of a manuscript does.
KINDS, NUMBERS = ["stage", "refused", "module"], ["blocks", "notes", "assets", "item", "items"]
# How review times are written.
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def escaped_payload(text: Column) -> Column:
    """A body whose lines cannot be taken for headers, fences or comments: one backslash before such lines."""
    return F.regexp_replace(text, r"(?m)^(\\*)(@@ |`{3}|~{3}|<!--)", r"\\$1$2")


def rendered_unit(id_: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit("@@ "), id_, F.lit(" <"), kind, F.lit(">\n"), escaped_payload(F.coalesce(text, F.lit(""))), F.lit("\n"))


def worksheets(units: DataFrame) -> DataFrame:
    """(book_id, chunk_no, n_units, n_chars, sheet): each chunk as a sheet that a reply can be read back from.

    ``units`` has book_id, chunk_no, pos, id, kind, text. A chunk is bounded by its budget, so its sheet is as well.
    """
    lines = F.array_sort(F.collect_list(F.struct("pos", rendered_unit(F.col("id"), F.col("kind"), F.col("text")).alias("u"))))
    grouped = units.groupBy("book_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"), lines.alias("ls"))
    head = F.concat(F.lit("<!-- worksheet "), F.lpad(F.col("chunk_no").cast("string"), 4, "0"), F.lit(" | units "), F.col("n_units"), F.lit(" | "), F.col("n_chars"), F.lit(" source chars -->\n"))
    return grouped.select("book_id", "chunk_no", "n_units", "n_chars", F.concat(head, F.array_join(F.transform("ls", lambda x: x["u"]), "\n")).alias("sheet"))


def rendered_size(id_: Column, kind: Column, text: Column) -> Column:
    """The length of a unit as it stands in a sheet; what packing must count."""
    return F.length(rendered_unit(id_, kind, text)) + 1


def term_tables(entries: DataFrame, present: DataFrame) -> DataFrame:
    """(book_id, chunk_no, n_terms, table): the entries whose source stands in a chunk, by source, as a table.

    ``present`` has book_id, chunk_no, id.
    """
    rows = present.distinct().join(entries.select("book_id", "id", "source", "target", "category").where("source is not null and target is not null"), ["book_id", "id"])
    line = F.concat_ws(" | ", "source", "target", F.coalesce("category", F.lit("-")))
    ordered = F.array_sort(F.collect_list(F.struct("source", "id", line.alias("line"))))
    return rows.groupBy("book_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("table"))


def voice_cards(voices: DataFrame) -> DataFrame:
    """(book_id, id, card): how a speaker sounds, one line for each trait that is given."""
    traits = [F.when(F.trim(c) != "", F.concat(F.lit(f"{c}: "), F.trim(c))) for c in ("name", "register", "note")]
    return voices.select("book_id", "id", F.concat_ws("\n", *traits).alias("card"))


def write_worksheets(sheets: DataFrame, folder: str) -> None:
    """One text per sheet, in a folder per book, and the manifest of all sheets beside them."""
    sheets.select("book_id", "chunk_no", "n_units", "n_chars", F.sha2("sheet", 256).alias("sha256")).write.mode("overwrite").parquet(f"{folder}/manifest")
    sheets.select("book_id", "chunk_no", F.col("sheet").alias("value")).write.mode("overwrite").partitionBy("book_id", "chunk_no").text(f"{folder}/sheets")


def write_sidecars(pages: DataFrame, folder: str) -> None:
    """Recognised pages as records, and the text of every book beside them, in order of pages."""
    pages.write.mode("overwrite").partitionBy("book_id").json(f"{folder}/records")
    ordered = pages.repartitionByRange("book_id", "page").sortWithinPartitions("book_id", "page")
    ordered.select("book_id", F.coalesce("text", F.lit("")).alias("value")).write.mode("overwrite").partitionBy("book_id").text(f"{folder}/text")


def log_events(events: DataFrame) -> DataFrame:
    """(at, kind, stage, cause, and the numbers that a log may hold): events of known kinds; other columns and texts are dropped.

    A number that is negative or over a million is left out, so nothing but counts gets into a log.
    """
    counts = [F.when(F.col(c).between(0, 1_000_000), F.col(c)).alias(c) for c in NUMBERS if c in events.columns]
    return events.where(F.col("kind").isin(KINDS)).select("at", "kind", "stage", "cause", *counts)


def append_events(events: DataFrame, folder: str) -> None:
    """Add events to the log; what is there stays."""
    log_events(events).write.mode("append").parquet(folder)


def strict_stamp(text: Column) -> Column:
    """The time of a UTC stamp in whole seconds; null if it is written otherwise or no such time exists."""
    at = F.try_to_timestamp(F.translate(text, "TZ", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(text.rlike(STAMP), at)


def fluency_state(proposed: Column, applied: Column, refused: Column) -> Column:
    """What a pass over the wording came to: refused, proposed (edits wait), applied, or approved-no-change."""
    edits = F.coalesce(proposed, F.lit(0)) > 0
    return F.when(F.coalesce(refused, F.lit(False)), "refused").when(edits & ~F.coalesce(applied, F.lit(False)), "proposed").when(edits, "applied").otherwise("approved-no-change")


def fluency_refusal(state: Column, operation: Column, current: Column) -> Column:
    """Why an operation on a pass is refused, null if it may go on. ``current`` tells that the texts are those reviewed."""
    apply, verdict = operation == "apply", operation == "verdict"
    return (
        F.when(state == "refused", "refused").when(apply & (state == "applied"), "already-applied").when(verdict & (state == "proposed"), "edits-unapplied")
        .when(apply & ~F.coalesce(current, F.lit(False)), "stale-edits")
    )
