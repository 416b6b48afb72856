"""Digests of ordered records: rows are hashed, then the hashes of a range, then those of all ranges.

So no task holds the text of a group, and a group as large as the table is hashed in
ranges of its order. Nulls and empty strings give different digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between fields, and how many places of the order are hashed together.
SEPARATOR, RANGE = "\u001f", 1024
# What a file that is not there counts as.
ABSENT = "absent"


def record_hash(columns: list[str]) -> Column:
    """The hash of one record's fields."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *shown), 256)


def _in_order(hashes: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, value)))
    return hashes.groupBy(*by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x[value]), "\n"), 256).alias(value))


def ordered_digests(rows: DataFrame, by: str, part: str, pos: str, columns: list[str], tag: str, also: str = "id") -> DataFrame:
    """(by, digest): one digest of a group's records, in order of part, pos and ``also``.

    Groups without records have no row. Repeated records count as often as they stand there.
    """
    hashed = rows.select(F.col(by), F.col(part).alias("part_"), F.col(pos).alias("pos_"), F.col(also).alias("also_"), record_hash(columns).alias("digest"))
    ranges = _in_order(hashed.withColumn("range_", F.floor(F.col("pos_") / RANGE)), [by, "part_", "range_"], ["pos_", "also_"], "digest")
    whole = _in_order(ranges, [by], ["part_", "range_"], "digest")
    return whole.select(by, F.concat(F.lit(f"{tag}:"), "digest").alias("digest"))


def bilingual_digests(units: DataFrame) -> DataFrame:
    """What a review of source and target is about: all published units, both sides."""
    return ordered_digests(units, "book_id", "part_no", "pos", ["id", "part", "kind", "source", "target"], "meaning4")


def target_digests(units: DataFrame) -> DataFrame:
    """What a review of the wording is about: the targets only; a note without a target is not part of it."""
    shown = units.where(~((F.col("part") == "note") & (F.coalesce(F.trim("target"), F.lit("")) == "")))
    return ordered_digests(shown, "book_id", "part_no", "pos", ["id", "part", "kind", "target"], "fluency4")


def unit_digests(chunks: DataFrame) -> DataFrame:
    """(book_id, chunk_no, digest): the units of each chunk as cut: id, kind and source, in order."""
    keyed = chunks.withColumn("key_", F.struct("book_id", "chunk_no"))
    found = ordered_digests(keyed, "key_", "chunk_no", "pos", ["id", "kind", "text"], "units5")
    return found.select("key_.book_id", "key_.chunk_no", "digest")


def request_digests(sheets: DataFrame, units: DataFrame, policy: str) -> DataFrame:
    """(sheet, digest): what a reviewer is asked: stage, sheet, revision and policy, then the sheet's units in order.

    ``sheets`` has sheet, stage, revision; ``units`` has sheet, pos, id, source, target. A sheet without units has a digest too.
    """
    inner = ordered_digests(units.withColumn("part_", F.lit(0)), "sheet", "part_", "pos", ["id", "source", "target"], "u")
    joined = sheets.join(inner.withColumnRenamed("digest", "units"), "sheet", "left").withColumn("policy", F.lit(policy))
    return joined.select("sheet", F.concat(F.lit("rev1:"), record_hash(["stage", "sheet", "revision", "policy", "units"])).alias("digest"))


def page_digests(blocks: DataFrame) -> DataFrame:
    """(book_id, page, request, translation): what is asked of a page, and what came back, its blocks in order."""
    placed = blocks.where(F.col("page") > 0).withColumn("key_", F.struct("book_id", "page")).withColumn("part_", F.lit(0))
    asked = ordered_digests(placed, "key_", "part_", "pos", ["id", "type", "level", "text"], "page-request2").withColumnRenamed("digest", "request")
    given = ordered_digests(placed, "key_", "part_", "pos", ["id", "target"], "page5").withColumnRenamed("digest", "translation")
    return asked.join(given, "key_").select("key_.book_id", "key_.page", "request", "translation")


def evidence_digests(files: DataFrame) -> DataFrame:
    """(subject, digest): ordered evidence files (subject, pos, name, sha256); a file that is not there counts as absent."""
    line = F.concat(F.coalesce("name", F.lit("")), F.lit(":"), F.coalesce("sha256", F.lit(ABSENT)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return files.groupBy("subject").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256).alias("digest"))


def page_source_digests(pages: DataFrame) -> DataFrame:
    """(book_id, page, digest): a page's prose, the hash of its bytes, and its width and height."""
    return pages.select("book_id", "page", F.concat(F.lit("page-source:"), record_hash(["prose", "sha256", "width", "height"])).alias("digest"))
