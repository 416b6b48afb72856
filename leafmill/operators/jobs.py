"""Cutting a book into jobs: greedy chunks, neighbours, offsets, segments, batches and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.blocks import starts_chapter
from leafmill.operators.digests import ordered_digests
from leafmill.operators.ranges import cut_in_ranges

# Default budget of a chunk in characters, its overshoot, the share below which a chapter start does not break, prose length.
BUDGET, OVERSHOOT, FILLED, PROSE = 6000, 0.35, 0.25, 120
#: Characters of neighbouring text that a job shows.
CONTEXT = 450


def chunks(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(book_id, pos, id, chunk_no): the greedy, chapter-aware cut of each book.

    The rule depends on all blocks before; it is folded over ranges of narrow rows
    (cost and two flags), so that a book may be as large as the table. A null
    text costs nothing. The first chunk is number 1.
    """
    cap, filled = int(budget * (1 + OVERSHOOT)), budget * FILLED

    def rule(size: int, held_prose: bool, held: bool, cost: int, opens: bool, own: bool) -> tuple[bool, bool]:
        early = opens and size < filled and not held_prose
        return held and (opens or size + cost > cap) and not early, size + cost >= budget and not opens

    cost = F.coalesce(F.length("text"), F.lit(0))
    prose = F.col("type").isin("paragraph", "blockquote", "verse") & (cost > PROSE)
    narrow = blocks.select(F.col("book_id").alias("by"), "pos", "id", cost.alias("cost"), starts_chapter(F.col("type"), F.col("level")).alias("opens"), prose.alias("prose"))
    return cut_in_ranges(narrow, rule).select(F.col("by").alias("book_id"), "pos", "id", F.col("no").alias("chunk_no"))


def neighbours(chunked: DataFrame, blocks: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(book_id, chunk_no, before, after): the end of the previous chunk's text and the start of the next one's."""
    texts = chunked.join(blocks.select("book_id", "id", "text"), ["book_id", "id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    groups = texts.groupBy("book_id", "chunk_no").agg(joined.alias("whole"))
    order = Window.partitionBy("book_id").orderBy("chunk_no")
    empty = F.lit("")
    return groups.select(
        "book_id", "chunk_no",
        F.coalesce(F.lag(F.right("whole", F.lit(width))).over(order), empty).alias("before"),
        F.coalesce(F.lead(F.left("whole", F.lit(width))).over(order), empty).alias("after"),
    )


def unit_offsets(parts: DataFrame) -> DataFrame:
    """Offsets of the parts of an owner: (owner, seq, text) gains offset and length."""
    before = Window.partitionBy("owner").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("length", F.length("text")).withColumn("offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def span_problems(spans: DataFrame) -> DataFrame:
    """(owner, at, problem): overlaps and gaps of (owner, offset, length, whole), and owners not covered to their end."""
    order = Window.partitionBy("owner").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("offset") + F.col("length")).over(order), F.lit(0))
    judged = spans.withColumn("reached", reached)
    problem = F.when(F.col("offset") < F.col("reached"), "overlap").when(F.col("offset") > F.col("reached"), "gap")
    inner = judged.select("owner", F.col("offset").alias("at"), problem.alias("problem")).where("problem is not null")
    ends = spans.groupBy("owner").agg(F.max(F.col("offset") + F.col("length")).alias("at"), F.max("whole").alias("whole"))
    return inner.unionByName(ends.where("at < whole").select("owner", "at", F.lit("uncovered").alias("problem")))


def segment_owner(unit: Column) -> Column:
    """The unit that a numbered segment belongs to; other suffixes name no segment."""
    owner = F.regexp_extract(unit, r"^(.+)#[0-9]+$", 1)
    return F.when(owner != "", owner).otherwise(unit)


def segment_index(unit: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(unit, r"#([0-9]+)$", 1), F.lit("")), F.lit("999999")).cast("int")


def rejoined(segments: DataFrame) -> DataFrame:
    """(owner, text): segments of a unit joined by index, trimmed, without blank ones."""
    s = segments.withColumn("owner", segment_owner(F.col("unit"))).withColumn("at", F.coalesce(segment_index(F.col("unit")), F.lit(0)))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text"))))
    return s.groupBy("owner").agg(F.array_join(F.filter(F.transform(pieces, lambda x: x["text"]), lambda x: x != ""), " ").alias("text"))


def segment_problems(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """(owner, problem): segments of ``expected`` (unit) that ``answered`` lacks, and owners answered whole and split."""
    missing = expected.join(answered, "unit", "left_anti").select(segment_owner(F.col("unit")).alias("owner"), F.lit("missing").alias("problem"))
    a = answered.select(segment_owner(F.col("unit")).alias("owner"), (F.col("unit") == segment_owner(F.col("unit"))).alias("whole"))
    both = a.groupBy("owner").agg(F.max("whole").alias("whole"), F.min("whole").alias("all_whole")).where("whole and not all_whole")
    return missing.unionByName(both.select("owner", F.lit("whole and split").alias("problem"))).distinct()


def batches(units: DataFrame, order: list[str], size: int = 20, by: str = "book_id") -> DataFrame:
    """Units with the number of the sheet of ``size`` they stand on, from 0, in each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return units.withColumn("sheet", F.floor((place - 1) / size).cast("int"))


def next_jobs(jobs: DataFrame) -> DataFrame:
    """The first job of each book, by pos, that is not done."""
    return jobs.where(~F.coalesce("done", F.lit(False))).groupBy("book_id").agg(F.min_by("id", "pos").alias("next_id"))


def book_digests(blocks: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """A digest of each book: its units in order of pos, hashed in ranges.

    Nulls and empty strings give different digests.
    """
    return ordered_digests(blocks.withColumn("part_", F.lit(0)), "book_id", "part_", "pos", columns, tag)
