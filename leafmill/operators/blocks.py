"""Units of a book: projections, predicates and positional joins over typed blocks.

Blocks have book_id, pos, id, type, level, text, target, page. Order is ``pos``
within a book; nulls and empty strings stay apart unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Block types that carry text, and those that do not.
TEXT_TYPES = ["heading", "paragraph", "blockquote", "listitem", "caption", "verse"]
OTHER_TYPES = ["image", "pagebreak", "separator", "table", "layout"]
NOTE = r"\[\[fn:([A-Za-z0-9_-]+)\]\]"


#: Places of a book's order that a carried value is looked up in together.
RUN = 256


def carried(blocks: DataFrame, value: Column, name: str, default: Column | None = None) -> DataFrame:
    """``blocks`` with the last ``value`` of the book up to each block that is not null, else ``default``.

    A book is cut into runs of places. Within a run a window looks back; what is in
    force at its start comes from narrow rows, one a run, so no task sorts a whole
    book of texts.
    """
    cut = blocks.withColumn("value_", value).withColumn("run_", F.floor(F.col("pos") / RUN))
    runs = cut.groupBy("book_id", "run_").agg(F.max(F.when(F.col("value_").isNotNull(), F.struct("pos", "value_"))).alias("m"))
    earlier = Window.partitionBy("book_id").orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    force = runs.select("book_id", "run_", F.last("m.value_", ignorenulls=True).over(earlier).alias("before_"))
    within = Window.partitionBy("book_id", "run_").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last("value_", ignorenulls=True).over(within)
    c, f = cut.withColumn("own_", own).alias("c"), force.where("before_ is not null").alias("f")
    joined = c.join(f, F.col("c.book_id").eqNullSafe(F.col("f.book_id")) & F.col("c.run_").eqNullSafe(F.col("f.run_")), "left")
    found = F.coalesce("c.own_", "f.before_", *([] if default is None else [default]))
    return joined.select(*[F.col(f"c.{x}") for x in blocks.columns], found.alias(name))


def once(deliveries: DataFrame, key: str = "block_key") -> DataFrame:
    """One row per key of a table that is delivered more than once; deliveries of a key are equal but for their time."""
    return deliveries.dropDuplicates([key])


def is_text(kind: Column) -> Column:
    return kind.isin(TEXT_TYPES)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def unit_kind(kind: Column, level: Column) -> Column:
    """The kind by which a worksheet calls a block."""
    short = F.create_map(*[F.lit(x) for pair in (("paragraph", "para"), ("blockquote", "quote"), ("listitem", "list")) for x in pair])
    return F.when(kind == "heading", F.concat(F.lit("heading"), F.coalesce(level, F.lit(1)))).otherwise(F.coalesce(short[kind], kind))


def starts_chapter(kind: Column, level: Column) -> Column:
    """A heading of level 1 or 2; one without a level starts none."""
    return (kind == "heading") & (F.coalesce(level, F.lit(9)) <= 2)


def text_blocks(blocks: DataFrame, blank: bool = True) -> DataFrame:
    """Blocks of a text type; without ``blank``, those with something to read."""
    kept = blocks.where(is_text(F.col("type")))
    return kept if blank else kept.where(~is_blank(F.col("text")))


def published_units(books: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """What prints, in order: title, author, body blocks, notes; a unit prints if its source or target is not blank."""
    meta = books.select(
        "book_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("part_no"), F.lit(0).alias("pos"), F.lit("title").alias("id"), F.lit("metadata").alias("part"), F.lit("title").alias("kind"), F.col("title").alias("source"), F.col("title_target").alias("target")),
            F.struct(F.lit(0).alias("part_no"), F.lit(1).alias("pos"), F.lit("author").alias("id"), F.lit("metadata").alias("part"), F.lit("author").alias("kind"), F.col("author").alias("source"), F.col("author_target").alias("target")),
        )).alias("u"),
    ).select("book_id", "u.*")
    part = F.when(F.col("type") == "caption", "caption").otherwise("body")
    body = text_blocks(blocks).select("book_id", F.lit(1).alias("part_no"), "pos", "id", part.alias("part"), unit_kind(F.col("type"), F.col("level")).alias("kind"), F.col("text").alias("source"), "target")
    noted = notes.select("book_id", F.lit(2).alias("part_no"), F.lit(0).alias("pos"), "id", F.lit("note").alias("part"), F.lit("note").alias("kind"), F.col("text").alias("source"), "target")
    units = meta.unionByName(body).unionByName(noted)
    return units.where(~is_blank(F.col("source")) | ~is_blank(F.col("target")))


def is_literal(text: Column) -> Column:
    """A text that is nothing but code spans has nothing to translate."""
    return ~is_blank(text) & is_blank(F.regexp_replace(text, "`[^`]*`", ""))


def pending_units(units: DataFrame) -> DataFrame:
    """Published units with a source that still wait for a target."""
    return units.where(~is_blank(F.col("source")) & ~is_literal(F.col("source")) & is_blank(F.col("target")))


def unit_slots(units: DataFrame) -> DataFrame:
    """Where each unit's target is stored: (table_name, field)."""
    table = F.when(F.col("part") == "metadata", "books").when(F.col("part") == "note", "footnotes").otherwise("blocks")
    field = F.when(F.col("part") == "metadata", F.concat("id", F.lit("_target"))).otherwise("target")
    return units.select("book_id", "id", table.alias("table_name"), field.alias("field"))


def blind_targets(units: DataFrame) -> DataFrame:
    """Targets as a reader sees them, without their sources."""
    return units.where(~is_blank(F.col("target"))).drop("source")


def note_references(blocks: DataFrame, column: str) -> DataFrame:
    """(book_id, block_id, pos, ref_no, note_id): note tokens of a text in order, outside code spans."""
    shown = F.regexp_replace(F.col(column), "`[^`]*`", "")
    refs = F.posexplode(F.regexp_extract_all(shown, F.lit(NOTE), 1))
    return blocks.where(F.col(column).isNotNull()).select("book_id", F.col("id").alias("block_id"), "pos", refs.alias("at", "note_id")).select(
        "book_id", "block_id", "pos", (F.col("at") + 1).alias("ref_no"), "note_id"
    )


def translatable_units(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Text blocks in order, and the notes they refer to, each once."""
    body = text_blocks(blocks).select("book_id", "id", unit_kind(F.col("type"), F.col("level")).alias("kind"), "text")
    used = note_references(text_blocks(blocks), "text").select("book_id", F.col("note_id").alias("id")).distinct()
    noted = notes.join(used, ["book_id", "id"], "left_semi").select("book_id", "id", F.lit("note").alias("kind"), "text")
    return body.unionByName(noted)


def chapter_of_block(blocks: DataFrame) -> DataFrame:
    """Each block with the id of the chapter heading in force, ``front`` before the first."""
    opening = F.when(starts_chapter(F.col("type"), F.col("level")), F.col("id"))
    return carried(blocks, opening, "chapter", F.lit("front"))


def page_of_block(blocks: DataFrame) -> DataFrame:
    """Each block with its page: a positive one of its own, else the last before it, else 1."""
    valid = F.when(F.col("page") > 0, F.col("page"))
    return carried(blocks, valid, "on_page", F.lit(1))


def sections_in_force(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks with the section that covers them; ``sections`` has book_id, section_no, start_block."""
    starts = sections.select("book_id", "section_no", F.col("start_block").alias("id"))
    marked = blocks.join(starts, ["book_id", "id"], "left")
    return carried(marked, F.col("section_no"), "section").drop("section_no")


def note_pages(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """(book_id, id, on_page): a note belongs to the page of its first reference, else to that of its anchor."""
    paged = page_of_block(blocks)
    refs = note_references(blocks, "text").join(paged.select("book_id", F.col("id").alias("block_id"), "on_page"), ["book_id", "block_id"])
    first = refs.groupBy("book_id", "note_id").agg(F.min_by("on_page", F.struct("pos", "ref_no")).alias("ref_page"))
    anchored = paged.select("book_id", F.col("id").alias("anchor_block"), F.col("on_page").alias("anchor_page"))
    joined = notes.join(first.withColumnRenamed("note_id", "id"), ["book_id", "id"], "left").join(anchored, ["book_id", "anchor_block"], "left")
    return joined.select("book_id", "id", F.coalesce("ref_page", "anchor_page").alias("on_page"))


def unused_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that no text refers to."""
    used = note_references(blocks, "text").select("book_id", F.col("note_id").alias("id"))
    return notes.join(used, ["book_id", "id"], "left_anti")


def undefined_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """References to notes that the book does not define."""
    return note_references(blocks, "text").join(notes.select("book_id", F.col("id").alias("note_id")), ["book_id", "note_id"], "left_anti")


def book_stats(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Per book: blocks, headings, paragraphs, captions, words, characters, translated units, and notes."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    per_book = blocks.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("type") == "heading").alias("n_headings"),
        F.count_if(F.col("type") == "paragraph").alias("n_paragraphs"),
        F.count_if(F.col("type") == "caption").alias("n_captions"),
        F.sum(words).alias("n_words"),
        F.sum(F.length(text)).alias("n_chars"),
        F.count_if(is_text(F.col("type")) & ~is_blank(F.col("target"))).alias("n_translated"),
    )
    counted = notes.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_notes"))
    return per_book.join(counted, "book_id", "left").fillna(0, ["n_notes"])


def coverage(units: DataFrame) -> DataFrame:
    """Translated and all units with a source, per book and part, with a total over parts (part null)."""
    sourced = units.where(~is_blank(F.col("source")))
    return sourced.rollup("book_id", "part").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(~is_blank(F.col("target"))).alias("n_translated")
    ).where("book_id is not null")


def script_ratio(text: Column) -> tuple[Column, Column]:
    """Shares of Persian and of Latin letters among both; (0, 0) without any."""
    persian = F.length(F.regexp_replace(text, r"[^؀-ۿ]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    total = persian + latin
    share = lambda n: F.when(total > 0, n / total).otherwise(0.0)
    return share(persian), share(latin)


def bbox_unions(blocks: DataFrame) -> DataFrame:
    """The box around all blocks of a page of a book; pages that are null or not positive are left out."""
    at = lambda i: F.get("bbox", F.lit(i))
    return blocks.where("page > 0 and bbox is not null").groupBy("book_id", "page").agg(
        F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"), F.max(at(2)).alias("x1"), F.max(at(3)).alias("y1")
    )
