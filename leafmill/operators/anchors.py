"""Anchors of documents that become one book, and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named_anchors(anchors: DataFrame) -> DataFrame:
    """(document, fragment, name): a fragment's name in the whole book.

    ``anchors`` has document and fragment, each pair once. A fragment of one
    document keeps its name; others carry a hash of their document's name, and a
    number if that name is a fragment already.
    """
    counted = anchors.select("document", "fragment").join(anchors.groupBy("fragment").agg(F.count(F.lit(1)).alias("n")), "fragment")
    base = F.concat(F.lit("epub-"), F.left(F.sha2("document", 256), F.lit(12)), F.lit("-"), "fragment")
    named = counted.withColumn("base", F.when(F.col("n") > 1, base).otherwise(F.col("fragment")))
    taken = anchors.select(F.col("fragment").alias("base"), F.lit(True).alias("taken")).distinct()
    joined = named.join(taken, "base", "left")
    name = F.when((F.col("n") > 1) & F.col("taken"), F.concat("base", F.lit("-2"))).otherwise(F.col("base"))
    return joined.select("document", "fragment", name.alias("name"))


def link_target(document: Column, href: Column) -> tuple[Column, Column]:
    """The document and the fragment that a link points to; both null for links that leave the book or have no fragment."""
    outside = href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)") | ~href.contains("#")
    path = F.regexp_extract(href, r"^([^#?]*)", 1)
    folder = F.regexp_extract(document, r"^(.*/)", 1)
    full = F.regexp_replace(F.regexp_replace(F.concat(folder, path), r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")
    fragment = F.regexp_extract(href, "#(.*)$", 1)
    return F.when(~outside & (fragment != ""), F.when(path == "", document).otherwise(full)), F.when(~outside & (fragment != ""), fragment)


def resolved_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(link_key, document, href, name, resolved): internal links with the name they point to; others are left out.

    ``links`` has link_key, document and href. A null href is no link.
    """
    to, fragment = link_target(F.col("document"), F.col("href"))
    inner = links.select("link_key", "document", "href", to.alias("to"), fragment.alias("fragment")).where("to is not null")
    n = named_anchors(anchors).select(F.col("document").alias("to"), "fragment", "name")
    found = inner.join(n, ["to", "fragment"], "left")
    return found.select("link_key", "document", "href", "name", F.col("name").isNotNull().alias("resolved"))


def settled_anchors(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book_id, pos, id, name): names that something links to, each on the first block that has it.

    ``anchors`` has book_id, pos, id, name; ``wanted`` has book_id and name.
    """
    used = anchors.join(wanted.select("book_id", "name").distinct(), ["book_id", "name"], "left_semi")
    first = used.groupBy("book_id", "name").agg(F.min(F.struct("pos", "id")).alias("f"))
    return first.select("book_id", "f.pos", "f.id", "name")


def section_order(views: DataFrame, declared: DataFrame) -> DataFrame:
    """(document, page, back_to, reached): pages with the shape of an earlier section than the one reached.

    ``views`` has document, page, width, height; ``declared`` has document, no, width,
    height. Pages walk forward through the sections; a page with the shape of the
    section reached stays in it, one of a later section moves on, one of an earlier
    section is reported and moves back. The walk runs over a document's narrow rows.
    """
    sections = declared.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")))).alias("s"))
    pages = views.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")))).alias("p"))
    joined = pages.join(sections.where("size(s) > 1"), "document")
    same = "abs(s[i - 1].width - v.width) <= 2 and abs(s[i - 1].height - v.height) <= 2"
    found = f"""if(exists(array(acc.at), i -> {same}), acc.at, coalesce(
        get(filter(sequence(1, size(s)), i -> i > acc.at and {same}), 0), get(filter(sequence(1, size(s)), i -> i < acc.at and {same}), 0), acc.at))"""
    walk = f"""aggregate(p, named_struct('at', 1, 'out', cast(array() as array<struct<page:int, back_to:int, reached:int>>)),
      (acc, v) -> transform(array({found}), k -> named_struct('at', k, 'out',
        if(k < acc.at, concat(acc.out, array(named_struct('page', cast(v.page as int), 'back_to', k, 'reached', acc.at))), acc.out)))[0], acc -> acc.out)"""
    return joined.select("document", F.explode(F.expr(walk)).alias("o")).select("document", "o.*")


def part_neighbours(units: DataFrame) -> DataFrame:
    """(book_id, part, id, before, after): the targets of the units before and behind within the same part, else empty."""
    order = Window.partitionBy("book_id").orderBy("part_no", "pos", "id")

    def beside(shift: Column, part: Column) -> Column:
        return F.when(part == F.col("part"), F.coalesce(shift, F.lit(""))).otherwise("")

    before = beside(F.lag("target").over(order), F.lag("part").over(order))
    after = beside(F.lead("target").over(order), F.lead("part").over(order))
    return units.select("book_id", "part", "id", F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after"))


def separators(cuts: DataFrame) -> DataFrame:
    """(owner, id, gap): the white space around a cut of a text if it holds a line break; other cuts are left out.

    ``cuts`` has owner, id, offset and text, the whole source; offset 0 is no cut.
    """
    left = F.regexp_extract(F.substring("text", F.lit(1), F.col("offset")), r"(?U)(\s*)$", 1)
    right = F.regexp_extract(F.expr("substring(text, offset + 1)"), r"(?U)^(\s*)", 1)
    gap = F.replace(F.replace(F.concat(left, right), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return cuts.where("offset > 0").select("owner", "id", gap.alias("gap")).where(F.col("gap").contains("\n"))
