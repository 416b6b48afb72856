"""Pages as laid out: repeated heads, dominant sizes, geometry, headings, paragraphs, overlaps, blank bands, recognition confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest head, part and least number of pages that repeat one; grid of page sizes; share of an overlap that counts.
HEAD_CHARS, HEAD_PART, HEAD_LEAST = 90, 0.25, 3
GRID, OVERLAP, SPATIAL, BLANK_BAND = 2, 0.15, 0.35, 0.35


def head_form(line: Column) -> Column:
    """A margin line as it is compared: one space for white space, ``#`` for digits, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), "[0-9]+", "#"))


def repeated_heads(lines: DataFrame) -> DataFrame:
    """(book_id, head, n_pages): margin lines (book_id, page, line) that stand on enough of a book's pages."""
    headed = lines.where(F.length(F.trim("line")).between(1, HEAD_CHARS)).withColumn("head", head_form(F.col("line")))
    pages = lines.groupBy("book_id").agg(F.countDistinct("page").alias("pages"))
    counted = headed.groupBy("book_id", "head").agg(F.countDistinct("page").alias("n_pages"))
    least = F.greatest(F.lit(HEAD_LEAST), F.floor(F.col("pages") * HEAD_PART))
    return counted.join(pages, "book_id").where(F.col("n_pages") >= least).select("book_id", "head", "n_pages")


def weighted_mode(rows: DataFrame, by: str, size: str, weight: str, order: str) -> DataFrame:
    """(by, mode): the size with the greatest weight, the one seen first on ties."""
    sums = rows.groupBy(by, size).agg(F.sum(weight).alias("w"), F.min(order).alias("first_seen"))
    return sums.groupBy(by).agg(F.max_by(size, F.struct(F.col("w"), -F.col("first_seen"))).alias("mode"))


def geometry_census(pages: DataFrame) -> DataFrame:
    """(book_id, width, height, n_pages, dominant): page sizes on a grid of 2 points, the most frequent (first on ties) marked."""
    grid = lambda c: (F.bround(F.col(c) / GRID) * GRID).cast("int")
    counted = pages.groupBy("book_id", grid("width").alias("width"), grid("height").alias("height")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))
    order = Window.partitionBy("book_id").orderBy(F.desc("n_pages"), "first_page", "width", "height")
    return counted.withColumn("dominant", F.row_number().over(order) == 1).drop("first_page")


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, upper_median): the middle value in order, the upper one of two; equal values are counted first, so no group is collected."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(by))
    passed = counts.select(by, value, upto.alias("upto"), total.alias("total")).where(F.col("upto") > F.floor(F.col("total") / 2))
    return passed.groupBy(by).agg(F.min(value).alias("upper_median"))


def text_class(share: Column, covered: Column, any_text: Column) -> Column:
    """digital, scanned or mixed, of the share of text pages and whether images cover pages without text."""
    return F.when(~any_text, "scanned").when((share < 0.92) | covered, "mixed").otherwise("digital")


def heading_level(ratio: Column, bold: Column, length: Column, capitals: Column, airy: Column) -> Column:
    """The level of a line as a heading by its size against the body's; null if it is none. The first rule that holds counts."""
    return (
        F.when(length > 120, F.lit(None).cast("int"))
        .when(ratio >= 1.8, 1)
        .when(ratio >= 1.45, 2)
        .when(ratio >= 1.18, 3)
        .when(bold & (length <= 60), 3)
        .when(capitals & airy & (length <= 60), 3)
    )


def joined_paragraphs(blocks: DataFrame) -> DataFrame:
    """(book_id, pos, text, n): paragraphs that go on in the next block joined, page breaks passed over.

    A block goes on if the one before is a paragraph that does not end a sentence
    and it does not start with a capital.
    """
    order = Window.partitionBy("book_id").orderBy("pos")
    kept = blocks.where("type <> 'pagebreak'")
    before = F.lag(F.struct("type", "text")).over(order)
    ended = F.rlike(F.rtrim(before["text"]), F.lit(r"[.!?؟…:»”\"')]$"))
    goes_on = (F.col("type") == "paragraph") & (before["type"] == "paragraph") & ~ended & ~F.rlike(F.ltrim(F.col("text")), F.lit(r"^\p{Lu}"))
    flagged = kept.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text"))))
    return flagged.withColumn("island", island).groupBy("book_id", "island").agg(
        F.min("pos").alias("pos"), F.concat_ws(" ", F.transform(pieces, lambda x: x["text"])).alias("text"), F.count(F.lit(1)).alias("n")
    ).drop("island")


def gaps_above(blocks: DataFrame) -> DataFrame:
    """Blocks with the gap to the one above on the page, whether they start it, and the page's text columns."""
    page = Window.partitionBy("book_id", "page")
    order = page.orderBy("y0", "pos")
    gap = F.col("y0") - F.lag("y1").over(order)
    return blocks.withColumns({"gap": gap, "starts_page": F.row_number().over(order) == 1, "left": F.min("x0").over(page), "right": F.max("x1").over(page)})


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def overlap_share(a: str, b: str) -> Column:
    """The common part of two boxes as a share of the smaller one."""
    c = lambda s, k: F.col(f"{s}.{k}")
    common = area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))
    smaller = F.least(*[area(c(s, "x0"), c(s, "y0"), c(s, "x1"), c(s, "y1")) for s in (a, b)])
    return F.when(smaller > 0, common / smaller).otherwise(0.0)


def best_overlaps(boxes: DataFrame, others: DataFrame, least: float = SPATIAL) -> DataFrame:
    """(book_id, page, key, other_key, share): for each box the other box of its page that overlaps it most, first on ties."""
    a, b = boxes.alias("a"), others.alias("b")
    pairs = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page"))).withColumn("share", overlap_share("a", "b"))
    best = pairs.where(F.col("share") >= least).groupBy("a.book_id", "a.page", "a.key").agg(
        F.max(F.struct(F.col("share"), (-F.col("b.pos")).alias("p"), F.col("b.key").alias("k"))).alias("m")
    )
    return best.select("book_id", "page", "key", F.col("m.k").alias("other_key"), F.col("m.share").alias("share"))


def overlapping(texts: DataFrame, pictures: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(book_id, page, key, other_key): texts of a page that lie on a picture by more than ``least`` of the smaller of both."""
    a, b = texts.alias("a"), pictures.alias("b")
    pairs = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")))
    return pairs.where(overlap_share("a", "b") > least).select("a.book_id", "a.page", F.col("a.key").alias("key"), F.col("b.key").alias("other_key"))


def nearest_geometry(pages: DataFrame, declared: DataFrame) -> DataFrame:
    """Each page with the declared size nearest to its own, first on ties; ``declared`` is a small table of settings."""
    p, d = pages.alias("p"), F.broadcast(declared).alias("d")
    far = F.abs(F.col("p.width") - F.col("d.width")) + F.abs(F.col("p.height") - F.col("d.height"))
    pairs = p.join(d).withColumn("far", far)
    return pairs.groupBy("p.book_id", "p.page").agg(F.min_by("d.size_no", F.struct("far", "d.size_no")).alias("size_no"))


def blank_bands(boxes: DataFrame, top: float, bottom: float, share: float = BLANK_BAND) -> DataFrame:
    """(book_id, page, from_y, to_y): gaps between merged vertical intervals that are higher than ``share`` of the body."""
    order = Window.partitionBy("book_id", "page").orderBy("y0", "y1")
    reached = F.coalesce(F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(top))
    gaps = boxes.select("book_id", "page", reached.alias("from_y"), F.col("y0").alias("to_y"))
    tail = boxes.groupBy("book_id", "page").agg(F.max("y1").alias("from_y")).withColumn("to_y", F.lit(bottom)).where(F.col("from_y") < bottom - 12)
    return gaps.unionByName(tail).where(F.col("to_y") - F.col("from_y") > share * (bottom - top))


def furniture(y0: Column, y1: Column, top: Column, bottom: Column) -> Column:
    """Boxes wholly in a margin (6 points of it count as body)."""
    return (y1 <= top + 6) | (y0 >= bottom - 6)


def illustration(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0 >= 24) & (y1 - y0 >= 24)


def grade(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= 85, "high").when(confidence >= 60, "medium").otherwise("low")


def confidence_of_pages(words: DataFrame) -> DataFrame:
    """(page_key, line_no, n_chars, confidence): mean confidence of a line's words by their length, null without any."""
    n = F.length("text")
    known = F.col("conf").isNotNull() & (F.col("conf") >= 0)
    total = F.sum(F.when(known, n))
    return words.groupBy("page_key", "line_no").agg(
        F.sum(n).alias("n_chars"), F.when(total > 0, F.sum(F.when(known, n * F.col("conf"))) / total).alias("confidence")
    )


# Bits of a span's flags, words of a font's name, and fonts of recognised text, which carry no style.
ITALIC_BIT, BOLD_BIT = 2, 16
BOLD_NAMES, ITALIC_NAMES, RECOGNISED_FONTS = "bold|black|heavy", "italic|oblique", "glyphless|notoserif-regular|invisible"


def span_style(flags: Column, font: Column, recognised: Column) -> Column:
    """(bold, italic) of a span by its flags or its font's name; recognised text has neither."""
    name, bits = F.lower(F.coalesce(font, F.lit(""))), F.coalesce(flags, F.lit(0))
    plain = F.coalesce(recognised, F.lit(False)) | name.rlike(RECOGNISED_FONTS)
    bold, italic = ((bits.bitwiseAND(bit) != 0) | name.rlike(names) for bit, names in ((BOLD_BIT, BOLD_NAMES), (ITALIC_BIT, ITALIC_NAMES)))
    return F.struct((~plain & bold).alias("bold"), (~plain & italic).alias("italic"))


def body_rect(width: Column, height: Column, inner: Column, top: Column, outer: Column, bottom: Column) -> Column:
    """The body of a page within its margins; what is not given counts as 0."""
    w, h, i, t, o, b = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (width, height, inner, top, outer, bottom))
    return F.struct(i.alias("left"), t.alias("top"), (w - o).alias("right"), (h - b).alias("bottom"))


def coloured_share(histogram: DataFrame, least: int = 16) -> DataFrame:
    """(page_key, share, artwork): the share of a page's pixels with a saturation over ``least``; over 0.06 it is artwork.

    ``histogram`` has page_key, saturation and n pixels.
    """
    sums = histogram.groupBy("page_key").agg(F.sum(F.when(F.col("saturation") > least, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))
    share = F.when(F.col("n") > 0, F.try_divide("c", "n")).otherwise(0.0)
    return sums.select("page_key", share.alias("share"), (share > 0.06).alias("artwork"))
