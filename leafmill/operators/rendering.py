"""Checks of rendered pages and of written packages: positions, presence, order, aspect, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpoint

# Tolerances in points and shares.
SIZE, OVERFLOW, ASPECT, PROBE = 3, 6, 0.08, 48
FIGURE_GRID, FIGURE_PART, FIGURE_LEAST, FIGURE_PAGES = 8, 0.25, 3, 4


def size_problem(width: Column, height: Column, wanted_w: Column, wanted_h: Column) -> Column:
    """Null if a page has its size; ``turned`` if its sides are swapped, else ``size``."""
    near = lambda a, b: F.abs(a - b) <= SIZE
    return F.when(near(width, wanted_w) & near(height, wanted_h), None).when(near(width, wanted_h) & near(height, wanted_w), "turned").otherwise("size")


def outside_page(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """(book_id, page, key, problem): boxes cut off by the page's edge, or beyond its body by more than the tolerance."""
    clipped = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height)
    over = (F.col("x1") > width - OVERFLOW) | (F.col("y1") > height - OVERFLOW)
    problem = F.when(clipped, "text-clipped").when(over, "text-overflow")
    return boxes.select("book_id", "page", "key", problem.alias("problem")).where("problem is not null")


def same_shape(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = ASPECT) -> Column:
    return F.abs((w1 / h1) / (w2 / h2) - 1) <= tolerance


def probe(text: Column) -> Column:
    """What a text is looked for by: its first characters, white space as one space."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, PROBE)


def presence(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, unit, found, problem): how often a unit's probe stands in its page's text; missing, duplicated or null.

    ``units`` has book_id, page, unit, text; ``pages`` has book_id, page, shown.
    Probes shorter than four characters are unverified.
    """
    wanted = units.select("book_id", "page", "unit", probe(F.col("text")).alias("p"))
    flat = pages.select("book_id", "page", F.regexp_replace("shown", r"\s+", " ").alias("shown"))
    joined = wanted.join(flat, ["book_id", "page"], "left")
    found = (F.length("shown") - F.length(F.replace("shown", F.col("p"), F.lit("")))) / F.length("p")
    n = F.coalesce(found.cast("int"), F.lit(0))
    problem = F.when(F.length("p") < 4, "text-unverified").when(n == 0, "text-missing").when(n > 1, "text-duplicated")
    return joined.select("book_id", "unit", n.alias("found"), problem.alias("problem"))


def repeated_figures(figures: DataFrame) -> DataFrame:
    """Figures (book_id, page, key, x0..y1) without those that stand at one place of many pages.

    A book needs figures on at least four pages; places count on a grid of 8 points.
    """
    grid = lambda c: F.bround(F.col(c) / FIGURE_GRID)
    keyed = figures.withColumn("place", F.array(*[grid(c) for c in ("x0", "y0", "x1", "y1")]))
    pages = keyed.groupBy("book_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= FIGURE_PAGES)
    seen = keyed.groupBy("book_id", "place").agg(F.countDistinct("page").alias("n")).join(pages, "book_id")
    often = seen.where(F.col("n") >= F.greatest(F.lit(FIGURE_LEAST), F.floor(F.col("pages") * FIGURE_PART))).select("book_id", "place")
    return keyed.join(often, ["book_id", "place"], "left_anti").drop("place")


def reading_slots(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, slot): the pos of the first block of the page that starts at or below a figure's top, else one past the last."""
    f, b = figures.alias("f"), blocks.alias("b")
    joined = f.join(b, (F.col("f.book_id") == F.col("b.book_id")) & (F.col("f.page") == F.col("b.page")), "left")
    below = F.min(F.when(F.col("b.y0") >= F.col("f.y0"), F.col("b.pos")))
    return joined.groupBy(F.col("f.key").alias("key")).agg(F.coalesce(below, F.max("b.pos") + 1).alias("slot"))


def image_pages(pages: DataFrame) -> DataFrame:
    """Pages (book_id, page, area_share, chars, draws) that are one picture of themselves."""
    return pages.where((F.col("area_share") >= 0.85) & (F.col("chars") >= 200) & (F.col("draws") == 1)).select("book_id", "page")


def bounding_size(a: Column, b: Column, c: Column, d: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The size of a box of the given sides after an affine map."""
    return F.abs(a) * width + F.abs(c) * height, F.abs(b) * width + F.abs(d) * height


def render_pixels(width_pt: Column, height_pt: Column, dpi: int, ceiling: int = 400_000_000) -> Column:
    """Pixels of a page at a resolution, null above the ceiling."""
    n = F.bround(width_pt * dpi / 72) * F.bround(height_pt * dpi / 72)
    return F.when(n <= ceiling, n.cast("long"))


def first_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(owner, at, left_value, right_value): where two ordered lists (owner, pos, value) first differ; lists that agree have no row."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("pos"))
    a = left.select("owner", place.alias("at"), F.col("value").alias("left_value"))
    b = right.select("owner", place.alias("at"), F.col("value").alias("right_value"))
    differing = a.join(b, ["owner", "at"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    return differing.groupBy("owner").agg(F.min(F.struct("at", "left_value", "right_value")).alias("d")).select("owner", "d.*")


def inherited(styles: DataFrame, depth: int = 256) -> DataFrame:
    """(id, size, bold, problem): style properties along the chain of bases.

    ``styles`` has id, base, size, bold. The nearest explicit size counts; bold is
    a toggle, on if an odd number of the chain sets it. Cycles, chains beyond the
    depth and bases that do not exist are problems. Chains are walked together,
    one level a step, so the steps are as many as the longest chain.
    """
    walk = checkpoint(styles.select("id", F.col("base").alias("next"), "size", F.coalesce(F.col("bold").cast("int"), F.lit(0)).alias("toggles"), F.lit(None).cast("string").alias("problem")))
    base = styles.select(F.col("id").alias("next"), F.lit(True).alias("known"), F.col("base").alias("after"), F.col("size").alias("base_size"), F.coalesce(F.col("bold").cast("int"), F.lit(0)).alias("base_bold"))
    for _ in range(depth):
        if walk.where("next is not null and problem is null").limit(1).count() == 0:
            break
        j = walk.join(base, "next", "left")
        on = F.col("next").isNotNull() & F.col("problem").isNull()
        problem = F.when(on & F.col("known").isNull(), "dangling base").when(on & (F.col("next") == F.col("id")), "cycle").otherwise(F.col("problem"))
        go = on & F.col("known").isNotNull() & (F.col("next") != F.col("id"))
        walk = checkpoint(j.select(
            "id", F.when(go, F.col("after")).alias("next"), F.when(go, F.coalesce("size", "base_size")).otherwise(F.col("size")).alias("size"),
            (F.col("toggles") + F.when(go, F.col("base_bold")).otherwise(0)).alias("toggles"), problem.alias("problem"),
        ))
    problem = F.when(F.col("next").isNotNull() & F.col("problem").isNull(), "too deep").otherwise(F.col("problem"))
    return walk.select("id", "size", (F.col("toggles") % 2 == 1).alias("bold"), problem.alias("problem"))


def table_closure(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of tables (id, parent) that ``wanted`` (id) needs: the tables, all that hold them and all in them."""
    up = wanted.select("id").distinct()
    for seek, take in ((("id", "parent")), (("parent", "id"))):
        reached = checkpoint(up)
        while True:
            fresh = tables.join(reached.withColumnRenamed("id", seek), seek, "left_semi").select(F.col(take).alias("id")).where("id is not null").distinct()
            fresh = checkpoint(fresh.join(reached, "id", "left_anti"))
            if fresh.limit(1).count() == 0:
                break
            reached = checkpoint(reached.unionByName(fresh))
        up = reached
    return up
