"""Quality gates: DataFrames in, findings (severity, code, book_id, unit, detail) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.markup import emphasis_signature, spans_of
from leafmill.operators.blocks import OTHER_TYPES, TEXT_TYPES, is_blank, note_references, text_blocks

#: Most characters of a finding's detail.
DETAIL = 200
# Limits of the length gate, of copied runs and of duplicate targets.
LEAST_SOURCE, OMISSION, PADDING = 120, 0.55, 2.4
RUN = 40
DUPLICATE = 120


def finding(df: DataFrame, severity: str | Column, code: str | Column, unit: Column, detail: Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(as_column(severity).alias("severity"), as_column(code).alias("code"), "book_id", unit.alias("unit"), F.substring(detail, 1, DETAIL).alias("detail"))


def all_findings(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def summary(findings: DataFrame) -> DataFrame:
    """Findings per code, most frequent first by ``place``, with errors and warnings counted."""
    counts = findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")))


def shown_findings(findings: DataFrame, limit: int = 60) -> DataFrame:
    """The first ``limit`` findings of each book, errors first; a report's feature, not a cut of the data."""
    order = Window.partitionBy("book_id").orderBy(F.col("severity") != "error", "code", "unit", "detail")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def structure_gate(blocks: DataFrame) -> DataFrame:
    """Missing or repeated ids, unknown types, heading levels out of 1..6."""
    missing = finding(blocks.where(is_blank(F.col("id"))), "error", "missing-id", F.col("pos").cast("string"), F.col("type"))
    known = F.col("type").isin(TEXT_TYPES + OTHER_TYPES)
    unknown = finding(blocks.where(~F.coalesce(known, F.lit(False))), "error", "unknown-type", F.col("id"), F.coalesce("type", F.lit("")))
    level = blocks.where((F.col("type") == "heading") & ~F.coalesce(F.col("level").between(1, 6), F.lit(False)))
    levels = finding(level, "error", "heading-level", F.col("id"), F.coalesce(F.col("level").cast("string"), F.lit("none")))
    repeated = blocks.where(~is_blank(F.col("id"))).groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return all_findings(missing, unknown, levels, finding(repeated, "error", "duplicate-id", F.col("id"), F.col("n").cast("string")))


def coverage_gate(units: DataFrame) -> DataFrame:
    """Units with a source and no target."""
    code = F.when(F.col("part") == "note", "untranslated-note").when(F.col("part") == "caption", "untranslated-alt").otherwise("untranslated-block")
    waiting = units.where(~is_blank(F.col("source")) & is_blank(F.col("target")))
    return finding(waiting, "error", code, F.col("id"), F.col("source"))


def length_gate(blocks: DataFrame) -> DataFrame:
    """Targets much shorter or longer than a source of at least 120 characters."""
    both = blocks.where(~is_blank(F.col("target")) & (F.length("text") >= LEAST_SOURCE))
    ratio = F.length("target") / F.length("text")
    odd = both.withColumn("ratio", ratio).where((F.col("ratio") < OMISSION) | (F.col("ratio") > PADDING))
    short = F.col("ratio") < OMISSION
    return finding(odd, F.when(short, "error").otherwise("warning"), F.when(short, "possible-omission").otherwise("possible-padding"), F.col("id"), F.concat_ws("/", F.length("target"), F.length("text")))


def duplicate_gate(blocks: DataFrame) -> DataFrame:
    """Long targets that an earlier block of the book has already, under another source."""
    long = blocks.where(F.length("target") > DUPLICATE)
    order = Window.partitionBy("book_id", "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = long.withColumn("first_id", F.first("id").over(order)).withColumn("first_text", F.first("text").over(order))
    later = first.where((F.col("id") != F.col("first_id")) & ~F.col("text").eqNullSafe(F.col("first_text")))
    return finding(later, "error", "duplicate-translation", F.col("id"), F.col("first_id"))


def copied_run(source: Column, target: Column, run: int = RUN) -> Column:
    """The first run of the source that stands in the target and has a letter; null if none does."""
    # a run that is copied holds a whole aligned piece of half its length, so few texts need all their runs
    half = run // 2
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(source) / half).cast("int") - 1), lambda i: F.substring(source, i * half + 1, F.lit(half)))
    hopeful = F.exists(pieces, lambda x: F.contains(target, x))
    starts = F.sequence(F.lit(1), F.length(source) - run + 1)
    runs = F.transform(starts, lambda i: F.substring(source, i, F.lit(run)))
    found = F.filter(runs, lambda x: x.rlike(r"\p{L}") & F.contains(target, x))
    return F.when((F.length(source) >= run) & (F.length(target) >= run), F.when(hopeful, F.get(found, F.lit(0))))


def copied_gate(blocks: DataFrame) -> DataFrame:
    """Targets that hold a run of their source unchanged."""
    found = text_blocks(blocks).where("text is not null and target is not null").withColumn("run", copied_run(F.col("text"), F.col("target")))
    return finding(found.where("run is not null"), "warning", "copied-source-run", F.col("id"), F.col("run"))


def _translated(blocks: DataFrame) -> DataFrame:
    return text_blocks(blocks).where(~is_blank(F.col("target")) & ~is_blank(F.col("text")))


def marker_gate(blocks: DataFrame) -> DataFrame:
    """Note markers and code spans that a translation lost or invented."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(F.regexp_replace(c, "`[^`]*`", ""), F.lit(r"\[\[fn:([A-Za-z0-9_-]+)\]\]"), 1))
    code = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("`([^`]*)`"), 1))
    b = _translated(blocks).withColumn("s", marks("text")).withColumn("t", marks("target"))
    b = b.withColumn("sv", code("text")).withColumn("tv", code("target"))
    lost, made = F.array_except("s", "t"), F.array_except("t", "s")
    return all_findings(
        finding(b.where(F.size(lost) > 0), "error", "footnote-marker-lost", F.col("id"), F.array_join(lost, ",")),
        finding(b.where(F.size(made) > 0), "error", "footnote-marker-invented", F.col("id"), F.array_join(made, ",")),
        finding(b.where(F.col("sv") != F.col("tv")), "error", "verbatim-content-changed", F.col("id"), F.array_join("sv", ",")),
    )


def emphasis_gate(blocks: DataFrame) -> DataFrame:
    """Emphasis that differs in number between a text and its translation; only texts with marks are parsed."""
    marked = _translated(blocks).where(F.col("text").rlike("[*`]") | F.col("target").rlike("[*`]"))
    styled = lambda x: F.struct((x["bold"] & ~x["verbatim"]).alias("bold"), (x["italic"] & ~x["verbatim"]).alias("italic"), x["verbatim"].alias("verbatim"))
    for side, column in (("se", "text"), ("te", "target")):
        counted = F.transform(F.filter("spans", lambda x: x["footnote"].isNull()), styled)
        marked = spans_of(marked, column).withColumn(side, emphasis_signature(counted)).drop("spans")
    shown = lambda e: F.concat(F.lit("("), F.concat_ws(", ", *[F.col(f"{e}.{k}") for k in ("bold", "italic", "verbatim")]), F.lit(")"))
    return finding(marked.where("se <> te"), "warning", "emphasis-parity", F.col("id"), F.concat(shown("se"), F.lit(" -> "), shown("te")))


def parity_gate(blocks: DataFrame) -> DataFrame:
    """What a translation must keep: note markers, code spans, and the number of emphasised spans."""
    return all_findings(emphasis_gate(blocks), marker_gate(blocks))


def asset_gate(images: DataFrame, assets: DataFrame) -> DataFrame:
    """Pictures (book_id, id, asset, sha256) that are not among the ``assets`` (path, sha256) or have changed; a null hash expects none."""
    held = assets.groupBy(F.col("path").alias("asset")).agg(F.max("sha256").alias("now"), F.lit(True).alias("held"))
    joined = images.join(held, "asset", "left")
    modified = joined.where(F.col("held") & F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("now")))
    return all_findings(
        finding(joined.where("held is null"), "error", "asset-missing", F.col("id"), F.col("asset")),
        finding(modified, "error", "asset-modified", F.col("id"), F.concat("asset", F.lit(" no longer matches its extraction hash"))),
    )


def geometry_gate(sources: DataFrame) -> DataFrame:
    """What of a source's look was lost: emphasis that could not be read, pages of several sizes, rotated pages.

    ``sources`` has book_id, recovered, reason, width, height, variants
    (array of width, height, n, most pages first) and rotated (array of pages).
    """
    size = lambda w, h: F.concat(F.round(w).cast("int").cast("string"), F.lit("x"), F.round(h).cast("int").cast("string"), F.lit("pt"))
    shapes = F.array_join(F.transform(F.slice("variants", 1, 4), lambda v: F.concat(size(v["width"], v["height"]), F.lit(" on "), v["n"].cast("string"), F.lit(" page(s)"))), ", ")
    mixed = sources.where(F.size("variants") > 1)
    built = F.concat(F.lit("several sizes: "), shapes, F.lit("; built at "), size(F.col("width"), F.col("height")))
    turned = mixed.where(F.size("rotated") > 0)
    return all_findings(
        finding(sources.where(~F.coalesce("recovered", F.lit(True))), "warning", "emphasis-unrecoverable", F.lit("source"), F.coalesce("reason", F.lit("the source's emphasis could not be read"))),
        finding(mixed, "warning", "page-geometry-mixed", F.lit("source"), built),
        finding(turned, "warning", "page-rotated", F.lit("source"), F.array_join(F.slice("rotated", 1, 8), ",")),
    )


def note_gate(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """The note graph: undefined, repeated, empty, unreferenced, wrongly anchored and untranslated notes."""
    refs = note_references(text_blocks(blocks), "text")
    defined = notes.select("book_id", F.col("id").alias("note_id"))
    undefined = refs.join(defined, ["book_id", "note_id"], "left_anti")
    repeated = refs.groupBy("book_id", "note_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    used = refs.select("book_id", F.col("note_id").alias("id")).distinct()
    bare = notes.join(used, ["book_id", "id"], "left_semi").where(is_blank(F.col("text")) & is_blank(F.col("target")))
    unused = notes.join(used, ["book_id", "id"], "left_anti")
    anchors = refs.select("book_id", F.col("note_id").alias("id"), F.col("block_id").alias("anchor_block"))
    astray = notes.join(used, ["book_id", "id"], "left_semi").join(anchors, ["book_id", "id", "anchor_block"], "left_anti")
    waiting = notes.where(~is_blank(F.col("text")) & is_blank(F.col("target")))
    anchor = F.coalesce("anchor_block", F.lit(""))
    return all_findings(
        finding(undefined, "error", "footnote-undefined", F.col("block_id"), F.col("note_id")),
        finding(repeated, "error", "footnote-multiple-anchors", F.col("note_id"), F.col("n").cast("string")),
        finding(bare, "error", "footnote-body-empty", F.col("id"), anchor),
        finding(unused, "warning", "footnote-unreferenced", F.col("id"), anchor),
        finding(astray, "error", "footnote-anchor-mismatch", F.col("id"), anchor),
        finding(waiting, "error", "footnote-untranslated", F.col("id"), F.col("text")),
    )


def typography_gate(blocks: DataFrame) -> DataFrame:
    """What a typography pass leaves in Persian targets: Arabic forms, odd quotes, doubled marks, collisions of scripts."""
    t = text_blocks(blocks).where(~is_blank(F.col("target"))).withColumn("plain", F.regexp_replace("target", "`[^`]*`", ""))
    letter = r"ء-غف-يٮ-ۓۺ-ۿ"
    count = lambda mark: F.length("plain") - F.length(F.replace("plain", F.lit(mark), F.lit("")))
    checks = [
        ("arabic-forms", F.col("plain").rlike(r"[يكىـ٠-٩]")),
        ("guillemets", count("«") != count("»")),
        ("latin-quotes", F.col("plain").rlike("[\"“”]")),
        ("double-punctuation", F.col("plain").rlike(r"[،؛؟!]{2,}|،،|\.{2}$")),
        ("script-collision", F.col("plain").rlike(f"[{letter}][A-Za-z]|[A-Za-z][{letter}]")),
    ]
    codes = F.filter(F.array(*[F.when(test, code) for code, test in checks]), lambda x: x.isNotNull())
    return finding(t.select("book_id", "id", F.explode(codes).alias("found")), "warning", F.col("found"), F.col("id"), F.lit(""))
