"""Files into tables: books as JSON, EPUB archives, Markdown, layout JSON, TSV tables, and guards before they are read."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.sources.html import blocks_of

# Limits of archives, and the schema of a book file.
MAX_MEMBERS, MAX_BYTES, MAX_RATIO, RATIO_FROM = 20_000, 2 << 30, 400, 8 << 20
BOOK = """schema string, source struct<path:string,sha256:string,format:string,pages:int>,
meta struct<title:string,title_target:string,author:string,author_target:string,lang_source:string,lang_target:string>,
blocks array<struct<id:string,type:string,level:int,text:string,target:string,page:int,bbox:array<double>>>,
footnotes array<struct<id:string,anchor_block:string,origin:string,text:string,target:string>>"""


def file_format(path: Column, content: Column) -> Column:
    """pdf, epub, docx or zip, by suffix, else by the first bytes; null is refused."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    magic = F.substring(content, 1, 4)
    return F.when(suffix.isin("pdf", "epub", "docx"), suffix).when(magic == F.encode(F.lit("%PDF"), "utf-8"), "pdf").when(F.substring(content, 1, 2) == F.encode(F.lit("PK"), "utf-8"), "zip")


def pixel_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, blocks and notes of book files in JSON; files that do not parse come as books with their text in ``refused``."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = text.withColumn("b", F.from_json("value", BOOK))
    good = parsed.where("b.schema is not null")
    books = parsed.select("file", "b.source", "b.meta", F.when(F.col("b.schema").isNull(), F.col("value")).alias("refused"))
    blocks = good.select("file", F.posexplode("b.blocks").alias("pos", "x")).select("file", "pos", "x.*")
    notes = good.select("file", F.explode("b.footnotes").alias("x")).select("file", "x.*")
    return books, blocks, notes


def archive_problems(members: DataFrame) -> DataFrame:
    """(archive, problem) of members (archive, name, size, packed): too many, too large, packed too well, or outside."""
    totals = members.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    many = totals.where(F.col("n") > MAX_MEMBERS).select("archive", F.lit("too many members").alias("problem"))
    large = totals.where(F.col("bytes") > MAX_BYTES).select("archive", F.lit("too large").alias("problem"))
    dense = members.where((F.col("size") > RATIO_FROM) & (F.col("size") > MAX_RATIO * F.greatest(F.col("packed"), F.lit(1)))).select("archive", F.lit("packed too well").alias("problem"))
    outside = members.where(F.col("name").startswith("/") | F.col("name").rlike(r"(^|/)\.\.(/|$)|\\")).select("archive", F.lit("outside").alias("problem"))
    return many.unionByName(large).unionByName(dense).unionByName(outside).distinct()


def _epub(data: bytes) -> Iterator[tuple]:
    """(page, pos, type, level, ordered, text) of a book's spine; raises ValueError for what it refuses."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    infos = archive.infolist()
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_BYTES:
        raise ValueError("too large")
    tag = lambda e: e.tag.rpartition("}")[2]
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if tag(e) == "rootfile")
    package = ElementTree.fromstring(archive.read(opf))
    items = {e.get("id"): e for e in package.iter() if tag(e) == "item"}
    spine = [e.get("idref") for e in package.iter() if tag(e) == "itemref" and e.get("linear") != "no"]
    if len(set(spine)) < len(spine):
        raise ValueError("a document twice in the spine")
    pos = 0
    for page, ref in enumerate(spine, 1):
        if ref not in items or items[ref].get("media-type") not in ("application/xhtml+xml", "text/html"):
            raise ValueError("unsupported spine item")
        name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref].get("href")))
        if name.startswith("../"):
            raise ValueError("a member outside")
        if page > 1:
            yield page, pos, "pagebreak", None, None, ""
            pos += 1
        for block in blocks_of(archive.read(name).decode("utf-8", "replace")):
            yield (page, pos, *block)
            pos += 1


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, pos, type, level, ordered, text, refusal): blocks of EPUB files, a row with the refusal for those refused."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    found = [(name, *row, None) for row in _epub(content)]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    found = [(name, 0, 0, None, None, None, None, str(error) or type(error).__name__)]
                yield pd.DataFrame(found, columns=["file", "page", "pos", "type", "level", "ordered", "text", "refusal"]).astype({"level": "Int32", "ordered": "boolean"})

    return files.mapInPandas(rows, "file string, page int, pos int, type string, level int, ordered boolean, text string, refusal string")


def markdown_blocks(lines: DataFrame) -> DataFrame:
    """(doc, pos, type, level, text) of lines (doc, n, line): a state machine as islands of lines in windows.

    Blank lines, headings, list items, images and rules end a paragraph; a quote
    mark is dropped and its line belongs to the paragraph it stands in.
    """
    order = Window.partitionBy("doc").orderBy("n")
    bare = F.trim(F.regexp_replace("line", r"^\s*>\s?", ""))
    kind = (
        F.when(bare == "", "blank").when(bare.rlike(r"^#{1,6}\s"), "heading").when(bare.rlike(r"^(?:[-*+]|\d+[.)])\s"), "listitem")
        .when(bare.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image").when(bare.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$"), "separator").otherwise("paragraph")
    )
    typed = lines.select("doc", "n", bare.alias("bare"), kind.alias("type"))
    opens = (F.col("type") != "paragraph") | (F.coalesce(F.lag("type").over(order), F.lit("blank")) != "paragraph")
    numbered = typed.withColumn("opens", opens.cast("int"))
    numbered = numbered.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("type <> 'blank'")
    text = F.regexp_replace("bare", r"^(?:#{1,6}|[-*+]|\d+[.)])\s+", "")
    shown = F.when(F.col("type").isin("heading", "listitem"), text).when(F.col("type") == "image", F.regexp_extract("bare", r"^!\[([^\]]*)\]", 1)).when(F.col("type") == "separator", "").otherwise(F.col("bare"))
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("bare", "^(#+)", 1)))
    pieces = F.array_sort(F.collect_list(F.struct("n", shown.alias("t"))))
    return numbered.groupBy("doc", "island").agg(
        F.min("n").alias("pos"), F.min("type").alias("type"), F.min(level).alias("level"), F.array_join(F.transform(pieces, lambda x: x["t"]), " ").alias("text")
    ).drop("island")


def layout_blocks(items: DataFrame) -> DataFrame:
    """(doc, pos, type, level, text, page) of layout-tool items (doc, n, type, text, text_level, page_idx, captions), with page breaks between pages."""
    order = Window.partitionBy("doc").orderBy("n")
    kind = F.when((F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) > 0), "heading").when(F.col("type") == "text", "paragraph").when(F.col("type") == "equation", "paragraph").otherwise(F.col("type"))
    level = F.when(F.col("text_level") > 0, F.least("text_level", F.lit(6)))
    base = items.select("doc", "n", kind.alias("type"), level.alias("level"), "text", (F.col("page_idx") + 1).alias("page"), "captions", F.lag("page_idx").over(order).alias("before"), "page_idx")
    own = base.select("doc", F.col("n").alias("major"), F.lit(1).alias("minor"), "type", "level", "text", "page")
    captions = base.select("doc", F.col("n").alias("major"), F.posexplode("captions").alias("k", "text"), "page").select("doc", "major", (F.col("k") + 2).alias("minor"), F.lit("caption").alias("type"), F.lit(None).cast("int").alias("level"), "text", "page")
    breaks = base.where("before <> page_idx").select("doc", F.col("n").alias("major"), F.lit(0).alias("minor"), F.lit("pagebreak").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), "page")
    every = own.unionByName(captions).unionByName(breaks)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("major", "minor"))).drop("major", "minor")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognition tables (TSV with a header, no quoting); rows that do not fit are dropped."""
    raw = spark.read.csv(path, sep="\t", quote="", header=True)
    number = lambda c, kind: F.col(c).try_cast(kind).alias(c)
    ints = "level page_num block_num par_num line_num word_num left top width height".split()
    return raw.select(*[number(c, "int") for c in ints], number("conf", "double"), "text").where("level is not null")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, translation, note) of term banks: tab-separated, comments and incomplete lines left out."""
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").withColumn("c", cells)
    rows = lines.select(F.trim(F.get("c", F.lit(0))).alias("term"), F.trim(F.get("c", F.lit(1))).alias("translation"), F.trim(F.get("c", F.lit(2))).alias("note"))
    return rows.where("term <> '' and translation <> ''")


def manifest_problems(pages: DataFrame, roles: DataFrame) -> DataFrame:
    """(page, problem): pages without a role, roles without a page, roles given twice or unknown."""
    lost = pages.join(roles, "page", "left_anti").select("page", F.lit("no role").alias("problem"))
    extra = roles.join(pages, "page", "left_anti").select("page", F.lit("no page").alias("problem"))
    twice = roles.groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page", F.lit("twice").alias("problem"))
    unknown = roles.where(~F.coalesce(F.col("role").isin("text", "image", "blank"), F.lit(False))).select("page", F.lit("unknown role").alias("problem"))
    return lost.unionByName(extra).unionByName(twice).unionByName(unknown)
