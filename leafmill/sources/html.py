"""HTML to typed blocks, in one walk over the document."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from leafmill.functions.markup import Span, by_text, render

BLOCKS = ArrayType(StructType([
    StructField("type", StringType()), StructField("level", IntegerType()), StructField("ordered", BooleanType()), StructField("text", StringType()),
]))

# Tags by what they mean.
SKIPPED = set("script style head nav template".split())
DROPPED = SKIPPED | set("form button".split())
REFUSED = set("table iframe object video audio svg canvas embed math".split())
BOLD, ITALIC, CODE = set("b strong".split()), set("i em cite dfn".split()), set("code kbd samp tt pre".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
MAX_DEPTH = 200


class _Walk(HTMLParser):
    def __init__(self, skipped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.stack, self.blocks, self.spans = skipped, [], [], []
        self.kind: tuple[str, int | None, bool | None] = ("paragraph", None, None)
        self.refusal, self.hidden = "", 0

    def flush(self) -> None:
        text = render(self.spans)
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()
        if text:
            self.blocks.append((*self.kind, text))
        elif self.spans and self.kind[0] == "paragraph":
            self.blocks.append(("layout", None, None, ""))
        self.spans, self.kind = [], ("paragraph", None, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in REFUSED and not self.hidden:
            self.refusal = self.refusal or f"unsupported {tag}"
        if tag not in VOID:
            self.stack.append(tag)
            if len(self.stack) > MAX_DEPTH:
                self.refusal = self.refusal or "nested too deeply"
            if self.hidden or tag in self.skipped or "hidden" in given or given.get("aria-hidden") == "true":
                self.hidden += 1
                return
        if self.hidden:
            return
        if tag == "br":
            self.spans.append(Span("\n"))
        elif tag == "rt":
            self.spans.append(Span(" ("))
        elif tag in ("hr", "img"):
            self.flush()
            self.blocks.append(("separator", None, None, "") if tag == "hr" else ("image", None, None, given.get("alt") or ""))
        elif re.fullmatch(r"h[1-6]|p|li|blockquote|figcaption|div|section|article|ul|ol|pre", tag):
            self.flush()
            if re.fullmatch("h[1-6]", tag):
                self.kind = ("heading", int(tag[1]), None)
            elif tag == "li":
                lists = [t for t in self.stack if t in ("ul", "ol")]
                self.kind = ("listitem", max(1, self.stack.count("li")), bool(lists) and lists[-1] == "ol")
            elif tag in ("blockquote", "figcaption"):
                self.kind = ("blockquote" if tag == "blockquote" else "caption", None, None)
            elif tag == "p" and "blockquote" in self.stack:
                self.kind = ("blockquote", None, None)
            if tag == "p":
                self.spans.append(Span(""))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if self.hidden:
                self.hidden -= 1
            elif top == "rt":
                self.spans.append(Span(")"))
            elif re.fullmatch(r"h[1-6]|p|li|blockquote|figcaption|div|section|article|pre", top):
                self.flush()
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.hidden or "rp" in self.stack[-1:]:
            return
        styles = set(self.stack)
        text = data if styles & {"pre"} else re.sub(r"\s+", " ", data)
        self.spans.append(Span(text, bool(styles & BOLD), bool(styles & ITALIC), bool(styles & CODE) and bool(text.strip())))


def blocks_of(html: str) -> list[tuple]:
    """(type, level, ordered, text) in document order; scripts, styles and navigation are skipped."""
    walk = _Walk(SKIPPED)
    walk.feed(html)
    walk.close()
    walk.flush()
    return walk.blocks


def chapter_of(html: str, title: str | None = None) -> tuple[list[tuple], str]:
    """The blocks of a chapter's page and why it is refused, if it is; a chapter without a heading gets its title as one."""
    walk = _Walk(DROPPED)
    walk.feed(html)
    walk.close()
    walk.flush()
    blocks = [b for b in walk.blocks if b[0] != "layout"]
    if not walk.refusal and not any(b[3].strip() for b in blocks):
        return [], "no narrative"
    if title and not any(b[0] == "heading" for b in blocks):
        blocks.insert(0, ("heading", 1, None, title))
    return ([], walk.refusal) if walk.refusal else (blocks, "")


html_blocks = by_text(blocks_of, BLOCKS)
chapter_blocks = by_text(chapter_of, StructType([StructField("blocks", BLOCKS), StructField("refusal", StringType())]))
