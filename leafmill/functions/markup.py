"""Inline markup: emphasis by asterisks, code by backticks, note tokens, and backslash escapes.

A text is scanned once, from left to right, into spans (text, bold, italic,
verbatim, footnote). Everything else about markup is a question to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

SPANS = ArrayType(StructType([
    StructField("text", StringType()), StructField("bold", BooleanType()), StructField("italic", BooleanType()),
    StructField("verbatim", BooleanType()), StructField("footnote", StringType()),
]))

# A note token, and characters that carry no meaning in prose with their replacement.
NOTE = re.compile(r"\[\[fn:(fn\d{4,})\]\]")
INVISIBLE = {0xFEFF: None, 0x200B: None, 0x200D: None, 0x00AD: None, 0x0640: None, 0x00A0: " "}
_STYLES = {"***": (True, True), "**": (True, False), "*": (False, True)}


class Span(NamedTuple):
    text: str
    bold: bool = False
    italic: bool = False
    verbatim: bool = False
    footnote: str | None = None


def _closing(text: str, start: int, fence: str) -> int:
    """Where emphasis opened by ``fence`` before ``start`` closes: at the next one, with no other asterisk between; -1 if nowhere."""
    k = start
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text[k] == "*":
            return k if k > start and text.startswith(fence, k) else -1
        else:
            k += 1
    return -1


def parse(text: str, bold: bool = False, italic: bool = False) -> list[Span]:
    """The spans of a text; malformed markup is text."""
    spans: list[Span] = []
    plain: list[str] = []

    def flush() -> None:
        if plain:
            spans.append(Span("".join(plain), bold, italic))
            plain.clear()

    k = 0
    while k < len(text):
        c = text[k]
        if c == "\\" and text[k + 1 : k + 2] in ("\\", "*", "`"):
            plain.append(text[k + 1])
            k += 2
            continue
        if c == "[" and (note := NOTE.match(text, k)):
            flush()
            spans.append(Span("", bold, italic, False, note.group(1)))
            k = note.end()
            continue
        if c == "`" and (end := text.find("`", k + 1)) >= 0:
            flush()
            spans.append(Span(text[k + 1 : end], bold, italic, True))
            k = end + 1
            continue
        if c == "*":
            for fence, (b, i) in _STYLES.items():
                if text.startswith(fence, k) and (end := _closing(text, k + len(fence), fence)) > 0:
                    flush()
                    spans += parse(text[k + len(fence) : end], bold or b, italic or i)
                    k = end + len(fence)
                    break
            else:
                plain.append(c)
                k += 1
            continue
        plain.append(c)
        k += 1
    flush()
    return spans


def escape(text: str) -> str:
    return re.sub(r"([\\*`])", r"\\\1", text)


def render(spans: list[Span]) -> str:
    """Markup that parses to the same spans; like spans side by side are one, emphasis hugs what is visible."""
    merged: list[Span] = []
    for s in spans:
        if merged and not s.footnote and not merged[-1].footnote and s[1:4] == merged[-1][1:4]:
            merged[-1] = merged[-1]._replace(text=merged[-1].text + s.text)
        else:
            merged.append(s)
    out = []
    for s in merged:
        body = f"[[fn:{s.footnote}]]" if s.footnote else f"`{s.text}`" if s.verbatim else escape(s.text.strip())
        fence = "*" * (2 * s.bold + s.italic)
        lead, trail = ("", "") if s.footnote or s.verbatim else (s.text[: len(s.text) - len(s.text.lstrip())], s.text[len(s.text.rstrip()) :])
        out.append(f"{lead}{fence}{body}{fence}{trail}" if body else s.text)
    return "".join(out)


def plain(text: str) -> str:
    return "".join(s.text for s in parse(text))


def prose(text: str) -> str:
    """The text without code."""
    return "".join(s.text for s in parse(text) if not s.verbatim)


def normalised(text: str) -> str:
    """Prose without invisible characters and doubled blanks; code stays as it is."""
    pieces = re.split(r"(`[^`]*`)", text)
    pieces[::2] = [re.sub(r"[ \t]{2,}", " ", p.translate(INVISIBLE)) for p in pieces[::2]]
    return "".join(pieces).strip(" \t")


def by_text(function: Callable[[str], object], kind: object) -> Callable[[Column], Column]:
    """An Arrow-batched function of one text column; null stays null."""

    def apply(column: Column) -> Column:
        @F.pandas_udf(kind)
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([None if t is None else function(t) for t in texts], dtype=object)

        return udf(column)

    return apply


spans = by_text(lambda t: [tuple(s) for s in parse(t)], SPANS)
plain_text = by_text(plain, StringType())
prose_text = by_text(prose, StringType())
normalised_source = by_text(normalised, StringType())


def spans_of(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``spans`` of a column, parsed once for every question about it."""
    return df.withColumn("spans", spans(F.col(column)))


def plain_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: s["text"]), "")


def verbatim_of(spans_: Column) -> Column:
    return F.transform(F.filter(spans_, lambda s: s["verbatim"]), lambda s: s["text"])


def notes_of(spans_: Column) -> Column:
    return F.transform(F.filter(spans_, lambda s: s["footnote"].isNotNull()), lambda s: s["footnote"])


def emphasis_signature(spans_: Column) -> Column:
    """(bold, italic, verbatim): how many spans of each style."""
    zero = F.struct(*[F.lit(0).alias(k) for k in ("bold", "italic", "verbatim")])
    step = lambda acc, s: F.struct(*[(acc[k] + s[k].cast("int")).alias(k) for k in ("bold", "italic", "verbatim")])
    return F.aggregate(spans_, zero, step)
