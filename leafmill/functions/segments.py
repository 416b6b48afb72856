"""Cutting texts reversibly, packing units into jobs, and reading what comes back."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from leafmill.functions.markup import by_text
from leafmill.operators.ranges import cut_in_ranges

# Ends of sentences without a space behind, what a cut may not divide, and characters that no cut may precede.
CJK_ENDS = "。！？｡"
WHOLE = re.compile(r"(?:https?://|www\.)\S+|\[\[fn:[^\]]*\]\]|`[^`]*`|\*{1,3}(?=\S)(?:[^*\\]|\\.)+?\*{1,3}|\\.")
HEADER = re.compile(r"^@@ +(\S+) +<([^>]*)>\s*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
SIGILS = {"??": "question", "++": "edit", "!!": "finding"}


def boundaries(text: str) -> list[int]:
    """Places where a text may be cut: behind white space and CJK sentence ends, never inside a literal or before a joiner."""
    inside = set()
    for found in WHOLE.finditer(text):
        inside.update(range(found.start() + 1, found.end()))
    places = [m.end() for m in re.finditer(rf"\s+|[{CJK_ENDS}](?!\s)", text)]
    return [k for k in places if k not in inside and k < len(text) and not (text[k] in "‌‍" or "̀" <= text[k] <= "ͯ")]


def cut(text: str, budget: int) -> list[str]:
    """Pieces that join to the text: each the longest within ``budget``, or up to the next place if none is."""
    pieces, start = [], 0
    places = [*boundaries(text), len(text)]
    k = 0
    while start < len(text):
        while k < len(places) and places[k] <= start:
            k += 1
        end = k
        while end + 1 < len(places) and places[end + 1] <= start + budget:
            end += 1
        pieces.append(text[start : places[end]])
        start = places[end]
    return pieces


def packed_jobs(costs: list[int], budget: int) -> list[int]:
    """The job of each unit in order: consecutive units while they fit; one too large is alone."""
    jobs, job, size = [], 0, 0
    for cost in costs:
        if size and size + cost > budget:
            job, size = job + 1, 0
        jobs.append(job)
        size += cost
    return jobs


def pack(units: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """(by, order, job_no): the same packing folded over ranges of narrow rows, so that a group may be as large as the table."""
    def rule(size: int, prose: bool, held: bool, cost_: int, opens: bool, own: bool) -> tuple[bool, bool]:
        return size > 0 and size + cost_ > budget, False

    narrow = units.select(F.col(by).alias("by"), F.col(order).alias("pos"), F.lit("").alias("id"), F.col(cost).alias("cost"), F.lit(False).alias("opens"), F.lit(False).alias("prose"))
    return cut_in_ranges(narrow, rule).select(F.col("by").alias(by), F.col("pos").alias(order), (F.col("no") - 1).alias("job_no"))


REPLY = ArrayType(StructType([StructField("unit", StringType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("problem", StringType())]))


def parse_reply(text: str) -> list[tuple[str, str, str, str | None]]:
    """(unit, kind, text, problem) of a reply in worksheet form; an outer fence is taken off, a backslash hides a header."""
    lines = [line for line in text.split("\n") if not re.match(r"^<!--.*-->\s*$", line)]
    opened = next((k for k, line in enumerate(lines) if line.strip()), None)
    problem = None
    if opened is not None and (fence := FENCE.match(lines[opened])):
        mark = fence.group(1)
        close = next((k for k in range(len(lines) - 1, opened, -1) if re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[k])), None)
        problem = None if close is not None else "unclosed fence"
        lines = lines[opened + 1 : close if close is not None else len(lines)]
    records: list[list] = []
    for line in lines:
        if header := HEADER.match(line):
            records.append([header.group(1), header.group(2), [], problem])
        elif records:
            records[-1][2].append(line[1:] if re.match(r"^\\+(@@ |`{3}|~{3}|<!--)", line) else line)
        elif line.strip():
            records.append(["", "", [line], "text before the first header"])
    seen: set[str] = set()
    out = []
    for unit, kind, body, trouble in records:
        trouble = trouble or ("answered twice" if unit in seen else None) or (None if "\n".join(body).strip() else "empty")
        seen.add(unit)
        out.append((unit, kind, "\n".join(body).strip("\n"), trouble))
    return out


def escape_payload(text: str) -> str:
    """A body whose lines cannot be taken for headers, fences or comments; one layer."""
    return "\n".join("\\" + line if re.match(r"^\\*(@@ |`{3}|~{3}|<!--)", line) else line for line in text.split("\n"))


def parse_records(text: str) -> list[tuple[str, str, str, str | None]]:
    """(unit, kind, text, problem) of a review: lines ``?? id rubric``, ``++ id`` or ``!! id rubric`` with the body below."""
    out: list[list] = []
    for line in text.split("\n"):
        sigil, _, rest = line.partition(" ")
        if sigil in SIGILS and rest.strip():
            unit, _, rubric = rest.strip().partition(" ")
            out.append([unit, f"{SIGILS[sigil]} {rubric.strip()}".strip(), [], None])
        elif out:
            out[-1][2].append(line[1:] if line.startswith("\\") and line[1:3] in SIGILS else line)
        elif line.strip():
            out.append(["", "", [line], "text before the first record"])
    return [(u, k, "\n".join(b).strip(), p or (None if "\n".join(b).strip() else "empty")) for u, k, b, p in out]


def by_script(text: str) -> list[tuple[str, bool]]:
    """(chunk, is_latin): runs of Latin and of other letters; what is neither stays with the run before it."""
    chunks: list[list] = []
    for c in text:
        latin = bool(re.match(r"[A-Za-zÀ-ɏ0-9]", c)) if c.isalnum() else None
        if chunks and (latin is None or chunks[-1][1] in (None, latin)):
            chunks[-1][0] += c
            chunks[-1][1] = latin if chunks[-1][1] is None else chunks[-1][1]
        else:
            chunks.append([c, latin])
    return [(c, bool(latin)) for c, latin in chunks]


def reply_verdict(expected: dict[str, str], records: list[tuple[str, str, str, str | None]] | None) -> str:
    """missing, empty, nothing-to-translate, malformed, invalid, partial or answered; the first that holds."""
    if records is None:
        return "missing"
    if not records:
        return "nothing-to-translate" if not expected else "empty"
    if any(p and p != "empty" for *_, p in records):
        return "malformed"
    if any(unit not in expected or expected[unit] != kind for unit, kind, _, _ in records):
        return "invalid"
    answered = {unit for unit, _, text, _ in records if text.strip()}
    return "answered" if answered == set(expected) else "partial" if answered else "empty"


replies = by_text(parse_reply, REPLY)
review_records = by_text(parse_records, REPLY)
script_runs = by_text(by_script, ArrayType(StructType([StructField("chunk", StringType()), StructField("latin", BooleanType())])))


def pieces_of(budget: int) -> Callable:
    return by_text(lambda t: cut(t, budget), ArrayType(StringType()))


def piece_count(budget: int) -> Callable:
    return by_text(lambda t: len(cut(t, budget)), IntegerType())
