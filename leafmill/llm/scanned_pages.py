"""Repair of text recognised from scanned pages.

Lines that are page furniture are told apart first. The words of all other lines
are counted per language, and words that recognition may confuse fall into one
class (their skeletons are equal). Each page is then one stream of words without
line breaks, decoded as a whole: a word stays, is read as the dominant word of its
class, is joined with the next one over a line end with or without its hyphen or over
a gap, or is divided into two, whichever path is likeliest by the counts of the whole
corpus. Damaged lines and the repaired text are both read off that path. Paragraph
boundaries are chosen by dynamic programming over the lines of a page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import checkpoint, small_or_shuffled, spread

#: A word gives way to one of its class that is so many times as frequent; a listed word counts that much more.
DOMINANT, LISTED = 5, 20
#: Costs of the channel: a word joined over a gap, divided in two, or left as a mix of letters and digits; and the count of unknown words.
JOINED, DIVIDED, MIXED, UNKNOWN = 4.0, 6.0, 20.0, 0.1

# Marks that divide a word at a line end.
HYPHENS = "-‐­¬"
# What recognition confuses, single characters first, then groups; lower case.
SINGLES = ("etosbläâ", "cf0561aa")
GROUPS = [("d", "c1"), ("h", "1i"), ("u", "ii"), ("w", "vv"), ("rn", "m"), ("in", "m")]

NUMBER = r"(?:[0-9lIOoSsB|]{1,3}(?:\s?[0-9lIOoSsB|]{1,3}){0,3}|[ivxlcdmIVXLCDM]{1,9})"
ALONE = rf"^[\s\[(\-–—·.•]*{NUMBER}[\s\])\-–—·.•]*$"
BEFORE, AFTER = rf"^\s*[\[(\-–—]?\s*{NUMBER}\s*[\])\-–—]?(?:\s*[·•|]\s*|\s{{2,}})(?=\S)", rf"(?<=\S)(?:\s*[·•|]\s*|\s{{2,}})[\[(\-–—]?\s*{NUMBER}\s*[\])\-–—]?\s*$"


def skeleton(word: Column) -> Column:
    """What words that recognition may confuse have in common."""
    out = F.translate(F.lower(word), *SINGLES)
    for group, into in GROUPS:
        out = F.replace(out, F.lit(group), F.lit(into))
    return out


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line: page, line_no, line, whether it is its page's first or last, and whether it is furniture.

    ``pages`` has page_key, book_id, page, text, lang, one row per page_key. A
    first or last line is furniture if it is a page number, or a title beside a
    page number, or a title that its book repeats; but the first appearance of a
    title that is followed by a blank line opens a chapter.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda x: x["line"].rlike(r"(?U)\S"))
    body = pages.where(F.col("text").isNotNull()).withColumn("ls", lines).where(F.size("ls") > 0)
    each = body.select("page_key", "book_id", "page", "lang", F.posexplode("ls").alias("at", "l"), F.size("ls").alias("n"), F.split("text", "\n").alias("raw"))
    each = each.select(
        "page_key", "book_id", "page", "lang", F.col("l.no").cast("int").alias("line_no"), F.col("l.line").alias("line"),
        (F.col("at") == 0).alias("first"), (F.col("at") == F.col("n") - 1).alias("last"),
        F.coalesce(F.trim(F.get("raw", F.col("l.no"))) == "", F.lit(False)).alias("blank_next"),
    )
    each = each.withColumn("number", (F.col("first") | F.col("last")) & F.col("line").rlike(ALONE) & F.col("line").rlike(r"[0-9lIOivxIVX]"))
    edge = F.col("line").rlike(BEFORE) | F.col("line").rlike(AFTER)
    title = F.trim(F.regexp_replace(F.regexp_replace("line", BEFORE, ""), AFTER, ""))
    each = each.withColumn("beside", F.col("first") & ~F.col("number") & edge & (F.length(title) > 3))
    each = checkpoint(each.withColumn("title", F.when(F.col("first") & ~F.col("number"), skeleton(F.regexp_replace(title, r"(?U)\s+", " ")))))
    heads = each.where("title is not null").groupBy("book_id", "title").agg(F.count(F.lit(1)).alias("times"), F.min("page").alias("opens"), F.max("beside").alias("numbered"))
    heads = checkpoint(heads.where("times > 1"))
    e, h = each.alias("e"), small_or_shuffled(heads).alias("h")
    joined = e.join(h, F.col("e.book_id").eqNullSafe(F.col("h.book_id")) & (F.col("e.title") == F.col("h.title")), "left")
    opening = ~F.col("e.beside") & F.col("e.blank_next") & (F.col("e.page") <= F.coalesce("h.opens", "e.page")) & F.col("e.line").rlike(r"\p{Ll}")
    repeated = F.col("e.first") & F.col("h.times").isNotNull() & ~opening
    shouted = F.col("e.first") & ~F.col("e.line").rlike(r"\p{Ll}") & (F.length(F.trim("e.line")) > 8) & ~F.col("e.blank_next")
    furniture = F.col("e.number") | F.col("e.beside") | repeated | shouted
    return joined.select("e.page_key", "e.book_id", "e.page", "e.lang", "e.line_no", "e.line", furniture.alias("furniture"), (F.col("e.first") & opening).alias("may_open"))


def _with_next(lines: DataFrame) -> DataFrame:
    """Body lines with the body line that follows, on the page or at the start of the next one, and whether one ends in a hyphen."""
    body = lines.where("not furniture")
    listed = body.groupBy("page_key", "book_id", "page", "lang").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    listed = checkpoint(listed)
    first = listed.select("book_id", (F.col("page") - 1).alias("page"), F.col("ls")[0].alias("over"), F.col("page_key").alias("over_key"))
    first = first.groupBy("book_id", "page").agg(F.min(F.struct("over_key", "over")).alias("o")).select("book_id", "page", "o.*")
    l, f = listed.alias("l"), first.alias("f")
    joined = l.join(f, F.col("l.book_id").eqNullSafe(F.col("f.book_id")) & (F.col("l.page") == F.col("f.page")), "left")
    each = joined.select("l.page_key", "l.book_id", "l.page", "l.lang", F.posexplode("l.ls").alias("at", "x"), "l.ls", "f.over", "f.over_key")
    following = F.coalesce(F.get("ls", F.col("at") + 1), F.col("over"))
    out = each.select(
        "page_key", "book_id", "page", "lang", F.col("x.line_no").alias("line_no"), F.col("x.line").alias("line"), following.alias("nl"),
        F.when(F.get("ls", F.col("at") + 1).isNotNull(), F.col("page_key")).otherwise(F.col("over_key")).alias("next_key"),
    )
    mark = F.regexp_extract("line", rf"[\p{{L}}\p{{Nd}}]([{HYPHENS}])\s*$", 1)
    part = F.regexp_extract("line", rf"([\p{{L}}\p{{Nd}}]+)[{HYPHENS}]\s*$", 1)
    rest = F.regexp_extract(F.col("nl.line"), r"^\s*([\p{L}\p{Nd}]+)", 1)
    out = out.withColumns({"mark": mark, "part": part, "rest": rest, "next_line": F.col("nl.line_no"), "nl_line": F.col("nl.line")}).drop("nl")
    return out.withColumn("divided", (F.col("mark") != "") & (F.col("rest") != ""))


def _words(lines: DataFrame) -> DataFrame:
    """(page_key, line_no, lang, word, compound) of the body, words in lower case, without the parts of divided words."""
    start = lines.where("divided").select(F.col("next_key").alias("page_key"), F.col("next_line").alias("line_no"), F.lit(True).alias("continues")).distinct()
    l = lines.join(start, ["page_key", "line_no"], "left")
    text = F.when(F.col("divided"), F.regexp_replace("line", rf"[\p{{L}}\p{{Nd}}]+[{HYPHENS}]\s*$", "")).otherwise(F.col("line"))
    text = F.when(F.col("continues"), F.regexp_replace(text, r"^\s*[\p{L}\p{Nd}]+", "")).otherwise(text)
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    compounds = F.regexp_extract_all(text, F.lit(r"([\p{L}]+-[\p{L}]+)"), 1)
    both = F.concat(words, compounds)
    return l.select("page_key", "line_no", "lang", F.explode(both).alias("word")).withColumn("word", F.lower("word"))


def lexicon(words: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(lang, word, n, listed, class, top, top_weight): every word with the dominant word of its class."""
    listed = wordlist.where("word is not null").select("lang", F.lower("word").alias("word")).distinct().withColumn("listed", F.lit(True))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    c, l = counted.alias("c"), listed.alias("l")
    known = c.join(l, F.col("c.lang").eqNullSafe(F.col("l.lang")) & (F.col("c.word") == F.col("l.word")), "full")
    known = known.select(F.coalesce("c.lang", "l.lang").alias("lang"), F.coalesce("c.word", "l.word").alias("word"), F.coalesce("c.n", F.lit(0)).alias("n"), F.coalesce("l.listed", F.lit(False)).alias("listed"))
    known = known.withColumn("class", skeleton(F.col("word"))).withColumn("weight", F.col("n") + F.when(F.col("listed"), LISTED).otherwise(0))
    known = checkpoint(known)
    plain = known.where(~F.col("word").rlike(r"[0-9]"))
    tops = plain.groupBy("lang", "class").agg(F.max(F.struct("weight", "word")).alias("t")).select("lang", "class", F.col("t.word").alias("top"), F.col("t.weight").alias("top_weight"))
    k, t = known.alias("k"), tops.alias("t")
    return checkpoint(k.join(t, F.col("k.lang").eqNullSafe(F.col("t.lang")) & (F.col("k.class") == F.col("t.class")), "left").select("k.*", "t.top", "t.top_weight"))


def misread_words(lexicon_: DataFrame) -> DataFrame:
    """(lang, word, fix): words that a far more frequent word of their class outweighs, or that mix letters and digits.

    ``fix`` is null where nothing tells what was meant.
    """
    numeric = F.col("word").rlike(r"^[0-9]+$")
    outweighed = (F.col("top") != F.col("word")) & (F.col("top_weight") >= DOMINANT * F.col("n"))
    number = F.col("word").rlike(r"^(?=.*[0-9])[0-9lioz]+$")
    mixed = F.col("word").rlike(r"[0-9]") & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^[0-9]+(?:st|nd|rd|th|e|er|ère|ème|te|ten)$")
    bad = ~F.col("listed") & ~numeric & (F.coalesce(outweighed, F.lit(False)) | mixed)
    digits = F.translate("word", "lioz", "1102")
    fix = F.when(F.coalesce(outweighed, F.lit(False)), F.col("top")).when(number, digits).when(mixed & (F.col("top_weight") > 0), F.col("top"))
    return lexicon_.where(bad).select("lang", "word", fix.alias("fix"))


def _divided_words(lines: DataFrame, lexicon_: DataFrame, size: int) -> DataFrame:
    """Words divided by a hyphen at a line end, with what is known of their joined and their hyphened form."""
    parts = lines.where("divided").select("page_key", "line_no", "next_key", "next_line", "lang", "mark", F.lower("part").alias("part"), F.lower("rest").alias("rest"))
    p = parts.withColumn("joined", F.concat("part", "rest")).withColumn("compound", F.concat("part", F.lit("-"), "rest"))
    p = p.withColumn("class_j", skeleton(F.col("joined"))).withColumn("class_c", skeleton(F.col("compound")))
    known = lexicon_.groupBy("lang", "class").agg(F.max("top_weight").alias("weight"), F.max("top").alias("top"))
    for name in ("j", "c"):
        k = known.select(F.col("lang").alias(f"lang_{name}"), F.col("class").alias(f"class_{name}"), F.col("weight").alias(f"weight_{name}"), F.col("top").alias(f"top_{name}"))
        p = p.alias("p").join(small_or_shuffled(k, size).alias("k"), F.col("p.lang").eqNullSafe(F.col(f"k.lang_{name}")) & (F.col(f"p.class_{name}") == F.col(f"k.class_{name}")), "left").select("p.*", f"k.weight_{name}", f"k.top_{name}")
    exact = small_or_shuffled(lexicon_.select(F.col("lang").alias("lang_x"), "word", "n", "listed"), size).alias("x")
    p = p.alias("p").join(exact, F.col("p.lang").eqNullSafe(F.col("x.lang_x")) & (F.col("p.joined") == F.col("x.word")), "left")
    return p.select("p.page_key", "p.line_no", "p.next_key", "p.next_line", "p.weight_j", "p.top_j", "p.weight_c", "x.n", F.coalesce("x.listed", F.lit(False)).alias("listed"))


def _neighbours(lines: DataFrame) -> DataFrame:
    """(page_key, lang, first, second): words with only white space between them, on a line or over a line's end."""
    after = F.regexp_extract("nl_line", r"^\s*([\p{L}\p{Nd}]+)", 1)
    at_end = F.regexp_extract("line", r"([\p{L}\p{Nd}]+)\s*$", 1)
    spaced = F.regexp_replace("line", r"\s+", " ")
    firsts = F.regexp_extract_all(spaced, F.lit(r"([\p{L}\p{Nd}]+)(?= [\p{L}\p{Nd}])"), 1)
    seconds = F.regexp_extract_all(spaced, F.lit(r"(?<=[\p{L}\p{Nd}] )([\p{L}\p{Nd}]+)"), 1)
    zipped = F.transform(F.arrays_zip(firsts.alias("first"), seconds.alias("second")), lambda z: F.struct(z["first"].alias("first"), z["second"].alias("second")))
    over = F.when((at_end != "") & (after != ""), F.array(F.struct(at_end.alias("first"), after.alias("second")))).otherwise(F.array().cast("array<struct<first:string,second:string>>"))
    each = lines.select("page_key", "lang", F.explode(F.concat(zipped, over)).alias("z"))
    return each.select("page_key", "lang", F.lower("z.first").alias("first"), F.lower("z.second").alias("second")).where("first is not null and second is not null")


def _joinable(lines: DataFrame, lexicon_: DataFrame, size: int) -> DataFrame:
    """(page_key, first, second, w, w1, w2): neighbours that are a known word together, with all counts.

    The lexicon, of ``size`` words, is looked up for the joined word first, which few neighbours make.
    """
    found = _neighbours(lines).withColumn("joined", F.concat("first", "second"))
    for name, column in (("w", "joined"), ("w1", "first"), ("w2", "second")):
        k = small_or_shuffled(lexicon_.where("weight > 0").select(F.col("lang").alias("lang_k"), F.col("word").alias("word_k"), F.col("weight").alias(name)), size).alias("k")
        found = found.alias("p").join(k, F.col("p.lang").eqNullSafe(F.col("k.lang_k")) & (F.col(f"p.{column}") == F.col("k.word_k")), "inner" if name == "w" else "left").select("p.*", f"k.{name}")
    found = found.where(F.least(F.coalesce("w1", F.lit(0)), F.coalesce("w2", F.lit(0))) < F.col("w"))
    return found.select("page_key", "first", "second", "w", "w1", "w2").distinct()


def _split_words(lexicon_: DataFrame, size: int) -> DataFrame:
    """(lang, word, left, right, wl, wr): rare words that two more frequent ones make up, the likeliest two."""
    rare = lexicon_.where(~F.col("listed") & (F.length("word") > 3) & (F.col("n") > 0))
    cuts = rare.select("lang", "word", "n", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("at"))
    cuts = cuts.select("lang", "word", "n", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    for side in ("left", "right"):
        k = small_or_shuffled(lexicon_.select(F.col("lang").alias("lang_k"), F.col("word").alias("word_k"), F.col("weight").alias(f"w_{side}")), size).alias("k")
        cuts = cuts.alias("c").join(k, F.col("c.lang").eqNullSafe(F.col("k.lang_k")) & (F.col(f"c.{side}") == F.col("k.word_k"))).select("c.*", f"k.w_{side}").where(F.col(f"w_{side}") > F.col("n"))
    best = cuts.groupBy("lang", "word").agg(F.max(F.struct((F.log("w_left") + F.log("w_right")).alias("score"), "left", "right", "w_left", "w_right")).alias("b"))
    return best.select("lang", "word", "b.left", "b.right", F.col("b.w_left").alias("wl"), F.col("b.w_right").alias("wr"))


@dataclass
class Facts:
    """What the decoder knows: counts of words in lower case, and by word what it may be instead."""

    total: float
    counts: dict[str, float] = field(default_factory=dict)
    #: word -> (the word meant or None, its count)
    fixes: dict[str, tuple[str | None, float]] = field(default_factory=dict)
    splits: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Division:
    """A word divided by a mark at a line end: counts of the classes of its joined and hyphened form, and of the joined form itself."""

    joined: float = 0.0
    compound: float = 0.0
    exact: float = 0.0
    listed: bool = False
    top: str | None = None


#: How a step of the path reads one or two words.
KEEP, FIX, SPLIT, JOIN, UNHYPHEN, HYPHENED = "keep", "fix", "split", "join", "unhyphen", "hyphened"
#: first word, words read, how, the words meant (lower case) or None where they are as written
Step = tuple[int, int, str, tuple[str, ...] | None]


def decode(words: list[str], facts: Facts, gaps: dict[int, bool] | None = None, divisions: dict[int, tuple[str, bool, Division]] | None = None) -> list[Step]:
    """The likeliest path over a stream of words.

    ``gaps`` tells the places k where only white space stands between word k and the
    next one (all, if not given); ``divisions`` those where a hyphen at a line end
    does, with its mark, whether the next word is capitalised, and what is known.
    """
    low = [w.lower() for w in words]
    divisions = divisions or {}

    def cost(count: float) -> float:
        return math.log(facts.total) - math.log(max(count, UNKNOWN))

    def read(k: int) -> tuple[float, Step]:
        """The best reading of one word alone."""
        word = low[k]
        count = facts.counts.get(word, 0.0)
        best = cost(count), (k, 1, KEEP, None)
        if word in facts.fixes:
            fix, times = facts.fixes[word]
            mixed = any(c.isdigit() for c in word)
            kept = best[0] + MIXED * mixed
            fixed = cost(times) + math.log(DOMINANT) if fix is not None else kept - 1
            best = (fixed, (k, 1, FIX, None if fix is None else (fix,))) if fixed <= kept else (kept, best[1])
        if word in facts.splits:
            left, right = facts.splits[word]
            parted = cost(facts.counts.get(left, 0.0)) + cost(facts.counts.get(right, 0.0)) + DIVIDED
            if parted < best[0]:
                best = parted, (k, 1, SPLIT, (left, right))
        return best

    n = len(words)
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[Step, ...]] = [()] * (n + 1)
    for k in range(n):
        ways: list[tuple[int, float, tuple[Step, ...]]] = []
        single = read(k)
        if k not in divisions or k + 1 >= n:
            ways.append((k + 1, single[0], (single[1],)))
        if k + 1 < n and k in divisions:
            mark, upper, d = divisions[k]
            joined = low[k] + low[k + 1]
            mixed = any(c.isdigit() for c in joined) and any(c.isalpha() for c in joined)
            wrong = not d.listed and (mixed or (d.top is not None and d.top != joined and cost(d.joined) + math.log(DOMINANT) <= cost(max(d.exact, 1.0))))
            ways.append((k + 2, cost(d.joined), ((k, 2, UNHYPHEN, ((d.top or joined,) if wrong else None)),)))
            if mark == "-":
                # the hyphen stays only on better evidence, or on equal one before a capital
                parts = (single[1], read(k + 1)[1])
                ways.append((k + 2, cost(d.compound) + (-1e-6 if upper else 1e-6), ((k, 2, HYPHENED, None), *parts)))
        elif k + 1 < n and (gaps is None or gaps.get(k)):
            together = facts.counts.get(low[k] + low[k + 1], 0.0)
            if together:
                ways.append((k + 2, cost(together) + JOINED, ((k, 2, JOIN, (low[k] + low[k + 1],)),)))
        for to, extra, steps in ways:
            if best[k] + extra < best[to]:
                best[to], back[to] = best[k] + extra, steps
    path, k = [], n
    while k:
        path[:0] = back[k]
        k = back[k][0][0]
    return path


def _cased(meant: str, written: str) -> str:
    """``meant`` with the case of what was written."""
    return meant.upper() if written.isupper() and len(written) > 1 else meant.capitalize() if written[:1].isupper() else meant


RUN = re.compile(r"[^\W_]+")


def read_page(lines: list[tuple[int, str]], over: tuple[int, str] | None, taken: bool, facts: Facts, known: dict[int, Division]) -> tuple[list[tuple], bool]:
    """Rows (line_no, line, text, glue, hyphen, misread) of a page's body, and whether the line ``over`` was misread.

    ``over`` is the first body line of the next page, of which the first word is
    read if the page ends in a hyphen; ``taken`` tells that the page before read
    this page's first word so. ``glue`` joins a line's text with the next one's.
    """
    words, at, gaps, divisions = [], [], {}, {}  # at: (line, start, end) of each word
    for i, (_, line) in enumerate(lines):
        found = list(RUN.finditer(line))
        if taken and i == 0:
            found = found[1:]
        for m in found:
            if at:
                between = lines[at[-1][0]][1][at[-1][2] :] + "\n" + line[: m.start()] if at[-1][0] != i else line[at[-1][2] : m.start()]
                gaps[len(words) - 1] = bool(between) and between.isspace()
            words.append(m.group())
            at.append((i, m.start(), m.end()))
    last = {i: k for k, (i, _, _) in enumerate(at)}
    first: dict[int, int] = {}
    for k, (i, _, _) in enumerate(at):
        first.setdefault(i, k)
    for i, (no, line) in enumerate(lines):
        if no not in known or i not in last or not re.fullmatch(rf"[{HYPHENS}]\s*", line[at[last[i]][2] :]):
            continue
        if i + 1 < len(lines):
            after = lines[i + 1][1][at[first[i + 1]][1] :] if first.get(i + 1) == last[i] + 1 else ""
        else:
            head = RUN.search(over[1]) if over else None
            after = head.group() if head else ""
            if after:
                words.append(after)
                at.append((len(lines), head.start(), head.end()))
        if after:
            divisions[last[i]] = line[at[last[i]][2]], after[:1].isupper(), known[no]
    texts = [line for _, line in lines] + [over[1] if over else ""]
    edits: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    glue, hyphen, misread = [" "] * len(texts), [False] * len(texts), [False] * len(texts)
    for k, n, how, meant in decode(words, facts, gaps, divisions):
        i, start, end = at[k]
        j, start2, end2 = at[k + n - 1]
        if how == FIX:
            misread[i] = True
            if meant:
                edits[i].append((start, end, _cased(meant[0], words[k])))
        elif how == SPLIT:
            misread[i] = True
            edits[i].append((start, end, f"{words[k][: len(meant[0])]} {words[k][len(meant[0]) :]}"))
        elif how == JOIN:
            misread[i] = True
            edits[i].append((start, end2 if i == j else end, words[k] + words[k + 1]))
            if i != j:
                edits[j].append((start2, end2, ""))
        elif how == UNHYPHEN:
            hyphen[i], glue[i] = True, ""
            whole = words[k] + words[k + 1]
            if meant:
                digits = [any(c.isdigit() for c in w) for w in (words[k], words[k + 1])]
                wrong = [not meant[0].startswith(words[k].lower()), not meant[0].endswith(words[k + 1].lower())] if meant[0] != whole.lower() else digits
                misread[j] |= wrong[1]
                misread[i] |= wrong[0] or not wrong[1]
                whole = _cased(meant[0], words[k])
            cut = len(words[k])
            edits[i].append((start, len(texts[i].rstrip()), whole[:cut]))
            edits[j].append((start2, end2, whole[cut:]))
        elif how == HYPHENED:
            glue[i] = ""
    rows = []
    for i, (no, line) in enumerate(lines):
        text = line
        for start, end, into in sorted(edits[i], reverse=True):
            text = text[:start] + into + text[end:]
        rows.append((no, line, text.strip() if edits[i] else line.strip(), glue[i], hyphen[i], misread[i]))
    return rows, misread[-1]


def read_pages(pages: DataFrame, wordlist: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_key, book_id, page, line_no, line, text, glue, hyphen, misread) of every body line, from the path of its page.

    The line that a word from the page before runs on to has a row without a text beside its own one.
    """
    body = checkpoint(_with_next(lines))
    words = checkpoint(_words(body))
    known = lexicon(words, wordlist)
    size = known.count()
    bad = misread_words(known)
    same = lambda x, y: F.col(f"{x}.lang").eqNullSafe(F.col(f"{y}.lang")) & (F.col(f"{x}.word") == F.col(f"{y}.word"))
    b = bad.alias("b").join(known.alias("k"), same("b", "k")).select("b.lang", "b.word", F.col("k.n").alias("n"), "b.fix", F.when(F.col("b.fix") == F.col("k.top"), F.col("k.top_weight")).alias("times"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("long").alias("wl"), F.lit(None).cast("long").alias("wr"), F.lit(True).alias("bad"))
    split = _split_words(known, size).alias("s").join(known.alias("k"), same("s", "k")).select("s.lang", "s.word", F.col("k.n").alias("n"), F.lit(None).cast("string").alias("fix"), F.lit(None).cast("long").alias("times"), "s.left", "s.right", F.col("s.wl").cast("long").alias("wl"), F.col("s.wr").cast("long").alias("wr"), F.lit(False).alias("bad"))
    others = checkpoint(b.unionByName(split))
    divided = checkpoint(_divided_words(body, known, size))
    # words of a page that may be others; the parts of divided words are words too
    parts = body.where("divided").select(F.explode(F.array(F.struct("page_key", F.lower("part").alias("word")), F.struct(F.col("page_key"), F.lower("rest").alias("word")))).alias("p"), "lang").select("p.*", "lang")
    own = words.select("page_key", "word", "lang").unionByName(parts).distinct()
    o = small_or_shuffled(others).alias("x")
    facts = own.alias("w").join(o, same("w", "x")).groupBy("w.page_key").agg(F.collect_list(F.struct("x.word", "x.n", "x.fix", "x.times", "x.left", "x.right", "x.wl", "x.wr", "x.bad")).alias("facts"))
    joins = _joinable(body, known, size).groupBy("page_key").agg(F.collect_list(F.struct("first", "second", "w", "w1", "w2")).alias("joins"))
    split_lines = divided.groupBy("page_key").agg(F.collect_list(F.struct("line_no", "weight_j", "weight_c", "n", "listed", "top_j")).alias("divided"))
    taken = divided.where("next_key != page_key").select(F.col("next_key").alias("page_key"), F.lit(True).alias("taken")).distinct()
    totals = {row["lang"]: float(row["n"]) for row in words.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    over = F.max(F.when(F.col("next_key") != F.col("page_key"), F.struct("next_key", "next_line", "nl_line"))).alias("over")
    each = body.groupBy("page_key", "book_id", "page", "lang").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"), over)
    table = each.join(facts, "page_key", "left").join(joins, "page_key", "left").join(split_lines, "page_key", "left").join(taken, "page_key", "left").repartition(spread(pages), "page_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                f = Facts(totals.get(row.lang if isinstance(row.lang, str) else None, 0.0) + 1)
                for x in row.facts if row.facts is not None else ():
                    f.counts[x["word"]] = x["n"]
                    if x["bad"]:
                        f.fixes[x["word"]] = x["fix"], x["times"] or 0.0
                    if x["left"]:
                        f.splits[x["word"]] = x["left"], x["right"]
                        f.counts.update({x["left"]: x["wl"], x["right"]: x["wr"]})
                for x in row.joins if row.joins is not None else ():
                    f.counts.update({x["first"]: x["w1"] or 0.0, x["second"]: x["w2"] or 0.0, x["first"] + x["second"]: x["w"]})
                known_ = {x["line_no"]: Division(x["weight_j"] or 0.0, x["weight_c"] or 0.0, x["n"] or 0.0, x["listed"], x["top_j"]) for x in (row.divided if row.divided is not None else ())}
                over_ = (row.over["next_line"], row.over["nl_line"]) if row.over is not None and row.over["nl_line"] is not None else None
                read, wrong = read_page([(x["line_no"], x["line"]) for x in row.lines], over_, row.taken is True, f, known_)
                out += [(row.page_key, row.book_id, row.page, *x) for x in read]
                if wrong:
                    out.append((row.over["next_key"], row.book_id, None, over_[0], None, None, None, False, True))
            yield pd.DataFrame(out, columns=READ).astype({"page": "Int32"})

    kind = dict(pages.dtypes)
    return table.mapInPandas(run, f"page_key {kind['page_key']}, book_id string, page int, line_no int, line string, text string, glue string, hyphen boolean, misread boolean")


READ = ["page_key", "book_id", "page", "line_no", "line", "text", "glue", "hyphen", "misread"]


def damaged_lines(pages: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(page_key, line_no, defect), each once: furniture, hyphen, misread.

    Null and empty texts have no lines. A null language has words of its own.
    A divided word over a page end joins the first body line of the next page of
    its book. Pages that repeat a number of their book each count.
    """
    lines = checkpoint(page_lines(pages))
    read = read_pages(pages, wordlist, lines)
    named = F.array_compact(F.array(F.when(F.col("hyphen"), "hyphen"), F.when(F.col("misread"), "misread")))
    furniture = lines.where("furniture").select("page_key", "line_no", F.lit("furniture").alias("defect"))
    return furniture.unionByName(read.select("page_key", "line_no", F.explode(named).alias("defect"))).distinct()


def _breaks(lines: list[str], gaps: list[bool]) -> list[int]:
    """Where paragraphs begin: the best division of a page's lines into paragraphs.

    A paragraph's score has the evidence that it begins at its first line and what
    its length speaks for: near the usual length of the page, and no single short line.
    """
    n = len(lines)
    if not n:
        return []
    width = sorted(len(x.rstrip()) for x in lines)[-max(1, n // 4)]
    evidence = [0.0]
    for k in range(1, n):
        before, line = lines[k - 1].rstrip(), lines[k]
        e = 3.0 * gaps[k] + 2.5 * (line[:1].isspace() and not lines[k - 1][:1].isspace()) + 2.0 * line[:1].isspace()
        e += 1.0 * bool(re.search(r"[.!?…”»“)]$", before)) * (1.5 if len(before) < 0.75 * width else 0.2)
        evidence.append(e - 4.0 * (before[-1:] in HYPHENS) - 1.5 * line.lstrip()[:1].islower() - 1.0)
    usual = n / (1 + sum(e > 1.5 for e in evidence))

    def prior(first: int, end: int) -> float:
        size = end - first
        lonely = size == 1 and len(lines[first].rstrip()) < 0.5 * width and 0 < first
        return -0.3 * abs(math.log(size / usual)) - 0.5 * lonely

    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for first in range(end):
            score = best[first] + evidence[first] + prior(first, end)
            if score > best[end]:
                best[end], back[end] = score, first
    starts, k = [], n
    while k:
        k = back[k]
        starts.append(k)
    return starts[::-1]


def repaired_pages(pages: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(book_id, page, paragraph_no, text, continues, glue): paragraphs of each page, in reading order.

    ``continues`` tells that a page's last paragraph goes on, with its next page's
    first one, and ``glue`` what stands between the two.
    """
    lines = checkpoint(page_lines(pages))
    read = read_pages(pages, wordlist, lines).where("line is not null")
    table = read.groupBy("page_key", "book_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "text", "glue"))).alias("lines"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                numbers = [x["line_no"] for x in row.lines]
                gaps = [k > 0 and numbers[k] - numbers[k - 1] > 1 for k in range(len(numbers))]
                starts = [*_breaks([x["line"] for x in row.lines], gaps), len(numbers)]
                for no, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True), 1):
                    text = ""
                    for k, x in enumerate(row.lines[a:z]):
                        text += (row.lines[a + k - 1]["glue"] if k else "") + x["text"]
                    glue = row.lines[z - 1]["glue"]
                    ends = bool(re.search(r"[.!?…”»“)]$", text)) and glue == " "
                    out.append((row.book_id, row.page, no, text, z == len(numbers) and not ends, glue))
            yield pd.DataFrame(out, columns=["book_id", "page", "paragraph_no", "text", "continues", "glue"])

    return table.mapInPandas(gather, "book_id string, page int, paragraph_no int, text string, continues boolean, glue string")


def whole_paragraphs(parts: DataFrame) -> DataFrame:
    """(book_id, page, paragraph_no, text): paragraphs joined over page ends, under the page where they begin.

    A page that is one continuing paragraph hands its part on; pointers to the
    page where a paragraph begins are doubled until none moves, so a paragraph may
    run over any number of pages.
    """
    last = parts.groupBy("book_id", "page").agg(F.max(F.struct("paragraph_no", "continues")).alias("m")).select("book_id", "page", "m.*")
    goes_on = last.where("continues").select("book_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("joined"))
    firsts = parts.join(goes_on, ["book_id", "page"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)) & (F.col("paragraph_no") == 1))
    firsts = checkpoint(firsts)
    single = last.where("paragraph_no = 1").select("book_id", "page", F.lit(True).alias("single"))
    heads = firsts.where("joined").select("book_id", "page", (F.col("page") - 1).alias("to"))
    through = heads.join(single, ["book_id", "page"])
    pointers = checkpoint(heads)
    while True:
        step = through.select("book_id", F.col("page").alias("to"), F.col("to").alias("further"))
        moved = pointers.join(step, ["book_id", "to"], "left")
        if moved.where("further is not null").limit(1).count() == 0:
            break
        pointers = checkpoint(moved.select("book_id", "page", F.coalesce("further", "to").alias("to")))
        again = through.join(step.withColumnRenamed("to", "mid"), (through.book_id == step.book_id) & (through.to == F.col("mid")), "left")
        through = checkpoint(again.select(through.book_id, through.page, F.coalesce("further", through.to).alias("to")))
    placed = firsts.join(pointers, ["book_id", "page"], "left").withColumn("home", F.when(F.col("joined"), F.coalesce("to", "page")).otherwise(F.col("page")))
    at = last.select("book_id", F.col("page").alias("home"), F.col("paragraph_no").alias("last_no"))
    placed = placed.join(at, ["book_id", "home"], "left").withColumn("no", F.when(F.col("joined"), F.col("last_no")).otherwise(F.col("paragraph_no")))
    pieces = F.array_sort(F.collect_list(F.struct("page", "paragraph_no", "text", "glue")))
    together = placed.groupBy("book_id", "home", "no").agg(pieces.alias("ps"))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("glue"))
    add = lambda acc, p: F.struct(F.concat(acc["text"], acc["glue"], p["text"]).alias("text"), p["glue"].alias("glue"))
    return together.select("book_id", F.col("home").alias("page"), F.col("no").alias("paragraph_no"), F.aggregate("ps", start, add, lambda acc: acc["text"]).alias("text"))
