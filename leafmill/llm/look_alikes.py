"""One consistent form for text that looks the same.

Texts that already are in that form pass through. The others are exploded into
positioned code points; a broadcast join replaces each by its decomposition or
look-alike, combining marks are ordered by class behind their letter, marked
letters are recomposed, and the strings are rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from leafmill.session import checkpoint, small_or_shuffled

ZWNJ = "‌"

# Letters of other scripts that look like a Latin letter.
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲͿ", "ABEZHIKMNOPTYXvopcJ", strict=True))
CYRILLIC_LIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ", "ABESIJKMHOPCTYXaesijopcyxdqwh", strict=True))
ARMENIAN_LIKE = dict(zip("ՕՍԼՏօոսհցզյ", "OULSonuhgqj", strict=True))
CHEROKEE_LIKE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB", strict=True))
# Arabic letters whose Persian form counts as the same.
PERSIAN_FORM = {"ي": "ی", "ى": "ی", "ك": "ک", "ۀ": "هٔ", "ە": "ه"}
# Decomposition tags that change nothing about what is read, and
# those that do so only for letters (ligatures) or white space.
SAME_LOOK = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"}
SAME_LOOK_LETTERS = {"<compat>", "<noBreak>"}

_FIRST_OF_PAIR, _MAPPED, _MARK, _SECOND_OF_PAIR, _ZWNJ, _ARABIC = 32, 1, 2, 4, 8, 16


def _inkless(c: str) -> bool:
    """Format characters and other characters without ink, but for the zero-width non-joiner."""
    if c == ZWNJ:
        return False
    code = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x0600 <= code <= 0x0605 and code not in (0x06DD, 0x070F, 0x08E2) or (
        code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180D
    )


def plain_form(c: str) -> str:
    """The code points that stand for ``c``, decomposed: empty for characters without ink."""
    if _inkless(c):
        return ""
    if 0xAC00 <= ord(c) <= 0xD7A3:  # Hangul syllables are stored whole
        return c
    category = unicodedata.category(c)
    if category == "Zs" or c == "\t":
        return " "
    if category in ("Zl", "Zp"):
        return "\n"
    if category == "Nd" and unicodedata.name(c, "").startswith("ARABIC-INDIC DIGIT"):
        return chr(0x06F0 + unicodedata.digit(c))
    for table in (PERSIAN_FORM, GREEK_LIKE, CYRILLIC_LIKE, ARMENIAN_LIKE, CHEROKEE_LIKE):
        if c in table:
            return table[c]
    tag, _, codes = unicodedata.decomposition(c).rpartition("> ")
    if not codes:
        return c
    into = "".join(chr(int(x, 16)) for x in codes.split())
    tag += ">" * bool(tag)
    letters = all(unicodedata.category(x)[0] in "LM" for x in into)
    if tag in SAME_LOOK or (tag in SAME_LOOK_LETTERS and letters and category[0] == "L") or not tag:
        return "".join(map(plain_form, into))
    return c


@lru_cache(1)
def _tables() -> tuple[dict[str, str], dict[str, int], dict[str, str]]:
    """Replacements, combining classes and recompositions, by rule over all of Unicode."""
    plain, classes, composed = {}, {}, {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if (into := plain_form(c)) != c:
            plain[c] = into
        if kind := unicodedata.combining(c):
            classes[c] = kind
        written = unicodedata.decomposition(c)
        if written and written[0] != "<" and unicodedata.is_normalized("NFC", c) and len(into) > 1:
            if c not in PERSIAN_FORM and unicodedata.combining(into[0]) == 0:
                composed.setdefault(into, c)
    return plain, classes, composed


@lru_cache(1)
def _flags() -> np.ndarray:
    plain, classes, composed = _tables()
    flags = np.zeros(sys.maxunicode + 1, np.uint8)
    settled = set(composed.values())
    for c in plain:
        if c not in settled:
            flags[ord(c)] |= _MAPPED
    for c in classes:
        flags[ord(c)] |= _MARK
    for pair, whole in composed.items():
        flags[ord(pair[0])] |= _FIRST_OF_PAIR
        flags[ord(whole)] |= _FIRST_OF_PAIR
        for c in pair[1:]:
            flags[ord(c)] |= _SECOND_OF_PAIR
    for start, end in ((0x0620, 0x064A), (0x066E, 0x06D3), (0x06D5, 0x06D5), (0x06EE, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08C9)):
        flags[start : end + 1] |= _ARABIC
    flags[ord(ZWNJ)] |= _ZWNJ
    return flags


def _unsettled(texts: list[str]) -> np.ndarray:
    """Whether each text holds anything that the consistent form would change (or might)."""
    flags = _flags()
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    f = flags[codes]
    before, after = np.roll(f, 1), np.roll(f, -1)
    hit = (f & _MAPPED) | (f & before & _MARK) | ((f & _SECOND_OF_PAIR > 0) & (before & _FIRST_OF_PAIR > 0))
    joint = (before & (_ARABIC | _MARK) > 0) & (after & _ARABIC > 0)
    hit |= (f & _ZWNJ > 0) & ~joint
    ends = np.cumsum([len(t) + 1 for t in texts])
    total = np.concatenate([[0], np.cumsum(hit > 0)])
    return total[ends] > total[np.concatenate([[0], ends[:-1]])]


@F.pandas_udf(BooleanType())
def needs_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text is not, or may not be, in the consistent form. Null is in it."""
    for texts in batches:
        filled = texts.fillna("").tolist()
        yield pd.Series(_unsettled(filled) if filled else np.empty(0, bool))


def _mapping(spark: SparkSession) -> DataFrame:
    """(c, parts): the positioned replacement of each code point with combining classes."""
    plain, classes, _ = _tables()
    rows = [
        (c, [(k, x, classes.get(x, 0)) for k, x in enumerate(plain.get(c, c))]) for c in sorted(plain.keys() | classes.keys())
    ]
    return spark.createDataFrame(rows, "c string, parts array<struct<k:int, x:string, kind:int>>")


def _compositions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(_tables()[2].items()), "letter string, whole string")


def code_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """(__key, at, k, x, kind): the replaced code points of each text in place."""
    exploded = df.select(F.col(key).alias("__key"), F.posexplode(F.split(F.col(text), "")).alias("at", "c")).where("c <> ''")
    joined = exploded.join(F.broadcast(_mapping(df.sparkSession)), "c", "left")
    itself = F.array(F.struct(F.lit(0).alias("k"), F.col("c").alias("x"), F.lit(0).alias("kind")))
    return joined.select("__key", "at", F.explode(F.coalesce("parts", itself)).alias("p")).select("__key", "at", "p.*")


def rebuilt(points: DataFrame, key: str) -> DataFrame:
    """(key, form): marks ordered by class behind their letter, recomposed, joined to a string."""
    spark = points.sparkSession
    in_order = "rows between unbounded preceding and current row"
    starts = F.expr(f"sum(if(kind = 0, 1, 0)) over (partition by __key order by at, k {in_order})")
    following = F.expr("coalesce(lead(kind) over (partition by __key order by at, k), 0)")
    tagged = points.withColumn("letter_no", starts).withColumn("marked", (F.col("kind") != 0) | (following != 0))
    order = F.array_sort(F.collect_list(F.struct("kind", "at", "k", "x")))
    marked = (
        tagged.where("marked").groupBy("__key", "letter_no").agg(order.alias("cs"))
        .withColumn("letter", F.array_join(F.transform("cs", lambda c: c["x"]), ""))
    )
    whole = F.broadcast(_compositions(spark))
    # the longest beginning of a marked letter that has a code point of its own is recomposed
    for size in (3, 2):
        marked = marked.join(whole.withColumnsRenamed({"letter": f"l{size}", "whole": f"w{size}"}), F.substring("letter", 1, size) == F.col(f"l{size}"), "left")
    best = F.when(F.col("w3").isNotNull(), F.concat("w3", F.expr("substring(letter, 4)")))
    best = best.when(F.col("w2").isNotNull(), F.concat("w2", F.expr("substring(letter, 3)"))).otherwise(F.col("letter"))
    pieces = marked.select("__key", "letter_no", best.alias("x")).unionByName(tagged.where("not marked").select("__key", "letter_no", "x"))
    listed = pieces.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("letter_no", "x"))).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda c: c["x"]), "")
    letter = r"[\p{IsArabic}&&\p{L}]"
    joined = F.regexp_replace(joined, f"{ZWNJ}+", ZWNJ)
    joined = F.regexp_replace(joined, rf"(?<![\p{{M}}{letter}]){ZWNJ}|{ZWNJ}(?!{letter})", "")
    return listed.select(F.col("__key").alias(key), joined.alias("form"))


def consistent_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) of every row whose ``text`` is not in the consistent form yet; ``key`` must be unique.

    The form has one width, composed accents, plain spaces (one for one), no
    characters without ink, no ligatures or contextual shapes, Latin letters for
    their look-alikes, and Persian yeh, kaf and digits. Case, accents, raised
    digits and a non-joiner between Arabic-script letters stay. Null and empty
    texts give no row; a text of nothing but inkless characters gives none either
    and its form is the empty string.
    """
    rows = df.select(key, text).where(needs_form(F.col(text)))
    return rebuilt(code_points(rows, key, text), key)


def _formed(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, owner, r1, r2, f1, f2, out): hashes of every text and of its form, and whether they differ."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(owner).isNotNull()).select(key, owner, text)
    formed = consistent_form(rows, key, text).withColumnRenamed(key, "__key")
    hashes = lambda c, p: (F.xxhash64(c).alias(p + "1"), F.xxhash64(c, F.lit(1)).alias(p + "2"))
    changed = checkpoint(formed.select("__key", *hashes(F.col("form"), "f")))
    raw = rows.select(F.col(key).alias("key"), F.col(owner).alias("owner"), *hashes(F.col(text), "r"))
    all_rows = raw.join(changed, F.col("key") == F.col("__key"), "left")
    return checkpoint(
        all_rows.select(
            "key", "owner", "r1", "r2", F.coalesce("f1", "r1").alias("f1"), F.coalesce("f2", "r2").alias("f2"), F.col("__key").isNotNull().alias("out")
        )
    )


def same_look_classes(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, class_id, n_members): rows whose text another row of their owner has in other characters.

    A class holds all rows of one owner and form, named by its least key; one row
    per member, however large a class is.
    """
    rows = _formed(df, key, owner, text)
    differ = (F.min("r1") != F.max("r1")) | (F.min("r2") != F.max("r2"))
    classes = rows.groupBy("owner", "f1", "f2").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_members"), differ.alias("differ")).where("differ").drop("differ")
    return rows.join(small_or_shuffled(checkpoint(classes)), ["owner", "f1", "f2"]).select("key", "class_id", "n_members")


def same_look_pairs(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(a, b), a < b: rows of one owner with different texts of one consistent form.

    ``df`` holds one row per key. A pair has at least one text out of form, so
    those rows alone are joined with all rows, on hashes of owner and form; the
    texts are compared by two 64-bit hashes. Hot groups are left to the skew
    handling of the join, which splits them. Null owners pair with nobody.
    """
    all_rows = _formed(df, key, owner, text)
    a, b = all_rows.where("out").alias("a"), all_rows.alias("b")
    on = (F.col("a.owner") == F.col("b.owner")) & (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2"))
    differ = (F.col("a.key") != F.col("b.key")) & ((F.col("a.r1") != F.col("b.r1")) | (F.col("a.r2") != F.col("b.r2")))
    pairs = a.join(b, on & differ & ~(F.col("b.out") & (F.col("b.key") < F.col("a.key"))))
    return pairs.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b"))
