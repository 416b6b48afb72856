"""Names and terms: where they stand, how often, and whether translations keep to them.

Forms are looked up by words, not by a theta join: every form has a first word,
texts are exploded into words, an equi-join on that word finds candidates, and
the whole form is verified at word boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that join a form to what stands beside it, so that it is no word of its own there.
JOINED = r"[\p{L}\p{N}\p{M}‌‍_]"
# Least occurrences of a candidate, the part of them inside sentences, contexts kept, words that open sentences.
LEAST, INSIDE_PART, CONTEXTS, LIMIT = 3, 4, 5, 400
NAME = r"\p{Lu}[\p{L}’'-]+(?: \p{Lu}[\p{L}’'-]+)*"


def quoted(text: Column) -> Column:
    """``text`` as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def stands_alone(text: Column, form: Column) -> Column:
    """Whether ``form`` stands in ``text`` as a word of its own."""
    return F.rlike(text, F.concat(F.lit(rf"(?<!{JOINED})"), quoted(form), F.lit(rf"(?!{JOINED})")))


def times_alone(text: Column, form: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit(rf"(?<!{JOINED})"), quoted(form), F.lit(rf"(?!{JOINED})")))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"([\p{L}\p{N}\p{M}_]+)", 1)


def entry_forms(entries: DataFrame) -> DataFrame:
    """(book_id, id, form): the source of an entry and its aliases, each once; blank ones are left out."""
    forms = F.array_distinct(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entries.select("book_id", "id", F.explode(forms).alias("form")).where("trim(form) <> ''")


def form_places(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(book_id, unit, text, id, form): forms that stand alone in a text of their book."""
    # only words travel; texts are fetched for the units that have a form's first word
    kept = texts.where("text is not null")
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1)))
    exploded = kept.select("book_id", "unit", words.alias("word"))
    keyed = forms.withColumn("word", first_word(F.col("form")))
    near = exploded.join(keyed, ["book_id", "word"]).drop("word").distinct()
    return near.join(kept.select("book_id", "unit", "text"), ["book_id", "unit"]).where(stands_alone(F.col("text"), F.col("form"))).select("book_id", "unit", "text", *[c for c in forms.columns if c != "book_id"])


def form_frequencies(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, id, n): occurrences of all forms of an entry; one inside another counts for both."""
    places = form_places(texts, entry_forms(entries)).withColumn("n", times_alone(F.col("text"), F.col("form")))
    counted = places.groupBy("book_id", "id").agg(F.sum("n").alias("n"))
    return entries.select("book_id", "id").join(counted, ["book_id", "id"], "left").fillna(0, ["n"])


def name_candidates(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(name, n, n_inside, first_unit): capitalised runs seen often enough, some of them inside a sentence."""
    bare = F.regexp_replace("text", r"[.!?…]+[”»\"')]*\s+", "\n")
    sentences = F.split(bare, "\n")
    found = texts.where("text is not null").select("unit", F.explode(sentences).alias("sentence"))
    runs = F.regexp_extract_all("sentence", F.lit(f"({NAME})"), 1)
    opened = F.regexp_extract("sentence", rf"^[\p{{P}}\s]*({NAME})", 1)
    each = found.select("unit", opened.alias("opened"), F.posexplode(runs).alias("at", "name"))
    inside = ~((F.col("at") == 0) & (F.col("opened") == F.col("name")))
    counted = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"), F.min("unit").alias("first_unit"))
    return counted.where((F.col("n") >= least) & (F.col("n_inside") >= F.greatest(F.lit(1), F.floor(F.col("n") / INSIDE_PART))))


def absorbed_aliases(candidates: DataFrame) -> DataFrame:
    """(alias, name): a single word taken up by the longest longer name that holds it, first in order on ties."""
    longer = candidates.where(F.col("name").contains(" ")).select("name", F.explode(F.split("name", " ")).alias("alias"))
    single = candidates.where(~F.col("name").contains(" ")).select(F.col("name").alias("alias"))
    order = Window.partitionBy("alias").orderBy(F.desc(F.length("name")), "name")
    return single.join(longer, "alias").withColumn("place", F.row_number().over(order)).where("place = 1").select("alias", "name")


def english_pattern(term: Column) -> Column:
    """A pattern for an English term: last word inflected, unless short or in capitals, which also keep their case."""
    escaped = quoted(term)
    last = F.regexp_extract(term, r"(\S+)$", 1)
    fixed = (F.length(last) <= 2) | (F.upper(last) == last)
    return F.when(fixed, F.concat(F.lit(r"\b"), escaped, F.lit(r"\b"))).otherwise(F.concat(F.lit(r"(?i)\b"), escaped, F.lit(r"(?:es|s|ed|ing|d)?\b")))


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(unit, term): terms of a bank, a small table of settings, that a text holds; one row for each text and term.

    The bank is broadcast, so a text meets it in the task that reads it and is never shuffled.
    """
    starts = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]{1,3})[a-z0-9]*"), 1))
    exploded = texts.where("text is not null").select("unit", "text", F.explode(starts).alias("start"))
    keyed = terms.select("term").distinct().select("term", F.substring(F.regexp_extract(F.lower("term"), r"([a-z0-9]+)", 1), 1, 3).alias("start"), english_pattern(F.col("term")).alias("pattern"))
    return exploded.join(F.broadcast(keyed), "start").where(F.rlike("text", F.col("pattern"))).select("unit", "term")


def drift(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, unit, id, form): blocks that hold a form of an entry while their target holds none of its targets."""
    texts = blocks.where("target <> ''").select("book_id", F.col("id").alias("unit"), "text")
    places = form_places(texts, entry_forms(entries)).select("book_id", "unit", "id", "form").distinct()
    wanted = entries.where("target <> ''").select("book_id", "id", F.col("target").alias("accepted"))
    targets = blocks.select("book_id", F.col("id").alias("unit"), "target")
    joined = places.join(wanted, ["book_id", "id"]).join(targets, ["book_id", "unit"])
    return joined.where(~F.contains(F.col("target"), F.col("accepted"))).select("book_id", "unit", "id", "form")


def first_mentions(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, id, owner): the block that introduces a name: the entry's own if it holds the target, else the first that does."""
    wanted = entries.where("target <> ''").select("book_id", "id", F.col("target").alias("form"), "first_block_id")
    texts = blocks.where("target <> ''").select("book_id", F.col("id").alias("unit"), "pos", F.col("target").alias("text"))
    places = form_places(texts.select("book_id", "unit", "text"), wanted.select("book_id", "id", "form"))
    ranked = places.join(texts.select("book_id", "unit", "pos"), ["book_id", "unit"]).join(wanted.select("book_id", "id", "first_block_id"), ["book_id", "id"])
    order = Window.partitionBy("book_id", "id").orderBy((F.col("unit") != F.coalesce("first_block_id", F.lit(""))), "pos")
    return ranked.withColumn("place", F.row_number().over(order)).where("place = 1").select("book_id", "id", F.col("unit").alias("owner"))


def parenthetical(form: Column) -> Column:
    """What a first form gives in brackets, without nested ones."""
    return F.nullif(F.regexp_extract(form, r"\(([^()]{2,})\)", 1), F.lit(""))


def allocated_ids(entries: DataFrame, fresh: DataFrame, prefix: str = "g") -> DataFrame:
    """``fresh`` (book_id, name) with new ids behind the highest ever used in its book, in order of name."""
    used = entries.groupBy("book_id").agg(F.max(F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("int")).alias("top"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("name"))
    joined = fresh.join(used, "book_id", "left").withColumn("no", F.coalesce("top", F.lit(0)) + place)
    return joined.select("book_id", "name", F.concat(F.lit(prefix), F.lpad(F.col("no").cast("string"), 4, "0")).alias("id"))


def alias_maps(entries: DataFrame) -> DataFrame:
    """(book_id, id, aliases): a map from each alias to the entry's target."""
    pairs = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a, F.col("target")))
    return entries.select("book_id", "id", F.map_from_entries(F.array_distinct(pairs)).alias("aliases"))


def owners_of_voices(cards: DataFrame, entries: DataFrame) -> DataFrame:
    """``cards`` (book_id, card, name) with the entry they name: by id, else by exact source; n_matches tells ambiguity."""
    named = entries.select("book_id", F.col("id").alias("entry_id"), F.col("source").alias("entry_source"))
    c, e = cards.alias("c"), named.alias("e")
    on = (F.col("c.book_id") == F.col("e.book_id")) & ((F.col("c.name") == F.col("e.entry_id")) | (F.col("c.name") == F.col("e.entry_source")))
    joined = c.join(e, on, "left").withColumn("by_id", F.col("c.name") == F.col("e.entry_id"))
    return joined.groupBy("c.book_id", "c.card").agg(F.min_by("e.entry_id", F.struct(~F.coalesce("by_id", F.lit(False)), "e.entry_id")).alias("entry_id"), F.count("e.entry_id").alias("n_matches"))


# Ordinary words that a capitalised run takes up at its ends.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her hers him his how "
    "i if in is it its me my no nor not of on or our ours she so than that the their "
    "theirs them then there these they this those to too us was we were what when "
    "where which who whom why will with you your yours "
    "after again against all also am among any because before being below between "
    "both did do does doing down during each few further here into itself more most "
    "other over same some such through under until up very while "
    "mr mrs miss ms dr sir madam lord lady oh ah yes well now just only even still "
    "chapter part book volume prologue epilogue contents preface introduction "
    "january february march april may june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday"
).split()


def trimmed_name(name: Column) -> Column:
    """A capitalised run without the ordinary words at its ends and without a possessive at its last word."""
    ordinary = "|".join(sorted(STOPWORDS, key=lambda w: (-len(w), w)))
    bare = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), "['’]s$|(?<=s)['’]$", "")
    ahead = F.regexp_replace(bare, rf"(?i)^(?:(?:{ordinary})(?: |$))+", "")
    return F.trim(F.regexp_replace(ahead, rf"(?i)(?:(?:^| )(?:{ordinary}))+$", ""))


def name_category(name: Column, contexts: Column) -> Column:
    """place, person or unknown, by what stands before or behind a name in its contexts; the first that holds."""
    said = F.lower(F.array_join(contexts, " "))
    quoted_name = quoted(F.lower(name))
    place = F.concat(F.lit(r"\b(?:in|at|to|from|near|towards?)\s+"), quoted_name, F.lit(r"\b"))
    speaks = F.concat(quoted_name, F.lit(r"\s+(?:said|asked|replied|whispered|cried)"))
    titled = F.concat(F.lit(r"\b(?:mr|mrs|miss|ms|dr|lord|lady|sir)\.?\s+"), quoted_name)
    return F.when(F.rlike(said, place), "place").when(F.rlike(said, speaks) | F.rlike(said, titled), "person").otherwise("unknown")


def persian_hits(texts: DataFrame, bank: DataFrame) -> DataFrame:
    """(unit, en): terms of a bank (en, fa, note) whose first Persian alternative stands anywhere in a text.

    The first three characters of an alternative (all of a shorter one) find
    candidates by an equi-join with the places of a text; the whole is then checked.
    """
    shown = bank.select("en", F.trim(F.split("fa", "/")[0]).alias("form")).where("form <> ''")
    keyed = shown.withColumn("start", F.left("form", F.lit(3)))
    kept = texts.where("text <> ''")
    starts = F.transform(F.sequence(F.lit(1), F.length("text")), lambda k: F.substring("text", k, F.lit(3)))
    shorter = F.flatten(F.transform(starts, lambda x: F.array(x, F.left(x, F.lit(2)), F.left(x, F.lit(1)))))
    places = kept.select("unit", F.explode(F.array_distinct(shorter)).alias("start"))
    near = places.join(keyed, "start").select("unit", "en", "form").distinct()
    return near.join(kept.select("unit", "text"), "unit").where(F.contains("text", F.col("form"))).select("unit", "en").distinct()


def term_briefs(texts: DataFrame, bank: DataFrame) -> DataFrame:
    """(unit, bank, en, fa, note): terms of several banks (bank, seq, en, fa, note) that stand in a text; of a term listed twice in a bank the first counts."""
    first = bank.groupBy("bank", "en").agg(F.min(F.struct("seq", "fa", "note")).alias("f")).select("bank", "en", "f.fa", "f.note")
    hits = term_hits(texts, first.select(F.col("en").alias("term")).distinct())
    return hits.select("unit", F.col("term").alias("en")).distinct().join(first, "en").select("unit", "bank", "en", "fa", "note")
