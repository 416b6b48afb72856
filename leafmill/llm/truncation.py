"""Values that lost their end on the way.

A value that is a strict prefix of a longer copy of the same source text was cut.
All deliveries are sorted by source text and value, so a value has a longer copy
exactly if the next different value in its source's order starts with it: no pairs
are made, and the sort splits any hot source text. Last words are compared with all
words in the same way: one that stands nowhere as a whole word but begins others was
cut inside. Where no copy exists, a value is held against its own source text, its
channel's limits and the marks that stand where something broke off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpoint, small_or_shuffled

#: A length is a channel's limit if so many values have it, and so many times the mean of lengths nearby more.
LIMIT_LEAST, LIMIT_TIMES, NEARBY = 5, 6, 12
#: Characters at the end that are looked at first; where they do not settle the question the whole text is read.
TAIL = 100
#: Share of the book's usual target-to-source length below which a value is short.
SHORT, SHORTER = 0.97, 0.85

# Marks that stand where a value broke off, and marks that end a sentence.
BREAK = r"(?U)\s*(?:\[(?:\.\.\.|…)\]|…|\.\.\.|--|—|�)+\s*$"
WRAP = r"(?U)(?:[\s*_]|\[\[fn:[^\]]*\]\])+$"
SETTLED = r"(?U)\s\S+\s+\S*\p{L}\S*\s+\S*\p{L}"
ENDS = r"[.!?؟。！？।…:؛;][»”“\"'’)\]』」]*$"


def _tail(text: Column) -> Column:
    """A text without its closing white space, emphasis and note tokens, or the end of it.

    The last ``TAIL`` characters are enough if what is left of them has three
    words, a letter and no note token that began before; else the whole text is taken.
    """
    bare = F.rtrim(text, F.lit(" \t\n\r\u00a0*_"))
    near = F.regexp_replace(F.right(bare, F.lit(TAIL)), WRAP, "")
    settled = (F.length(bare) <= TAIL) | (near.rlike(SETTLED) & ~near.endswith("]]"))
    return F.when(settled, near).otherwise(F.regexp_replace(bare, WRAP, ""))


def _ended(tail: Column) -> Column:
    return tail.rlike(ENDS)


def _broken(tail: Column) -> Column:
    return tail.rlike(BREAK)


def _words_only(text: Column) -> Column:
    """Words one space apart, without the punctuation around them."""
    return F.trim(F.regexp_replace(text, r"(?U)(?:^|(?<=\s))\p{P}+|\p{P}*\s+\p{P}*|\p{P}+$", " "))


def measured(rows: DataFrame, key: str, owner: str, channel: str, source: str, target: str, version: str) -> DataFrame:
    """What is asked of each row, narrow and one row per key (the latest version).

    Rows whose target is null or blank are left out after the latest was chosen;
    a null source text has no end and no length.
    """
    text, value = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    text_tail, tail = _tail(text), _tail(value)
    words = F.split(_words_only(F.regexp_replace(tail, BREAK, "")), " +")
    no_mark = F.rtrim(value, F.lit("�"))
    facts = F.struct(
        F.col(version).alias("version"),
        F.col(owner).alias("owner"),
        F.col(channel).alias("channel"),
        F.length(F.trim(value)).alias("filled"),
        F.xxhash64(value).alias("wording"),
        F.length(value).alias("chars"),
        F.octet_length(no_mark).alias("bytes"),
        F.length(text).alias("source_chars"),
        F.size(F.split(F.trim(text), r"\n")).alias("source_lines"),
        F.size(F.split(F.trim(value), r"\n")).alias("lines"),
        _ended(text_tail).alias("source_ended"),
        (_ended(tail) & ~(_broken(tail) & ~_broken(text_tail))).alias("ended"),
        (_broken(tail) & ~_broken(text_tail)).alias("broken"),
        F.right(value, F.lit(1)).rlike(r"(?U)\s").alias("loose"),
        (value.startswith("*") & value.endswith("*")).alias("closed"),
        F.element_at(words, -1).alias("last"),
    )
    latest = rows.select(F.col(key).alias("key"), facts.alias("f")).groupBy("key").agg(F.max("f").alias("f"))
    return latest.select("key", "f.*").where("filled > 0")


def channel_limits(measures: DataFrame) -> DataFrame:
    """(channel, unit, size): lengths, in characters or bytes, at which a channel cuts.

    Far more values end at a limit than at lengths nearby. Counts are taken over
    unfinished values: not ended though their source is, or broken.
    """
    open_ended = measures.where((F.col("source_ended") & ~F.col("ended")) | F.col("broken"))
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    counts = open_ended.select("channel", F.explode(units).alias("u")).groupBy("channel", "u.unit", "u.size").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("channel", "unit").orderBy("size").rangeBetween(-NEARBY, NEARBY)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEARBY)
    return counts.withColumn("around", around).where(F.col("n") >= LIMIT_LEAST + LIMIT_TIMES * F.col("around")).select("channel", "unit", "size")


def _starting(values: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``values`` with ``probe`` that are a strict prefix of the next row of the same ``by`` without it.

    ``values`` has ``by``, value and probe (null for what may be the longer one; a
    probe sorts behind its equal). One sort over all partitions, which splits any
    value of ``by``; the first rows of each partition, one for each, close the gap
    to the partition before.
    """
    order = [*by, "value", F.col("probe").isNotNull()]
    ordered = values.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = checkpoint(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("slice", F.shiftright("at", 33))
    longer = F.when(F.col("probe").isNull(), F.struct(*by, "value"))
    behind = Window.partitionBy("slice").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = ordered.groupBy("slice").agg(F.min(F.when(F.col("probe").isNull(), F.struct("at", *by, "value"))).alias("f"))
    later = Window.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # a row per partition
    first = F.when(F.col("f").isNotNull(), F.struct(*[F.col(f"f.{c}") for c in (*by, "value")]))
    firsts = firsts.select("slice", F.first(first, ignorenulls=True).over(later).alias("later"))
    probed = ordered.withColumn("next", F.last(longer, ignorenulls=True).over(behind)).where("probe is not null").join(F.broadcast(firsts), "slice", "left")
    probed = probed.withColumn("next", F.coalesce("next", "later"))
    same = F.lit(True)
    for c in by:
        same &= F.col(f"next.{c}") == F.col(c)
    return probed.where(same & F.col("next.value").startswith(F.col("value")) & (F.length("next.value") > F.length("value")))


def longer_copies(deliveries: DataFrame, suspects: DataFrame) -> DataFrame:
    """Keys of ``suspects`` (key, of, value) whose value is a strict prefix of another value of the same ``of``.

    ``deliveries`` has of and value; ``of`` tells the source text. Blank values are
    a prefix of anything and never count.
    """
    nothing = F.lit(None).cast(dict(suspects.dtypes)["key"])
    every = deliveries.distinct().select("of", "value", nothing.alias("probe"))
    probes = suspects.where(F.trim("value") != "").select("of", "value", F.col("key").alias("probe"))
    return _starting(every.unionByName(probes), ["of"]).select(F.col("probe").alias("key")).distinct()


def divided_words(words: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (value) that are no word of ``words`` (value) but a strict prefix of one."""
    unknown = parts.join(words, "value", "left_anti")
    every = words.select("value", F.lit(None).cast("string").alias("probe")).unionByName(unknown.select("value", F.col("value").alias("probe")))
    return _starting(every, []).select("value").distinct()


def inner_words(rows: DataFrame, target: str) -> DataFrame:
    """(value) every distinct word of all targets but their last ones."""
    split = rows.where(F.col(target).isNotNull()).select(F.split(_words_only(F.col(target)), " +").alias("w"))
    return split.select(F.explode(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1))).alias("value")).distinct()


def truncated(rows: DataFrame, key: str, owner: str, channel: str, source: str, target: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(key, channel) of every row that was cut, and of every row with a target; one row per key.

    A row is cut if a longer copy of its value exists for the same source text, or
    if a break mark ends it, or if its source text goes on: the source ends its
    sentence and the target does not, or has more lines, or the target is short for
    its book and ends at its channel's limit, before white space or inside a word.
    Empty tables give no rows; rows without a source text are only cut at a break mark.
    """
    m = checkpoint(measured(rows, key, owner, channel, source, target, version))
    whole = m.where("ended and source_ended and source_chars >= 40")
    usual = whole.groupBy("owner").agg(F.percentile_approx(F.try_divide("chars", "source_chars"), 0.5, 1000).alias("usual"))
    usual, limits = checkpoint(usual), checkpoint(channel_limits(m))
    chars = limits.where("unit = 'chars'").select("channel", F.col("size").alias("chars"), F.lit(True).alias("full_chars")).distinct()
    reach = F.explode(F.sequence(F.col("size") - 3, F.col("size")))
    bytes_ = limits.where("unit = 'bytes'").select("channel", reach.alias("bytes"), F.lit(True).alias("full_bytes")).distinct()
    j = m.join(small_or_shuffled(usual), "owner", "left")
    j = j.join(small_or_shuffled(chars), ["channel", "chars"], "left").join(small_or_shuffled(bytes_), ["channel", "bytes"], "left")
    j = j.withColumn("full", F.coalesce("full_chars", "full_bytes", F.lit(False)) & ~F.col("closed"))
    j = j.withColumn("ratio", F.coalesce(F.try_divide(F.try_divide("chars", "source_chars"), "usual"), F.lit(1.0)))
    copied = checkpoint(_copied(rows, m, key, source, target))
    open_ended = j.where(~F.col("ended") & (F.col("ratio") < SHORTER) & ~F.col("full") & (F.length("last") > 0))
    inside = divided_words(inner_words(rows, target), open_ended.select(F.col("last").alias("value")).distinct())
    inside = checkpoint(inside).select(F.col("value").alias("last"), F.lit(True).alias("mid_word"))
    j = j.join(copied.withColumn("copied", F.lit(True)), "key", "left").join(small_or_shuffled(inside), "last", "left")
    short = F.col("ratio") < F.when(F.col("loose"), SHORT).otherwise(SHORTER)
    cut = (
        F.coalesce("copied", F.lit(False))
        | F.col("broken")
        | (F.col("source_ended") & ~F.col("ended") & (F.col("source_chars") > 0))
        | (~F.col("ended") & (F.col("lines") < F.col("source_lines")))
        | (F.col("ended") & (F.col("full") | F.col("loose")) & short)
        | (~F.col("ended") & (F.col("full") | F.coalesce("mid_word", F.lit(False))) & (F.col("ratio") < SHORTER))
    )
    return j.where(cut).select("key", "channel"), m.select("key", "channel")


def _copied(rows: DataFrame, latest: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """(key) of the latest values that some delivery for the same source text continues.

    Break marks count on neither side, so a value is no copy of itself without its
    mark. Source texts are told by two hashes. Only values whose source stands in more
    than one delivery with other wording move as texts; sources are compared as hashes.
    """
    text = F.col(source)
    of = F.struct(F.xxhash64(text), F.xxhash64(F.reverse(text)))
    bare = F.rtrim(F.regexp_replace(F.coalesce(F.right(F.col(target), F.lit(12)), F.lit("")), BREAK, ""))
    value = F.concat(F.substring(F.col(target), F.lit(1), F.greatest(F.lit(0), F.length(target) - 12)), bare)
    each = rows.where(F.col(target).isNotNull() & (F.trim(text) != "")).select(F.col(key).alias("key"), of.alias("of"), F.col(target).alias("value"), F.xxhash64(target).alias("wording"), value.alias("bare"))
    many = each.groupBy("of").agg((F.min("wording") != F.max("wording")).alias("more")).where("more").select("of")
    each = checkpoint(each.join(many, "of", "left_semi"))
    now = latest.select("key", F.col("wording"))
    probes = each.join(now, ["key", "wording"], "left_semi").select("key", "of", F.col("bare").alias("value")).distinct()
    return longer_copies(each.select("of", F.rtrim("bare").alias("value")), probes)


def channel_shares(cut: DataFrame, rows: DataFrame) -> DataFrame:
    """(channel, n_targets, n_cut, share_cut) from the two results of ``truncated``."""
    counts = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n_targets"))
    lost = cut.groupBy("channel").agg(F.count(F.lit(1)).alias("n_cut"))
    c, x = counts.alias("c"), lost.alias("x")
    n = F.coalesce("x.n_cut", F.lit(0))
    joined = c.join(x, F.col("c.channel").eqNullSafe(F.col("x.channel")), "left")
    return joined.select("c.channel", "c.n_targets", n.alias("n_cut"), (n / F.col("c.n_targets")).alias("share_cut"))
