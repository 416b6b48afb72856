"""Lines repeated across the documents of one source.

Method: every input partition keeps, per source, a summary of its heavy lines
(lossy counting, so its size is bounded by lines per document / ``EPSILON``).
Summaries add up, each with the most it may have missed, and every line that can
still reach the threshold becomes a candidate. A second pass counts candidates
exactly, and confirmed lines travel back to the documents as broadcast sets.

No line at the threshold is lost: a line in ``share`` of a source's documents is
in ``share`` of them in at least one partition, which is above what that
partition's summary may drop.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import checkpoint, small_or_shuffled

#: Share of a source's documents in which a repeated line stands, and the least number of them.
SHARE, LEAST = 0.03, 4
#: Share of the documents by which a summary may undercount.
EPSILON = SHARE / 2


def content_lines(text: Column) -> Column:
    """The content of each line: trimmed, case folded, one space and one digit for each run of them."""
    flat = F.regexp_replace(text, r"(?U)[\s&&[^\n]]+", " ")
    flat = F.regexp_replace(flat, r"\p{Nd}+", "0")
    return F.transform(F.split(F.lower(F.upper(flat)), "\n"), lambda x: F.trim(x))


def line_keys(text: Column) -> Column:
    """A 64-bit key of each line's content in order, null for lines without a letter."""
    return F.transform(content_lines(text), lambda x: F.when(x.rlike(r"\p{L}"), F.xxhash64(x)))


def _summarise(batches: Iterator[pa.RecordBatch], epsilon: float) -> Iterator[pa.RecordBatch]:
    """Rows (source, key, least, most): of each heavy line, and with a null key of each source.

    ``least`` is the count seen. For lines ``most`` is what more there may be,
    less what the source's own row says was missed of any line.
    """
    held: dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        keys = batch.column("keys")
        rows = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
        flat = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        codes = batch.column("source").dictionary_encode()
        names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(names):
            docs, old_keys, old_counts, old_missed = held.get(name, (0, *[np.empty(0, np.int64)] * 3))
            new_keys, new_counts = np.unique(flat[of[rows] == code], return_counts=True)
            all_keys, where = np.unique(np.concatenate([old_keys, new_keys]), return_inverse=True)
            counts, missed = np.zeros(len(all_keys), np.int64), np.full(len(all_keys), math.floor(epsilon * docs))
            np.add.at(counts, where, np.concatenate([old_counts, new_counts]))
            missed[where[: len(old_keys)]] = old_missed
            docs += int((of == code).sum())
            keep = counts + missed > math.floor(epsilon * docs)
            held[name] = docs, all_keys[keep], counts[keep], missed[keep]
    names = ["source", "key", "least", "most"]
    for name, (docs, keys, counts, missed) in held.items():
        dropped = math.floor(epsilon * docs)
        n = len(keys) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, pa.string()),
                pa.array([None, *keys.tolist()], pa.int64()),
                pa.array(np.concatenate([[docs], counts]).astype(np.int64)),
                pa.array(np.concatenate([[dropped], missed - dropped]).astype(np.int64)),
            ],
            names=names,
        )


def candidate_lines(keyed: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(source, key) of every line that may stand in ``share`` of the source's documents."""
    epsilon = share / 2
    lists = keyed.select("source", F.array_distinct(F.filter("keys", lambda x: x.isNotNull())).alias("keys"))
    summaries = lists.mapInArrow(lambda batches: _summarise(batches, epsilon), "source string, key long, least long, most long")
    merged = summaries.groupBy("source", "key").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))
    merged = checkpoint(merged)
    sources = merged.where("key is null").select("source", F.col("least").alias("docs"), F.col("most").alias("dropped"))
    lines = merged.where("key is not null")
    return lines.join(sources, "source").where(
        F.col("least") + F.col("most") + F.col("dropped") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("docs") - 1e-9))
    ).select("source", "key")


def keyed_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source and line keys of every document that has a source and a text."""
    known = documents.where("source is not null and text is not null")
    return known.select("doc_id", "source", line_keys(F.col("text")).alias("keys"))


def confirmed_lines(keyed: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(source, key, documents) of the lines that exact counts confirm."""
    candidates = checkpoint(candidate_lines(keyed, share, least))
    hits = _hits(keyed, candidates)
    counts = hits.groupBy("source", "key").agg(F.countDistinct("doc_id").alias("documents"))
    docs = keyed.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    needed = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("docs") - 1e-9))
    return counts.join(docs, "source").where(F.col("documents") >= needed).select("source", "key", "documents")


def _hits(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    exploded = keyed.select("doc_id", "source", F.posexplode("keys").alias("at", "key")).where("key is not null")
    return exploded.join(small_or_shuffled(lines), ["source", "key"])


def repeated_lines(documents: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, key) of every line that its source repeats, each once.

    ``documents`` has doc_id, source, text. Documents with a null source or text
    have no such lines; repeated rows of a document count once; an empty table
    gives no rows. Lines are numbered from 1.
    """
    keyed = checkpoint(keyed_documents(documents))
    confirmed = checkpoint(confirmed_lines(keyed, share, least))
    found = _hits(keyed, confirmed.select("source", "key"))
    return found.select("doc_id", (F.col("at") + 1).cast("int").alias("line_no"), "key").distinct()


def without_repeated_lines(documents: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``documents`` with ``text_clean``, the text without the lines its source repeats, and ``lines_removed``.

    Texts stay where they are: per source the set of confirmed keys, at most
    lines per document / share of them, is joined to the rows. A null text or
    source leaves the text as it is.
    """
    keyed = checkpoint(keyed_documents(documents))
    confirmed = confirmed_lines(keyed, share, least)
    sets = checkpoint(confirmed.groupBy("source").agg(F.collect_set("key").alias("__removed")))
    joined = documents.join(small_or_shuffled(sets, limit=10_000), "source", "left")
    lines, keys = F.split("text", "\n"), line_keys(F.col("text"))
    zipped = F.arrays_zip(lines.alias("line"), keys.alias("key"))
    kept = F.filter(zipped, lambda x: F.coalesce(~F.array_contains("__removed", x["key"]), F.lit(True)))
    clean = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    removed = F.when(F.col("__removed").isNull() | F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return joined.select(*[joined[c] for c in documents.columns], clean.alias("text_clean"), removed.alias("lines_removed"))
