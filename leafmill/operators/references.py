"""References to records that do not exist.

References are pre-aggregated per key and period before they meet the registry
of records, so a key that holds a third of all references enters that join as a
few rows. Only the buckets that hold an orphan go back to the references: the
heaviest of them, at most ``MAX_HEAVY``, by broadcast, the rest by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket with this many references is heavy ...
HEAVY_ROWS = 10_000
#: ... and at most so many heavy buckets are broadcast; the others are shuffled.
MAX_HEAVY = 10_000


def reference_key(column: Column) -> Column:
    """The spelling under which ids are compared: trimmed, lower case, no ``#...``."""
    bare = F.regexp_replace(F.lower(column), r"(?s)#.*$", "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def record_registry(records: DataFrame) -> DataFrame:
    """One row per (owner, id): when it was first loaded and when it was deleted.

    ``records`` has owner, id, loaded_at, deleted_at, a row per delivery. The
    earliest loaded_at counts, and the deleted_at of the latest delivery (of
    equals the one that has a date). Records without an owner or id are left out;
    a record without any loaded_at counts as loaded all along.
    """
    keyed = records.select("owner", reference_key(F.col("id")).alias("ref_id"), "loaded_at", "deleted_at")
    return (
        keyed.where("owner is not null and ref_id is not null")
        .groupBy("owner", "ref_id")
        .agg(
            F.min("loaded_at").alias("loaded_at"),
            F.max(F.struct("loaded_at", "deleted_at"))["deleted_at"].alias("deleted_at"),
        )
    )


def references_once(references: DataFrame) -> DataFrame:
    """Non-null references with their compared spelling and period, each key once.

    ``references`` has ref_table, ref_key, owner, ref_id, seen_at. Repeated rows
    of a key count once, the one with the greatest values. References whose value
    is null refer to nothing and are left out.
    """
    columns = ["owner", "ref_id", "seen_at"]
    return (
        references.where("ref_id is not null")
        .withColumn("ref_id", reference_key(F.col("ref_id")))
        .groupBy("ref_table", "ref_key")
        .agg(F.max(F.struct(*columns)).alias("r"))
        .select("ref_table", "ref_key", "r.*")
        .withColumn("period", F.date_trunc("month", "seen_at"))
    )


def _missing_at(seen: Column) -> Column:
    return (
        F.col("absent")
        | F.coalesce(F.col("loaded_at") > seen, F.lit(False))
        | F.coalesce(F.col("deleted_at") <= seen, F.lit(False))
    )


def judged_buckets(references: DataFrame, records: DataFrame) -> DataFrame:
    """References per key and period with the life of the record they name.

    ``some`` tells whether the bucket holds an orphan.
    """
    buckets = references.groupBy("ref_table", "owner", "ref_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    known = record_registry(records).withColumn("known", F.lit(True))
    first, last = F.col("first_seen"), F.col("last_seen")
    loaded, deleted = F.col("loaded_at"), F.col("deleted_at")
    no = F.lit(False)
    joined = buckets.join(known, ["owner", "ref_id"], "left").withColumn("absent", F.col("known").isNull())
    return joined.withColumn(
        "some", F.col("absent") | F.coalesce(loaded > first, no) | F.coalesce(deleted <= last, no)
    )


def orphan_references(references: DataFrame, records: DataFrame) -> DataFrame:
    """Every reference whose record is absent, not yet loaded or already deleted.

    Returns ref_table, ref_key, ref_id, period, reason. A null owner names no
    record, so such references are orphans. Without a seen_at only an absent
    record makes an orphan. Empty inputs give no rows.
    """
    once = references_once(references)
    bad = judged_buckets(once, records).where("some").select(
        "ref_table", "owner", "ref_id", "period", "n", "absent", "loaded_at", "deleted_at"
    )
    heavy = bad.where(F.col("n") >= HEAVY_ROWS).orderBy(F.desc("n"), "ref_table", "owner", "ref_id", "period")
    heavy = heavy.limit(MAX_HEAVY).withColumn("heavy", F.lit(True))
    key = ["ref_table", "owner", "ref_id", "period"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    r, h = once.alias("r"), F.broadcast(heavy).alias("h")
    marked = r.join(h, same(once, heavy), "left").select(
        "r.*", "h.absent", "h.loaded_at", "h.deleted_at", F.col("h.heavy").isNotNull().alias("heavy")
    )
    from_heavy = marked.where("heavy").select(*once.columns, "absent", "loaded_at", "deleted_at")
    rest = once.alias("r").join(F.broadcast(heavy.select(*key)).alias("h"), same(once, heavy), "left_anti")
    b = bad.alias("b")
    from_rest = rest.alias("r").join(b, [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]).select(
        "r.*", "b.absent", "b.loaded_at", "b.deleted_at"
    )
    reason = (
        F.when(F.col("absent"), "absent").when(F.col("loaded_at") > F.col("seen_at"), "not yet loaded").otherwise("deleted")
    )
    return (
        from_heavy.unionByName(from_rest)
        .where(_missing_at(F.col("seen_at")))
        .select("ref_table", "ref_key", "ref_id", "period", reason.alias("reason"))
    )


def orphan_counts(references: DataFrame, records: DataFrame) -> DataFrame:
    """References and orphans per table and period (month of seen_at, null kept)."""
    once = references_once(references)
    orphans = orphan_references(references, records).groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"))
    totals = once.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("references"))
    t, o = totals.alias("t"), orphans.alias("o")
    on = (F.col("t.ref_table") == F.col("o.ref_table")) & F.col("t.period").eqNullSafe(F.col("o.period"))
    return t.join(o, on, "left").select(
        "t.ref_table", "t.period", "t.references", F.coalesce("o.orphans", F.lit(0)).alias("orphans")
    )
