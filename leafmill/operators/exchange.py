"""What goes out for translation and comes back: eligibility, order, coverage, notes, progress, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.state import components

#: States after which a job is offered again.
RETRYABLE = ["missing", "empty", "malformed", "invalid", "partial", "wrong-request", "stale-source"]


def eligibility(jobs: DataFrame, replies: DataFrame, live: DataFrame) -> DataFrame:
    """(job_id, state, retryable): the manifest against replies and the live book; the first state that holds.

    ``jobs`` has job_id, token, source_digest; ``replies`` has job_id, token,
    verdict; ``live`` has job_id, digest of the source as it is now.
    """
    r = replies.select("job_id", F.col("token").alias("reply_token"), "verdict", F.lit(True).alias("replied"))
    joined = jobs.join(r, "job_id", "left").join(live.select("job_id", "digest"), "job_id", "left")
    state = (
        F.when(F.col("replied").isNull(), "missing")
        .when(F.col("reply_token").isNull(), "unbound")
        .when(F.col("reply_token") != F.col("token"), "wrong-request")
        .when(F.col("digest").isNull(), "unverified")
        .when(F.col("digest") != F.col("source_digest"), "stale-source")
        .otherwise(F.col("verdict"))
    )
    return joined.select("job_id", state.alias("state")).withColumn("retryable", F.col("state").isin(RETRYABLE))


def committing_jobs(states: DataFrame, owners: DataFrame) -> DataFrame:
    """(job_id, commits): jobs that share a divided unit commit together, only if all are answered.

    ``owners`` has job_id, owner: the units that a job holds a part of.
    """
    first = owners.groupBy("owner").agg(F.min("job_id").alias("a"))
    edges = owners.join(first, "owner").select("a", F.col("job_id").alias("b"))
    group = components(edges)
    joined = states.join(group.select(F.col("node").alias("job_id"), "component"), "job_id", "left").withColumn("component", F.coalesce("component", "job_id"))
    whole = joined.groupBy("component").agg(F.min(F.coalesce(F.col("state") == "answered", F.lit(False))).alias("commits"))
    return joined.join(whole, "component").select("job_id", "commits")


def order_problems(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """(owner): sheets whose answered units, as far as expected, come in another order; both have owner, pos, unit."""
    listed = lambda df, name: df.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias(name))
    both = listed(expected, "want").join(listed(answered, "got"), "owner")
    wanted = F.filter("want", lambda u: F.array_contains("got", u))
    got = F.array_distinct(F.filter("got", lambda u: F.array_contains("want", u)))
    return both.where(wanted != got).select("owner")


def review_coverage(units: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(unit, problem): reviews of foreign units, units reviewed twice, units not reviewed."""
    foreign = reviewed.join(units, "unit", "left_anti").select("unit", F.lit("foreign").alias("problem")).distinct()
    twice = reviewed.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit", F.lit("twice").alias("problem"))
    lost = units.join(reviewed, "unit", "left_anti").select("unit", F.lit("missing").alias("problem"))
    return foreign.unionByName(twice).unionByName(lost)


def adopted_notes(notes: DataFrame, offered: DataFrame) -> DataFrame:
    """(book_id, reply, local_id, id, text, adopted): notes that replies offer, under their ids.

    A note known by reply and local id keeps its id; others get the next ones
    behind the highest of the book; known notes no longer offered are retired
    (adopted false). ``notes`` has book_id, id, reply, local_id.
    """
    known = notes.select("book_id", "reply", "local_id", F.col("id").alias("known_id"))
    top = notes.groupBy("book_id").agg(F.max(F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("int")).alias("top"))
    joined = offered.join(known, ["book_id", "reply", "local_id"], "left").join(top, "book_id", "left")
    place = F.row_number().over(Window.partitionBy("book_id", F.col("known_id").isNull()).orderBy("reply", "local_id"))
    fresh = F.concat(F.lit("fn"), F.lpad((F.coalesce("top", F.lit(0)) + place).cast("string"), 4, "0"))
    kept = joined.select("book_id", "reply", "local_id", F.coalesce("known_id", fresh).alias("id"), "text", F.lit(True).alias("adopted"))
    gone = known.where("reply is not null").join(offered, ["book_id", "reply", "local_id"], "left_anti")
    return kept.unionByName(gone.select("book_id", "reply", "local_id", F.col("known_id").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("adopted")))


def acceptance(conditions: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that does not hold, null if all do: named refusals in order."""
    refusal = F.lit(None).cast("string")
    for name, holds in reversed(conditions):
        refusal = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(refusal)
    return refusal


def progress(pages: DataFrame) -> DataFrame:
    """(book_id, n_pages, accepted, failed, stale, most_payload, next_page) of pages (book_id, page, state, payload)."""
    return pages.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "stale").alias("stale"), F.max("payload").alias("most_payload"), F.min(F.when(F.col("state") != "accepted", F.col("page"))).alias("next_page"),
    )


def request_tokens(sheets: DataFrame) -> DataFrame:
    """(sheet, token): a short digest of a worksheet's text without its comment lines; it moves if and only if the question does."""
    asked = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^<!--.*-->\s*$")), "\n")
    return sheets.select("sheet", F.concat(F.lit("req1:"), F.substring(F.sha2(asked, 256), 1, 16)).alias("token"))


def write_snapshot(df: DataFrame, folder: str, version: str, expected: str | None, pointer: str) -> bool:
    """Write ``df`` as a new version and point to it, if the pointer still names ``expected``; one writer at a time.

    Files never change once written; a reader follows the pointer, a one-row
    table, so it sees a whole version or none. Returns whether it was committed.
    """
    spark: SparkSession = df.sparkSession
    current = current_snapshot(spark, folder, pointer)
    if current != expected:
        return False
    df.write.mode("errorifexists").parquet(f"{folder}/{version}")
    number = int(current.split("@")[1]) + 1 if current and "@" in current else 1
    spark.createDataFrame([(f"{version}@{number}", number)], "version string, number int").coalesce(1).write.mode("append").parquet(f"{folder}/{pointer}")
    return True


def current_snapshot(spark: SparkSession, folder: str, pointer: str) -> str | None:
    """The version (with its number) that the pointer names; null before the first."""
    try:
        row = spark.read.schema("version string, number int").parquet(f"{folder}/{pointer}").agg(F.max_by("version", "number")).first()
    except Exception as error:  # noqa: BLE001  a pointer that does not exist yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return row[0]


def read_snapshot(spark: SparkSession, folder: str, pointer: str) -> DataFrame:
    version = current_snapshot(spark, folder, pointer)
    return spark.read.parquet(f"{folder}/{version.split('@')[0]}")
