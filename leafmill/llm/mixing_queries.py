"""Queries on mixes of sources (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.mixing import mixed, shuffled_shards
from leafmill.llm.tokens import token_counts
from leafmill.session import checkpoint, read_table


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, folder, "documents", ["doc_id", "source", "text"])
    items = checkpoint(token_counts(documents, "doc_id", "text", ["source"]))
    return mixed(items, read_table(spark, folder, "mix_targets"))


def p9_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix and how often each is taken."""
    draws, _ = _mixed(spark, folder)
    return draws.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_repeats"), F.max("tokens").alias("n_tokens"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and actual tokens and shares of each source in each mix."""
    draws, goals = _mixed(spark, folder)
    actual = draws.groupBy("mix_name", "source").agg(F.sum("tokens").alias("actual"))
    joined = goals.join(actual, ["mix_name", "source"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    sums = joined.groupBy("mix_name").agg(F.sum("wanted").alias("all_wanted"), F.sum("actual").alias("all_actual"))
    both = joined.join(F.broadcast(sums), "mix_name")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return both.select(
        "mix_name", "source", F.col("wanted").alias("wanted_tokens"), F.col("actual").alias("actual_tokens"),
        share("wanted", "all_wanted").alias("target_share"), share("actual", "all_actual").alias("actual_share"),
    )


def p9_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The draws of each output shard in shuffled order."""
    draws, _ = _mixed(spark, folder)
    return shuffled_shards(draws).select("mix_name", "shard", "position", "doc_id", "round_no")


QUERIES = {"p9_chosen": p9_chosen, "p9_shares": p9_shares, "p9_shards": p9_shards}
ORACLE: dict[str, str] = {}
