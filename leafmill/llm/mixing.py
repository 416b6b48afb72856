"""Mixing sources to target weights.

Every source's documents fall into blocks by a seeded hash, in permuted order. A
source's target is so many whole rounds of its blocks and a part of another one,
which ends inside one block at a document. The draws (block, round) of all
sources are divided among output shards by a splitting tree: at each node the
left half's draws per source come from a multivariate hypergeometric
distribution, so quotas add up exactly; each shard then takes its disjoint part
of the permuted draws and shuffles its documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranges import numbered
from leafmill.session import checkpoint

#: Blocks of a source, output shards of a mix, and the seed of all draws.
BLOCKS, SHARDS, SEED = 256, 16, 7


def block_of(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")


def split_quotas(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws per shard (rows) and source (columns), by a tree of exact splits in halves."""
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    total = int(draws.sum())
    taken = rng.multivariate_hypergeometric(draws, round(total * left / shards), method="marginals")
    return np.vstack([split_quotas(taken, left, rng), split_quotas(draws - taken, shards - left, rng)])


def _plan(targets: list, sizes: dict, total: int, blocks: int, shards: int, seed: int) -> tuple[list, list]:
    """Rows of the draw table, and per mix and source the target and the block where its part ends."""
    draws_rows, parts = [], []
    mixes: dict[str, list] = {}
    for row in targets:
        mixes.setdefault(row.mix_name, []).append(row)
    for m, (mix, rows) in enumerate(sorted(mixes.items())):
        weights = sum(r.weight for r in rows) or 1.0
        counts, order = [], []
        for row in sorted(rows, key=lambda r: r.source):
            rng = np.random.default_rng([seed, m, len(order)])
            own = sizes.get(row.source, {})
            held = sum(own.values())
            wanted = row.weight / weights * row.total_share * total
            rounds = min(row.max_repeats, int(wanted // held)) if held else 0
            rest = wanted - rounds * held if rounds < row.max_repeats and held else 0.0
            permuted = rng.permutation(sorted(own)) if own else np.empty(0, int)
            last, within, passed = None, 0.0, 0.0
            drawn = [(int(b), k) for k in range(1, rounds + 1) for b in permuted]
            for b in permuted:
                if rest <= passed:
                    break
                drawn.append((int(b), rounds + 1))
                if rest < passed + own[int(b)]:
                    last, within = int(b), rest - passed
                    break
                passed += own[int(b)]
            parts.append((mix, row.source, wanted, rounds, last, within))
            counts.append(len(drawn))
            order.append((row.source, [drawn[i] for i in rng.permutation(len(drawn))]))
        quotas = split_quotas(np.array(counts, np.int64), shards, np.random.default_rng([seed, m])) if counts else []
        ends = np.cumsum(quotas, axis=0)
        for s, (source, drawn) in enumerate(order):
            for k, (block, round_no) in enumerate(drawn):
                draws_rows.append((mix, source, block, round_no, int(np.searchsorted(ends[:, s], k, "right"))))
    return draws_rows, parts


def mixed(items: DataFrame, targets: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Draws (mix_name, source, doc_id, round_no, shard, place, tokens), and per mix and source what was wanted.

    ``items`` has doc_id, source, tokens, one row per doc_id; ``targets`` has
    mix_name, source, weight, max_repeats, total_share and is a table of settings.
    Weights count relative to their sum in the mix; repeated rows count once.
    Sources without documents, or too small for their target even at max_repeats,
    give what they have. Documents are never divided, so a source misses its
    target by less than one document. Null sources, weights or sizes take no part.
    """
    spark = items.sparkSession
    known = items.where("source is not null and tokens is not null").withColumn("block", block_of(F.col("doc_id"), blocks, seed))
    known = checkpoint(known.select("doc_id", "source", "tokens", "block"))
    wanted = targets.where("mix_name is not null and source is not null and weight >= 0 and max_repeats >= 0 and total_share >= 0")
    wanted = wanted.groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("total_share").alias("total_share"))
    rows = wanted.collect()
    named = known.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi")
    sizes: dict[str, dict[int, int]] = {}
    for row in named.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect():  # BLOCKS numbers a source
        sizes.setdefault(row.source, {})[row.block] = row.tokens
    total = known.agg(F.sum("tokens")).first()[0] or 0
    draws, parts = _plan(rows, sizes, total, blocks, shards, seed)
    table = spark.createDataFrame(draws, "mix_name string, source string, block int, round_no int, shard int")
    goals = spark.createDataFrame(parts, "mix_name string, source string, wanted double, rounds int, last_block int, within double")
    drawn = named.join(F.broadcast(table), ["source", "block"]).join(F.broadcast(goals), ["mix_name", "source"])
    # the block where a part ends is taken in hashed order up to the document that passes the target
    partial = (F.col("block") == F.col("last_block")) & (F.col("round_no") > F.col("rounds"))
    partial = F.coalesce(partial, F.lit(False))
    columns = ["mix_name", "source", "doc_id", "round_no", "shard", "tokens"]
    # (the last block of a source is one of ``blocks``, narrow rows)
    order = Window.partitionBy("mix_name", "source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ending = drawn.where(partial).withColumn("passed", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    # the last document is taken if that comes closer to the target than leaving it
    ending = ending.where(F.col("passed") + F.col("tokens") / 2 <= F.col("within"))
    chosen = drawn.where(~partial).select(*columns).unionByName(ending.select(*columns))
    place = F.xxhash64("mix_name", "doc_id", "round_no", F.lit(seed)).alias("place")
    return chosen.select("*", place), goals.select("mix_name", "source", "wanted").withColumn("total", F.lit(math.floor(total)))


def shuffled_shards(draws: DataFrame) -> DataFrame:
    """The draws of each shard in shuffled order: position counts from 1 within a shard, numbered in ranges of any size."""
    return numbered(draws, ["mix_name", "shard"], ["place", "doc_id", "round_no"], "position")
