"""Greedy cuts of ordered groups, in ranges: a fold over a group of any size without one task that holds it.

A cut depends on all rows before it, but a range of rows asks little of them: where its
first cut falls, since from there on nothing before counts. So every range is
summarised as its rows up to the latest place of a first cut and, for each of them, what
follows if a piece begins there. The summaries of a group's ranges are combined in
order, which gives each range the state it begins with, and each range is then cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpoint, small_or_shuffled

#: (number of the open piece, its size, whether it holds prose, whether it holds a row).
State = tuple[int, int, bool, bool]
#: (size, prose, filled, cost, opens, row is prose) -> whether a piece ends before the row, and whether one ends behind it.
Rule = Callable[[int, bool, bool, int, bool, bool], tuple[bool, bool]]
Row = tuple[int, bool, bool]
FRESH: State = (1, 0, False, False)


def _step(rule: Rule, state: State, row: Row) -> tuple[State, int, bool]:
    """The state behind a row, the row's piece, and whether a piece began at the row."""
    no, size, prose, filled = state
    cost, opens, own = row
    before, _ = rule(size, prose, filled, cost, opens, own)
    if before:
        no, size, prose, filled = no + 1, 0, False, False
    _, behind = rule(size, prose, filled, cost, opens, own)
    return ((no + 1, 0, False, False) if behind else (no, size + cost, prose or own, True)), no, before


def _until(rule: Rule, rows: list[Row], at: int, state: State) -> tuple[int, State]:
    """The next place where a piece begins, or the rows' end, and the state there."""
    while at < len(rows):
        after, no, began = _step(rule, state, rows[at])
        if began:
            return at, (no, 0, False, False)
        at += 1
        state = after
        if not state[3]:
            return at, state
    return at, state


def summary(rule: Rule, rows: list[Row]) -> tuple[list[Row], list[State]]:
    """The rows up to the latest first cut and the one behind it, and for each of them the state at the end if a piece (number 0) begins there."""
    latest, _ = _until(rule, rows, 0, (0, 0, False, True))
    ends: list[State] = [(0, 0, False, False)] * (len(rows) + 1)
    for at in range(len(rows) - 1, -1, -1):
        # the first row of a piece never ends it before itself
        after, _, _ = _step(rule, (0, 0, False, False), rows[at])
        to, state = (at + 1, after) if not after[3] else _until(rule, rows, at + 1, after)
        no, *rest = ends[to] if to < len(rows) else (0, *state[1:])
        ends[at] = (state[0] + no, *rest)
    return rows[: latest + 1], ends[: latest + 2]


def handed_on(rule: Rule, state: State, rows: list[Row], ends: list[State]) -> State:
    """The state behind a range that begins with ``state``."""
    if not state[3]:
        return (state[0] + ends[0][0], *ends[0][1:])
    at, state = _until(rule, rows, 0, state)
    if state[3]:  # no piece began in the range
        return state
    return (state[0] + ends[at][0], *ends[at][1:])


def pieces(rule: Rule, rows: list[Row], state: State = FRESH) -> list[int]:
    """The piece of each row."""
    out = []
    for row in rows:
        state, no, _ = _step(rule, state, row)
        out.append(no)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Row], list[tuple]]]:
    """(group, rows, keys) of each run of a partition; columns are slice, group, pos, id, cost, opens, prose."""
    run, group, rows, keys = None, None, [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for part, g, pos, id_, cost, opens, prose in zip(*columns, strict=True):
            if run is not None and run != (part, g):
                yield group, rows, keys
                rows, keys = [], []
            run, group = (part, g), g
            rows.append((cost, opens, prose))
            keys.append((part, pos, id_))
    if run is not None:
        yield group, rows, keys


def cut_in_ranges(rows: DataFrame, rule: Rule) -> DataFrame:
    """(by, pos, id, no): the piece, from 1, of each row of (by, pos, id, cost, opens, prose).

    Order is pos, then id. Null costs and flags count as 0 and false. Groups are cut apart.
    """
    narrow = rows.select("by", "pos", "id", F.coalesce(F.col("cost").cast("int"), F.lit(0)).alias("cost"), F.coalesce("opens", F.lit(False)).alias("opens"), F.coalesce("prose", F.lit(False)).alias("prose"))
    ordered = narrow.repartitionByRange("by", "pos", "id").sortWithinPartitions("by", "pos", "id")
    ordered = checkpoint(ordered.select(F.spark_partition_id().alias("slice"), "by", "pos", "id", "cost", "opens", "prose"))
    kinds = dict(rows.dtypes)
    row = "array<struct<cost:int,opens:boolean,prose:boolean>>"
    state = "struct<no:int,size:int,prose:boolean,filled:boolean>"
    names = ("no", "size", "prose", "filled")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, held, keys in _groups(batches):
            first, ends = summary(rule, held)
            shown = [dict(zip(("cost", "opens", "prose"), r, strict=True)) for r in first]
            yield pa.RecordBatch.from_pylist([{"slice": keys[0][0], "by": group, "rows": shown, "ends": [dict(zip(names, e, strict=True)) for e in ends]}], schema=summaries)

    summaries = pa.schema([("slice", pa.int32()), ("by", pa.string()), ("rows", pa.list_(pa.struct([("cost", pa.int32()), ("opens", pa.bool_()), ("prose", pa.bool_())]))), ("ends", pa.list_(pa.struct([("no", pa.int32()), ("size", pa.int32()), ("prose", pa.bool_()), ("filled", pa.bool_())])))])
    found = ordered.mapInArrow(summarise, f"slice int, by {kinds['by']}, rows {row}, ends array<{state}>")

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        out, now = [], FRESH
        for r in part.sort_values("slice").itertuples(index=False):
            out.append((r.slice, r.by, *now))
            now = handed_on(rule, now, [(x["cost"], x["opens"], x["prose"]) for x in r.rows], [tuple(e[n] for n in names) for e in r.ends])
        return pd.DataFrame(out, columns=["slice", "by", *names])

    # groups within one range need no state; of the others a row per range comes together
    found = checkpoint(found)
    many = found.groupBy("by").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("by")
    f, m = found.alias("f"), many.alias("m")
    entries = checkpoint(f.join(m, F.col("f.by").eqNullSafe(F.col("m.by")), "left_semi").groupBy("by").applyInPandas(combine, f"slice int, by {kinds['by']}, no int, size int, prose boolean, filled boolean"))
    # at most two of them in a slice: the group it begins with, and the one it ends with
    begins = entries.groupBy("slice").agg(F.collect_list(F.struct("by", *names)).alias("entries"))
    joined = ordered.join(F.broadcast(begins), "slice", "left") if begins.count() <= 100_000 else ordered.join(begins, "slice", "left").sortWithinPartitions("slice", "by", "pos", "id")

    at = {"int": pa.int32(), "bigint": pa.int64()}[kinds["pos"]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state_of: dict[tuple, State] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, held in zip(batch.column("slice").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                    for e in held or ():
                        state_of.setdefault((part, e["by"]), tuple(e[n] for n in names))
                yield batch

        for group, held, keys in _groups(seen()):
            state_ = state_of.get((keys[0][0], group), FRESH)
            cut = pieces(rule, held, state_)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(held), pa.string()), pa.array([k[1] for k in keys], at), pa.array([k[2] for k in keys], pa.string()), pa.array(cut, pa.int32())], names=["by", "pos", "id", "no"])

    return joined.select("slice", "by", "pos", "id", "cost", "opens", "prose", "entries").mapInArrow(apply, f"by {kinds['by']}, pos {kinds['pos']}, id {kinds['id']}, no int")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place, from 1, in its group's order; a group of any size is numbered in ranges.

    ``order`` should tell all rows of a group apart; rows that are equal in it are numbered in any order. Null groups are groups.
    """
    ordered = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ordered = checkpoint(ordered.withColumn("slice_", F.spark_partition_id()))
    counts = checkpoint(ordered.groupBy(*by, "slice_").agg(F.count(F.lit(1)).alias("n_")))
    earlier = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "slice_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("offset_"))
    within = F.row_number().over(Window.partitionBy(*by, "slice_").orderBy(*order))
    o, f = ordered.withColumn("within_", within).alias("o"), small_or_shuffled(offsets, counts.count()).alias("f")
    on = F.col("o.slice_") == F.col("f.slice_")
    for c in by:
        on &= F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}"))
    return o.join(f, on).select(*[F.col(f"o.{c}") for c in df.columns], (F.col("o.within_") + F.col("f.offset_")).alias(name))
