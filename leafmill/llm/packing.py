"""Filling containers of fixed capacity with items.

Which sizes go together depends on how many items there are of each size only,
so the plan is made from the counts of sizes: at most as many numbers as the
capacity, however many items there are. Bin completion: a depth-first search
decides on one filling around the largest size left, and how often it is used. Only
undominated fillings are tried, none that wastes more than the incumbent allows; the
best plan so far, at first best-fit decreasing, is the incumbent, and the search ends
when it meets the lower bound. Items then find their container by their rank among
the items of their size, in order of their keys.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpoint

#: Steps of the search over all fillings of a pack; the incumbent is taken when they are used up. `fill_report` gives its distance from the bound.
NODES = 200_000

#: Steps of the search for a full container, and of the first dive's for each of its fillings.
SHORT = 500

#: One filling: ((size, items of it), ...) and the number of containers filled so.
Filling = tuple[tuple[tuple[int, int], ...], int]


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """No plan has fewer: by the sum of sizes, or by items too large to share a container, with what cannot stand beside them."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return 0
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    items, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * sizes))
    half = np.searchsorted(sizes, capacity // 2, "right")
    # items above capacity - low share with none of at least low, those over the half with none of each other
    low = np.concatenate([[0], sizes[:half]])
    cut = np.maximum(np.searchsorted(sizes, capacity - low, "right"), half)
    over_half = items[-1] - items[half]
    room = (items[cut] - items[half]) * capacity - (sums[cut] - sums[half])
    small = sums[half] - sums[np.searchsorted(sizes, low, "left")]
    return int(max(-(-sums[-1] // capacity), (over_half + np.maximum(0, -(-(small - room) // capacity))).max()))


class _Stock:
    """Items left by size: counts, the sizes that have any in order, and these sizes as bits."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.counts = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.counts)
        self.bits = sum(1 << s for s in self.sizes)

    def add(self, size: int, n: int) -> None:
        """``n`` more items of a size, or fewer if it is negative."""
        before = self.counts.get(size, 0)
        self.counts[size] = before + n
        if before and not before + n:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
            self.bits ^= 1 << size
        elif not before and n:
            bisect.insort(self.sizes, size)
            self.bits ^= 1 << size


def _smeared(bits: int, by: int) -> int:
    """``bits`` moved up by 0, 1, ... and ``by`` places, together."""
    reach = 0
    while reach < by:
        step = min(reach + 1, by - reach)
        bits |= bits << step
        reach += step
    return bits


def _dominated(chosen: list[tuple[int, int]], space: int, stock: _Stock) -> bool:
    """Whether a free item fits into ``space``, or into it together with the room of some smaller ``chosen`` ones."""
    single, several, free = 0, 0, stock.bits  # bits: sums of one chosen item, and of two or more
    for size, n in chosen:
        if n == stock.counts[size]:
            free ^= 1 << size
        for _ in range(n):
            several |= (several | single) << size
            single |= 1 << size
    if free & ((1 << space + 1) - 1) & ~1:
        return True
    larger = _smeared(single << 1, space - 1) if space else 0
    return bool((_smeared(several, space) | larger) & free)


def _ways(room: int, stock: _Stock, spare: int, steps: list[int]) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Undominated fillings of ``room``, as ((size, items), ...) and the space left, largest items first.

    None that leaves more than ``spare`` is given. ``steps`` counts down; at 0 the
    rest is left out. The stock must be the same whenever the next one is asked for.
    """
    sizes, counts = stock.sizes, stock.counts
    chosen: list[tuple[int, int]] = []
    stack: list[tuple[int, int, int, int]] = []  # place in sizes, space and items chosen before it, how many to choose

    def visit(at: int, space: int) -> bool:
        """Queue the choices at a place; False if nothing can follow."""
        if at < 0 or not space:
            return False
        lacking, k = space - spare, at
        while lacking > 0 and k >= 0:
            lacking -= sizes[k] * counts[sizes[k]]
            k -= 1
        if lacking <= 0:  # else all that can follow leaves too much
            stack.append((at, space, len(chosen), min(counts[sizes[at]], space // sizes[at])))
        return True

    if not visit(bisect.bisect_right(sizes, room) - 1, room) and room <= spare:
        yield [], room
    while stack and steps[0] > 0:
        steps[0] -= 1
        at, space, depth, n = stack.pop()
        del chosen[depth:]
        if n:
            stack.append((at, space, depth, n - 1))
            chosen.append((sizes[at], n))
        left = space - n * sizes[at]
        below = min(at, bisect.bisect_right(sizes, left)) - 1
        if not visit(below, left) and left <= spare and not _dominated(chosen, left, stock):
            yield chosen[:], left


def _completions(capacity: int, stock: _Stock, spare: int, steps: list[int]) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """Fillings around the largest size: first full ones that a short search finds, then all others."""
    largest = stock.sizes[-1]
    given = set()
    for limit, budget in ((0, [min(SHORT, steps[0])]), (spare, steps)):
        stock.add(largest, -1)
        ways = _ways(capacity - largest, stock, limit, budget)
        while found := next(ways, None):
            stock.add(largest, 1)
            need = {largest: 1}
            for size, n in found[0]:
                need[size] = need.get(size, 0) + n
            way = tuple(sorted(need.items(), reverse=True))
            if way not in given:
                given.add(way)
                yield way, found[1]
            stock.add(largest, -1)
        stock.add(largest, 1)


@dataclass
class _Level:
    """One decision of the search: the ways still to try around the largest size, the one in use and how often."""

    ways: Iterator[tuple[tuple[tuple[int, int], ...], int]]
    way: tuple[tuple[int, int], ...] = ()
    space: int = 0
    times: int = 0


def _first_dive(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """The filling with the least space left that a short search finds, used as often as the counts allow, until nothing is left."""
    stock, plan = _Stock(histogram), []
    while stock.sizes:
        way, least = ((stock.sizes[-1], 1),), capacity
        for found, space in _completions(capacity, stock, capacity, [2 * SHORT]):
            if space < least:
                way, least = found, space
            if not space:
                break
        times = min(stock.counts[s] // n for s, n in way)
        for size, n in way:
            stock.add(size, -n * times)
        plan.append((way, times))
    return plan


def bin_completion(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[Filling]:
    """Fillings for all items of ``histogram`` (size -> items, sizes from 1 to ``capacity``)."""
    stock = _Stock(histogram)
    if not stock.sizes:
        return []
    containers = lambda plan: sum(times for _, times in plan)
    least = least_containers(stock.counts, capacity)
    best = best_fit(histogram, capacity)
    if containers(best) > least:
        best = min(best, _first_dive(histogram, capacity), key=containers)
    fewest, total = containers(best), sum(s * n for s, n in stock.counts.items())
    steps, wasted, used = [nodes], 0, 0

    def spare() -> int:
        """Space that a plan with one container less than the incumbent may still waste."""
        return (fewest - 1) * capacity - total - wasted

    levels = [_Level(_completions(capacity, stock, spare(), steps))]
    while levels and fewest > least and steps[0] > 0:
        level = levels[-1]
        if level.times:  # one container less of this way
            for size, n in level.way:
                stock.add(size, n * level.times)
            wasted -= level.space * level.times
            used -= level.times
            level.times -= 1
        if not level.times:
            found = next(level.ways, None)
            if found is None:
                levels.pop()
                continue
            level.way, level.space = found
            level.times = min(stock.counts[s] // n for s, n in level.way)
        if level.space:
            level.times = min(level.times, max(0, spare()) // level.space)
        if spare() < 0 or not level.times:
            level.times = 0
            continue
        steps[0] -= 1
        for size, n in level.way:
            stock.add(size, -n * level.times)
        wasted += level.space * level.times
        used += level.times
        if not stock.sizes:
            if used < fewest:
                best, fewest = [(x.way, x.times) for x in levels], used
        elif used + -(-(total + wasted - used * capacity) // capacity) < fewest:
            levels.append(_Level(_completions(capacity, stock, spare(), steps)))
    return best


def _take(filling: list[int], counts: dict[int, int], sizes: list[int]) -> Filling:
    need: dict[int, int] = {}
    for size in filling:
        need[size] = need.get(size, 0) + 1
    times = min(counts[size] // n for size, n in need.items())
    for size, n in need.items():
        counts[size] -= n * times
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect.bisect_left(sizes, size))
    return tuple(sorted(need.items(), reverse=True)), times


def best_fit(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing by sizes: every container takes the largest size that still fits."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    sizes, plan = sorted(counts), []
    while sizes:
        filling, space, used = [], capacity, {}
        at = len(sizes) - 1
        while at >= 0 and space:
            size = sizes[at]
            n = min(space // size, counts[size] - used.get(size, 0))
            filling += [size] * n
            space -= n * size
            used[size] = n
            at = min(at, bisect.bisect_right(sizes, space)) - 1
        plan.append(_take(filling, counts, sizes))
    return plan


@dataclass
class _Slots:
    """For each size the ranks at which its use in another filling begins."""

    froms: dict[int, np.ndarray]
    firsts: dict[int, np.ndarray]
    per: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: list[Filling]) -> _Slots:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        done: dict[int, int] = {}
        first = 1
        for filling, times in plan:
            for size, n in filling:
                rows.setdefault(size, []).append((done.get(size, 0), first, n))
                done[size] = done.get(size, 0) + n * times
            first += times
        columns = {s: np.array(x, np.int64).T for s, x in rows.items()}
        return cls(*({s: x[k] for s, x in columns.items()} for k in range(3)))

    def container(self, size: int, ranks: np.ndarray) -> np.ndarray:
        if size not in self.froms:  # empty items go to the first container
            return np.ones(len(ranks), np.int64)
        at = np.searchsorted(self.froms[size], ranks, "right") - 1
        return self.firsts[size][at] + (ranks - self.froms[size][at]) // self.per[size][at]


def pieces(items: DataFrame, capacity: str = "capacity") -> DataFrame:
    """Items cut into pieces of at most their capacity: piece_no from 1, start and size in tokens."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col(capacity)).cast("int"))
    each = items.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n)))
    start = (F.col("piece_no") - 1) * F.col(capacity)
    return each.withColumn("start", start).withColumn("size", F.least(F.col("tokens") - start, F.col(capacity)))


def packed(items: DataFrame, packs: DataFrame, nodes: int = NODES) -> DataFrame:
    """(pack_name, container_no, doc_id, piece_no, start, size): the container of every piece.

    ``items`` has doc_id, lang, tokens, one row per doc_id; ``packs`` has
    pack_name, capacity_tokens, lang and is a small table of settings. A pack with
    a lang takes items whose language tag has that primary part. Only an item
    larger than the capacity is divided, into full pieces and a rest. Items
    without tokens go to container 1. Packs with a null or non-positive capacity
    get nothing.
    """
    primary = lambda c: F.lower(F.split(c, "[-_]")[0])
    settings = packs.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").alias("capacity"), primary(F.col("lang")).alias("only")).distinct()
    fitting = items.join(F.broadcast(settings), F.col("only").isNull() | (primary(F.col("lang")) == F.col("only")))
    cut = pieces(fitting.select("pack_name", "capacity", "doc_id", "tokens"))
    # ranks follow the order of keys; ranges of the sort split a size that many items share
    order = ["pack_name", "size", "doc_id", "piece_no"]
    cut = checkpoint(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()))
    counts = checkpoint(cut.groupBy("pack_name", "capacity", "size", "slice").agg(F.count(F.lit(1)).alias("n")))
    slots = {}
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    for row in counts.groupBy("pack_name", "capacity", "size").agg(F.sum("n").alias("n")).collect():  # at most the capacities' sum
        histograms.setdefault((row.pack_name, row.capacity), {})[row["size"]] = row.n
    for (name, capacity), histogram in histograms.items():
        histogram.pop(0, None)
        slots[name] = _Slots.of(bin_completion(histogram, capacity, nodes))
    before = Window.partitionBy("pack_name", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_name", "size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pack_name", "size", "slice").orderBy("doc_id", "piece_no")
    ranked = cut.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["pack_name", "size", "slice"])
    ranked = ranked.select("pack_name", "doc_id", "piece_no", "start", "size", (F.col("within") + F.col("offset")).alias("rank"))
    shared = cut.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["container_no"] = 0
            for (name, size), part in rows.groupby(["pack_name", "size"]):
                rows.loc[part.index, "container_no"] = shared.value[name].container(int(size), part["rank"].to_numpy())
            yield rows[["pack_name", "container_no", "doc_id", "piece_no", "start", "size"]]

    kind = dict(items.dtypes)["doc_id"]
    return ranked.mapInPandas(place, f"pack_name string, container_no long, doc_id {kind}, piece_no int, start int, size int")


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, containers, least_possible, gap, used_share) of each pack.

    ``least_possible`` is the lower bound by the sum of sizes; with ``gap`` 0 the plan is proven best.
    """
    capacities = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct()
    sums = placed.groupBy("pack_name").agg(F.sum("size").alias("tokens"), F.max("container_no").alias("containers"))
    joined = sums.join(F.broadcast(capacities), "pack_name")
    room = F.col("containers") * F.col("capacity_tokens")
    least = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    return joined.select("pack_name", "containers", least.alias("least_possible"), (F.col("containers") - least).alias("gap"), (F.col("tokens") / room).alias("used_share"))
