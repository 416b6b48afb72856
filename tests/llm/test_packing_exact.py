"""Bin completion against an exact solver, and on counts that need no recursion."""

import random
from collections import Counter

import pytest

from leafmill.llm import packing


def exact(items, capacity):
    """Fewest containers, by the best state (containers, space used in the last) of every subset."""
    best = [(0, capacity)] + [(len(items) + 1, 0)] * ((1 << len(items)) - 1)
    for taken in range(1 << len(items)):
        used, filled = best[taken]
        for k, size in enumerate(items):
            if not taken >> k & 1:
                state = (used, filled + size) if filled + size <= capacity else (used + 1, size)
                best[taken | 1 << k] = min(best[taken | 1 << k], state)
    return best[-1][0]


def check(plan, histogram, capacity):
    placed = Counter()
    for filling, times in plan:
        assert times > 0 and sum(s * n for s, n in filling) <= capacity
        for size, n in filling:
            placed[size] += n * times
    assert placed == Counter(histogram)
    return sum(times for _, times in plan)


def test_equals_an_exact_solver():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(1, capacity * rng.choice([1, 2, 3]) // 3) for _ in range(rng.randint(1, 11))]
        histogram = dict(Counter(items))
        assert check(packing.bin_completion(histogram, capacity), histogram, capacity) == exact(items, capacity)


@pytest.mark.parametrize(("histogram", "capacity", "want"), [({1: 5000}, 2000, 3), ({1: 3000, 3: 10, 1500: 2}, 4000, 2), ({7: 1}, 7, 1), ({}, 5, 0)])
def test_many_small_items(histogram, capacity, want):
    assert check(packing.bin_completion(histogram, capacity), histogram, capacity) == want


def test_best_fit_alone_is_not_enough():
    rng, better = random.Random(8), 0
    for _ in range(200):
        histogram = dict(Counter(rng.randint(15, 60) for _ in range(14)))
        fit, full = (sum(t for _, t in plan(histogram, 100)) for plan in (packing.best_fit, packing.bin_completion))
        assert full <= fit
        better += full < fit
    assert better


def test_containers_do_not_follow_partitions(spark):
    rng = random.Random(4)
    rows = [(k, "en", rng.choice([0, 5, 9, 100, 250])) for k in range(400)]
    packs = spark.createDataFrame([("p", 100, None), ("none", None, None)], "pack_name string, capacity_tokens int, lang string")
    got = []
    for n in (1, 5):
        items = spark.createDataFrame(rows, "doc_id long, lang string, tokens int").repartition(n)
        placed = packing.packed(items, packs)
        got.append(sorted(tuple(r) for r in placed.collect()))
    assert got[0] == got[1]
    report = packing.fill_report(placed, packs).collect()
    assert [r.pack_name for r in report] == ["p"] and report[0].gap >= 0
