"""Cuts in ranges give what one fold over the whole group gives, however the rows are spread."""

import random

import pytest

from leafmill.functions import segments
from leafmill.operators import jobs, ranges

BLOCK = "book_id string, pos int, id string, type string, level int, text string"


def chunk_rule(budget):
    cap, filled = int(budget * 1.35), budget * 0.25

    def rule(size, prose, held, cost, opens, own):
        return held and (opens or size + cost > cap) and not (opens and size < filled and not prose), size + cost >= budget and not opens

    return rule


@pytest.mark.parametrize("seed", range(40))
def test_summaries_hand_on_the_state(seed):
    rng = random.Random(seed)
    pack = lambda size, prose, held, cost, opens, own: (size > 0 and size + cost > 50, False)
    rule = chunk_rule(50) if seed % 2 else pack
    rows = [(rng.choice([0, 0, 3, 10, 40, 90]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 60))]
    whole = ranges.pieces(rule, rows)
    cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 9))))
    state, got = ranges.FRESH, []
    for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if a < z:
            got += ranges.pieces(rule, rows[a:z], state)
            state = ranges.handed_on(rule, state, *ranges.summary(rule, rows[a:z]))
    assert got == whole


def test_a_hot_book_is_cut_in_ranges(spark):
    rng = random.Random(1)
    data = [("hot", n, f"b{n}", rng.choice(["heading", "paragraph", "image"]), rng.choice([1, 3, None]), "x" * rng.choice([0, 5, 130, 400]) if rng.random() < 0.9 else None) for n in range(1500)]
    data += [(f"c{k}", n, f"b{n}", "paragraph", None, "y" * 150) for k in range(5) for n in range(20)] + [(None, 1, "b1", "paragraph", None, "z")]
    df = spark.createDataFrame(data, BLOCK)
    rule, want = chunk_rule(600), {}
    for book in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == book), key=lambda r: r[1])
        rows = [(len(r[5] or ""), r[3] == "heading" and (r[4] or 9) <= 2, r[3] == "paragraph" and len(r[5] or "") > 120) for r in mine]
        want |= {(book, r[1]): no for r, no in zip(mine, ranges.pieces(rule, rows), strict=True)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jobs.chunks(df.repartition(9), 600).collect()
        packed = segments.pack(df.selectExpr("book_id", "pos", "coalesce(length(text), 0) as cost"), "book_id", "pos", "cost", 900).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.book_id, r.pos): r.chunk_no for r in got} == want and len(got) == len(data)
    costs = {b: [len(r[5] or "") for r in sorted((r for r in data if r[0] == b), key=lambda r: r[1])] for b in {r[0] for r in data}}
    for book, own in costs.items():
        assert [r.job_no for r in sorted((r for r in packed if r.book_id == book), key=lambda r: r.pos)] == segments.packed_jobs(own, 900)
    assert jobs.chunks(df.limit(0)).collect() == []


def test_rows_are_numbered_in_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), n, rng.randint(0, 9)) for n in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranges.numbered(spark.createDataFrame(data, "g string, n int, v int").repartition(6), ["g"], ["v", "n"], "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in data}:
        want |= {r[1]: k for k, r in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1])), 1)}
    assert {r.n: r.place for r in got} == want and len(got) == len(data)
