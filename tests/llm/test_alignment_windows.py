"""Windows of up to three lines on either side, in any order, against planted merges."""

import random

import numpy as np

from leafmill.llm import alignment


def planted(rng, merges):
    """A passage of known words: lines merged on one side as (source lines, target lines)."""
    words = [(f"noun{a}{b}", f"wort{a}{b}") for a in "abcde" for b in "fghij"]
    source, target, pairs = [], [], set()
    for own, other in merges:
        picked = rng.sample(words, 6)
        for lines, n, side in ((source, own, 0), (target, other, 1)):
            cuts = [round(k * 6 / n) for k in range(n + 1)]
            lines += ["the of and in " * 1 + " ".join(p[side] for p in picked[a:z]) if side == 0 else "der von und im " + " ".join(p[side] for p in picked[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        pairs |= {(len(source) - a, len(target) - b) for a in range(own) for b in range(other)}
    return "\n".join(source), "\n".join(target), pairs


def test_merged_lines(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for k in range(150):
        merges = [rng.choice([(1, 1), (1, 1), (1, 2), (2, 1), (1, 3), (3, 1)]) for _ in range(6)]
        source, target, truth[k] = planted(rng, merges)
        rows.append((k, source, target))
    got = {}
    for r in alignment.aligned_lines(spark.createDataFrame(rows, "worksheet_id long, text string, target string")).collect():
        got.setdefault(r.worksheet_id, set()).add((r.text_line, r.target_line))
    right = sum(len(got.get(k, set()) & t) for k, t in truth.items())
    assert right > 0.85 * sum(map(len, truth.values())) and right > 0.85 * sum(map(len, got.values()))


def test_pairs_are_mutual_best_in_order():
    """Rounds of mutual neighbours give what taking the best pair left, one at a time, gives."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        ids = np.arange(alignment.TERMS)
        model = alignment.Model({0: 0}, (np.ones(alignment.TERMS, np.float32),) * 2, (ids, ids), (rng.standard_normal((alignment.TERMS, 8)).astype(np.float32),) * 2)
        text = "\n".join(f"a{rng.integers(9)} b{rng.integers(9)}" for _ in range(n))
        lines = [x for own, other, _ in alignment.match(text, text, 0, model) for x in own]
        assert len(lines) == len(set(lines))
        assert alignment.match(text, "\n\n", 0, model) == [] and alignment.match(text, text, 5, model) == []


def test_several_groups_of_languages(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, *planted(rng, [(1, 1)] * 6)[:2]) for k in range(60)]
    rows += [(100 + k, t, s) for k, s, t in rows]
    df = spark.createDataFrame(rows, "worksheet_id long, text string, target string")
    one = sorted(map(tuple, alignment.aligned_lines(df).collect()))
    monkeypatch.setattr(alignment, "PAIRS", 1)
    assert len(one) > 300 and len(set(sorted(map(tuple, alignment.aligned_lines(df).collect()))) ^ set(one)) < 0.1 * len(one)
