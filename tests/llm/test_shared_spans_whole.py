"""Spans that stand beside others on the same alignment, or at a middle occurrence of a window."""

import random

from leafmill.llm import shared_spans

RNG = random.Random(11)


def _text(n):
    return "".join(RNG.choice("abcdefgh ") for _ in range(n))


def _brute(rows, least=200):
    """Pairs of keys, and per key the characters that stand in another record."""
    where, covered = {}, {}
    for k, *fields in rows:
        for f, t in enumerate(fields):
            for i in range(len(t or "") - least + 1):
                where.setdefault(t[i : i + least], set()).add((k, f, i))
    pairs = set()
    for places in where.values():
        keys = {k for k, _, _ in places}
        pairs |= {(a, b) for a in keys for b in keys if a < b}
        if len(keys) > 1:
            for k, f, i in places:
                covered.setdefault(k, set()).update((f, j) for j in range(i, i + least))
    return pairs, {k: len(v) for k, v in covered.items()}


def _check(spark, rows):
    df = spark.createDataFrame(rows, "k long, text string, target string")
    pairs, covered = _brute(rows)
    got = {(r.a, r.b) for r in shared_spans.shared_spans(df, "k", ["text", "target"]).collect()}
    shares = {r["key"]: r.n_shared for r in shared_spans.shared_shares(df, "k", ["text", "target"]).collect() if r.n_shared}
    assert got == pairs and pairs
    assert shares == covered


def test_runs_that_a_substitution_parts(spark):
    short, long, first, second = _text(150), _text(250), _text(300), _text(400)
    _check(spark, [(1, short + "ی" + long, None), (2, short + "ي" + long, None), (3, first + "x" + second, None), (4, None, first + "y" + second)])


def test_spans_around_middle_occurrences(spark):
    refrain, verse = _text(180), _text(30)
    rows = [(1, refrain + _text(200) + verse + refrain + _text(200) + refrain, None), (2, _text(30) + refrain + _text(80) + verse + refrain + _text(80) + refrain, None)]
    _check(spark, rows)


def test_periodic_stretches(spark):
    dots = ". " * 150
    _check(spark, [(1, "a" + dots + "b", None), (2, dots[1:] + "c" + dots, None), (3, _text(250), "abc" * 90), (4, "bca" * 100, _text(40) + "-" * 260), (5, "-" * 201, None)])
