"""Values with a longer copy elsewhere, against a comparison of every two values."""

import random

from leafmill.llm import truncation

BLOCKS = "k long, book string, channel string, text string, target string, at long"


def test_longer_copies_decide(spark, monkeypatch):
    full = "The keeper opened the door. He walked into the garden."
    rows = [(1, "b", "x", full, full, 1), (2, "b", "x", full, full[:27], 1), (3, "c", "x", "Other text. It goes on.", full[:27], 1)]
    rows += [(4, "b", "y", "A line. And more.", "Eine Zeile. Und mehr.", 1), (4, "b", "y", "A line. And more.", "Eine Zeile.", 2), (7, "b", "z", "Wait…", "Warte…", 1), (8, "b", "z", "Wait…", "Warte...", 1), (5, "b", "y", None, "Eine", 1), (6, "b", "y", "A line. And more.", "  ", 1)]
    df = spark.createDataFrame(rows, BLOCKS)
    cut = lambda: sorted(r.key for r in truncation.truncated(df, "k", "book", "channel", "text", "target", "at")[0].collect())
    assert cut() == [2, 4]
    monkeypatch.setattr(truncation, "longer_copies", lambda deliveries, suspects: suspects.select("key").limit(0))
    assert cut() == []


def test_longer_copies_equal_every_two_values(spark):
    rng = random.Random(5)
    values = [(rng.choice("pq"), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    found = truncation.longer_copies(spark.createDataFrame(values, "of string, value string"), spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "key long, of string, value string"))
    want = {i for i, (of, v) in enumerate(values) if v.strip() and any(o == of and w != v and w.startswith(v) for o, w in values)}
    assert {r.key for r in found.collect()} == want and want


def test_divided_words_equal_every_two_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    words, parts = {word() for _ in range(60)}, {word() for _ in range(60)}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "value string")
    assert {r.value for r in truncation.divided_words(frame(words), frame(parts)).collect()} == {p for p in parts - words if any(w.startswith(p) for w in words)}


def test_long_runs_of_closing_marks_do_not_hide_an_end(spark):
    ends = ["He left." + "*_" * 80, "He left. [[fn:" + "n" * 150 + "]]", "He left" + " *" * 90]
    df = spark.createDataFrame([(i, "b", "x", "He left.", t, 1) for i, t in enumerate(ends)], BLOCKS)
    got = {r.key: r.ended for r in truncation.measured(df, "k", "book", "channel", "text", "target", "at").collect()}
    assert got == {0: True, 1: True, 2: False}
