"""Values carried along a book in runs equal a walk over its blocks."""

import random

from leafmill.operators import blocks, layout
from pyspark.sql import functions as F


def test_carried_values(spark):
    rng = random.Random(2)
    data = [(rng.choice(["x", "x", "x", "y", None]), p, rng.choice([None, None, None, None, f"v{p}"])) for p in rng.sample(range(4000), 900)]
    got = blocks.carried(spark.createDataFrame(data, "book_id string, pos int, v string"), F.col("v"), "now", F.lit("none")).collect()
    want, now = {}, {}
    for book, pos, v in sorted(data, key=lambda r: r[1]):
        now[book] = v or now.get(book, "none")
        want[book, pos] = now[book]
    assert {(r.book_id, r.pos): r.now for r in got} == want and len(got) == len(data)
    empty = spark.createDataFrame([], "book_id string, pos int, v string")
    assert blocks.carried(empty, F.col("v"), "now").collect() == []


def test_texts_on_pictures(spark, rows):
    schema = "book_id string, page int, key int, x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame([("b", 1, 1, 0.0, 0.0, 10.0, 10.0), ("b", 1, 2, 50.0, 0.0, 60.0, 10.0), ("b", 2, 3, 0.0, 0.0, 10.0, 10.0), ("b", None, 4, 0.0, 0.0, 9.0, 9.0)], schema)
    pictures = spark.createDataFrame([("b", 1, 9, 5.0, 0.0, 40.0, 40.0), ("b", 1, 8, 9.5, 0.0, 40.0, 40.0), ("b", 1, 7, 0.0, 0.0, 0.0, 0.0)], schema)
    assert rows(layout.overlapping(texts, pictures)) == [("b", 1, 1, 9)]
