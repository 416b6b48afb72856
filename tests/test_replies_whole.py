"""Replies to all units of a book."""

from leafmill.plans import state as plans


def test_replies_to_all_units_count(spark, rows, tmp_path):
    block = "block_key long, book_id string, pos int, id string, type string, level int, text string, target string, page int"
    data = [(k, book, n, f"b{n:05}", "paragraph", None, "s", "old", 1) for k, (book, n) in enumerate([("x", 1), ("x", 21), ("y", 1), ("y", 30)])]
    spark.createDataFrame(data, block).write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame([("x", "fn0001", "b00021", "source", "n", None)], "book_id string, id string, anchor_block string, origin string, text string, target string").write.parquet(f"{tmp_path}/footnotes.parquet")
    reviews = [(1, "x", " B00021#2", "new"), (2, "x", "fn0001", "note"), (3, "x", "b00001", None), (4, "y", "b00001", "new"), (5, "y", "b00099", "new")]
    spark.createDataFrame(reviews, "review_key long, book_id string, id string, target string").write.parquet(f"{tmp_path}/reviews.parquet")
    got = rows(plans.merged_replies(spark, str(tmp_path)).select("book_id", "id", "target", "merged"))
    assert got == [("x", "b00001", "old", False), ("x", "b00021", "new", True), ("x", "fn0001", "note", True), ("y", "b00001", "old", False), ("y", "b00030", "old", False)]
