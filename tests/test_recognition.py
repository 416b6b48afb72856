"""Recognition, figures, packages and sign-off on small fixtures."""

from pyspark.sql import functions as F

from leafmill.operators import recognition as R


def test_lines_join_and_group(spark, rows):
    df = spark.createDataFrame([(1, ["a wo-", "rd", " next", "x--", "y"]), (2, []), (3, None)], "k int, lines array<string>")
    assert [r[1] for r in rows(df.select("k", R.joined_lines(F.col("lines"))))] == ["a word next x-- y", "", None]
    assert R.line_groups([10.0, 10.5, 11.2, 10.6, 12.0]) == [0, 0, 1, 1, 2] and R.line_groups([10.0, 12.0], scanned=True) == [0, 0] and R.line_groups([]) == []
    lines = spark.createDataFrame([("p", 2, 20.0), ("p", 1, 10.0), ("q", 1, 5.0)], "page_key string, line_no int, size double")
    assert rows(R.grouped_lines(lines)) == [("p", 1, 0), ("p", 2, 1), ("q", 1, 0)]


def test_fields_keep_their_place(spark, rows):
    runs = [(1, "text", "Page "), (2, "begin", ""), (3, "instruction", "PAGE"), (4, "begin", ""), (5, "instruction", "INNER"), (6, "end", ""), (7, "separate", ""), (8, "text", "7"), (9, "end", ""), (10, "text", " of"), (11, "text", " x"), (12, "tab", "")]
    df = spark.createDataFrame([("p", *r) for r in runs], "para string, pos int, kind string, text string")
    assert rows(R.running_pieces(df)) == [("p", 1, "text", "Page "), ("p", 2, "field", "PAGE"), ("p", 3, "text", " of x"), ("p", 4, "tab", "")]


def test_recognition_gate(spark, rows):
    data = [("b", "u1", "the old mill", "the old mill", 50.0), ("b", "u2", "the old mill", "zzz", 99.0), ("b", "u3", "x", None, None), ("b", "u4", None, "x", 90.0)]
    df = spark.createDataFrame(data, "book_id string, id string, text string, seen string, conf double")
    assert rows(R.recognition_gate(df).select("code", "unit")) == [("ocr-coverage-unverified", "u3"), ("ocr-disputed-text", "u2"), ("ocr-disputed-text", "u4"), ("ocr-low-confidence", "u1")]


def test_outputs_and_packages(spark, rows):
    schema = "page int, role string, text string, width double, height double, draws int"
    source = spark.createDataFrame([(1, "text", "a b", 10.0, 10.0, 1), (2, "image", "", 10.0, 10.0, 1), (3, "text", "x", 10.0, 10.0, 1)], schema)
    output = spark.createDataFrame([(1, "text", "ab", 10.4, 10.0, 1), (2, "image", "seen", 12.0, 10.0, 2), (4, "text", "x", 1.0, 1.0, 1)], schema)
    assert [r for r in rows(R.output_problems(source, output)) if r[0] in (1, 2, 4)] == [(2, "draws"), (2, "geometry"), (4, "foreign")]
    assert (3, "missing") in rows(R.output_problems(source, output))
    notes = spark.createDataFrame([("f1", True, True), ("f2", False, True), ("f3", True, False)], "id string, defined boolean, referred boolean")
    links = spark.createDataFrame([("u1", "m1"), ("u2", "gone"), ("u3", None)], "unit string, target string")
    marks = spark.createDataFrame([("m1",), ("m2",), ("m2",)], "name string")
    assert rows(R.package_problems(notes, links, marks)) == [("f2", "footnote-missing"), ("f3", "footnote-unused"), ("m2", "bookmark-repeated"), ("u2", "dead-link")]


def test_figures_are_placed_and_books_signed_off(spark, rows):
    blocks = spark.createDataFrame([("b", 1, "x", "paragraph"), ("b", 2, "y", "paragraph")], "book_id string, pos int, id string, type string")
    figures = spark.createDataFrame([("b", 2, "f1"), ("b", 3, "f2")], "book_id string, slot int, key string")
    assert [r[2] for r in rows(R.placed_figures(blocks, figures).select("book_id", "pos", "id"))] == ["x", "f1", "y", "f2"]
    books = spark.createDataFrame([("b",), ("c",)], "book_id string")
    verdicts = spark.createDataFrame([("b", "meaning", "ok"), ("b", "fluency", "rejected")], "book_id string, stage string, verdict string")
    pending = spark.createDataFrame([("c", "u1")], "book_id string, id string")
    assert rows(R.signoff(books, verdicts, pending).select("code", "book_id")) == [("publication-pending", "c"), ("semantic-rejected", "b"), ("semantic-unverified", "c")]
