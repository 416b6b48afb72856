"""Exchange, rendering and naming on small fixtures."""

from pyspark.sql import functions as F

from leafmill.functions import naming
from leafmill.operators import exchange, rendering


def test_snapshots_refuse_a_moved_base(spark, tmp_path, rows):
    folder = str(tmp_path)
    one, two = spark.range(1), spark.range(2)
    assert exchange.write_snapshot(one, folder, "v1", None, "head")
    head = exchange.current_snapshot(spark, folder, "head")
    assert exchange.write_snapshot(two, folder, "v2", head, "head")
    assert not exchange.write_snapshot(one, folder, "v3", head, "head")
    assert exchange.read_snapshot(spark, folder, "head").count() == 2


def test_notes_keep_their_ids(spark, rows):
    notes = spark.createDataFrame([("b", "fn0003", "r1", "tr-1"), ("b", "fn0007", "r2", "tr-1"), ("b", "fn0001", None, None)], "book_id string, id string, reply string, local_id string")
    offered = spark.createDataFrame([("b", "r1", "tr-1", "x"), ("b", "r1", "tr-2", "y"), ("c", "r9", "tr-1", "z")], "book_id string, reply string, local_id string, text string")
    got = rows(exchange.adopted_notes(notes, offered).select("book_id", "local_id", "id", "adopted"))
    assert got == [("b", "tr-1", "fn0003", True), ("b", "tr-1", "fn0007", False), ("b", "tr-2", "fn0008", True), ("c", "tr-1", "fn0001", True)]


def test_jobs_with_shared_units_commit_together(spark, rows):
    states = spark.createDataFrame([("j1", "answered"), ("j2", "answered"), ("j3", "missing"), ("j4", "answered")], "job_id string, state string")
    owners = spark.createDataFrame([("j1", "u1"), ("j2", "u1"), ("j2", "u2"), ("j3", "u2"), ("j4", "u9")], "job_id string, owner string")
    assert rows(exchange.committing_jobs(states, owners)) == [("j1", False), ("j2", False), ("j3", False), ("j4", True)]


def test_order_and_acceptance(spark, rows):
    schema = "owner string, pos int, unit string"
    want = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "a"), ("t", 2, "b")], schema)
    got = spark.createDataFrame([("s", 1, "b"), ("s", 2, "a"), ("t", 1, "x"), ("t", 2, "a"), ("t", 3, "b")], schema)
    assert rows(exchange.order_problems(want, got)) == [("s",)]
    refusal = exchange.acceptance([("first", F.col("id") < 3), ("second", F.col("id") != 1), ("third", F.lit(None).cast("boolean"))])
    assert [r[1] for r in rows(spark.range(4).select("id", refusal))] == ["third", "second", "third", "first"]


def test_styles_inherit(spark, rows):
    styles = spark.createDataFrame([("a", None, 10, True), ("b", "a", None, True), ("c", "b", 12, True), ("x", "y", 1, None), ("y", "x", None, None), ("z", "gone", None, None)], "id string, base string, size int, bold boolean")
    got = {r.id: (r.size, r.bold, r.problem) for r in rendering.inherited(styles).collect()}
    assert got["a"] == (10, True, None) and got["b"] == (10, False, None) and got["c"] == (12, True, None)
    assert got["x"][2] == "cycle" and got["z"][2] == "dangling base"


def test_tables_close_over_parents_and_children(spark, rows):
    tables = spark.createDataFrame([("t1", None), ("t2", "t1"), ("t3", "t2"), ("t4", None)], "id string, parent string")
    assert rows(rendering.table_closure(tables, tables.where("id = 't2'").select("id"))) == [("t1",), ("t2",), ("t3",)]


def test_presence_and_sizes(spark, rows):
    units = spark.createDataFrame([("b", 1, "u1", "twice here"), ("b", 1, "u2", "not there"), ("b", 1, "u3", "x"), ("b", 2, "u4", None)], "book_id string, page int, unit string, text string")
    pages = spark.createDataFrame([("b", 1, "twice  here and twice here x")], "book_id string, page int, shown string")
    assert [r[1:] for r in rows(rendering.presence(units, pages))] == [("u1", 2, "text-duplicated"), ("u2", 0, "text-missing"), ("u3", 1, "text-unverified"), ("u4", 0, "text-missing")]
    turned = spark.range(1).select(rendering.size_problem(F.lit(100.0), F.lit(200.0), F.lit(200.0), F.lit(101.0))).first()[0]
    assert turned == "turned"


def test_names_are_introduced_once():
    text = "آن می‌گوید آن و آنها"
    first = naming.introduced(text, "آن", "آن (Ann)")
    assert first == "آن (Ann) می‌گوید آن و آنها" and naming.introduced(first, "آن", "آن (Ann)") == first
    assert naming.flattened(first, "آن (Ann)", "آن") == text or "(Ann)" in first
    assert naming.obligations("Ann Lee met Lee and Ann", ["Ann", "Ann Lee", "Lee"]) == ["Ann Lee", "Lee", "Ann"]
    assert naming.right_to_left("abc") == 0.0 and naming.right_to_left("") == 0.0
