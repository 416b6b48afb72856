"""Terms of a bank in texts: no text is shuffled, and the rows are those of the SQL on odd documents."""

import re

import __spark_entry__ as entry
import duckdb
from leafmill.operators import glossary

DOCUMENTS = [(1, "Two lamps, a lamp."), (1, "LAMPED"), (None, "A ship"), (None, "ship"), (3, None), (4, ""), (5, "see"), (6, "I See it"), (7, "SEE witnesses; Copper Kettles"), (8, "lamp_ _lamp lampings"), (9, "market\nday, market days"), (10, "café ship, ships’")]


def test_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "Two lamps, one lamp.")], "unit int, text string")
    terms = spark.createDataFrame([("lamp",)], "term string")
    plan = glossary.term_hits(texts, terms)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?<!Broadcast)Exchange (.+?), ENSURE", plan)
    assert "BroadcastHashJoin" in plan and all(k.startswith("hashpartitioning(term#") for k in keys)


def test_hits_are_those_of_the_sql(spark, tmp_path, rows):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()["term_hits"]).fetchall()
    got = rows(entry.queries()["term_hits"](spark, str(tmp_path)))
    assert got == sorted(want, key=lambda t: tuple((x is not None, str(x)) for x in t)) and got.count((None, "ship")) == 2


def test_a_term_listed_twice_counts_once(spark, rows):
    texts = spark.createDataFrame([(1, "Two lamps, one lamp."), (2, None)], "unit int, text string")
    terms = spark.createDataFrame([("lamp",), ("lamp",), (None,)], "term string")
    assert rows(glossary.term_hits(texts, terms)) == [(1, "lamp")]
