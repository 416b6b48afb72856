"""The subpackage's SQL on the smallest data, and classes of look-alikes against their pairs."""

import os

import duckdb
import pytest

from leafmill.llm import look_alikes, mixing, queries

FOLDER = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
ORACLE = {name: (sql, module.QUERIES[name]) for module in queries.modules() for name, sql in module.ORACLE.items()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{table}'")
    sql, query = ORACLE[name]
    result, got = db.sql(sql), query(spark, FOLDER)
    order = sorted(got.columns)
    assert order == sorted(result.columns)
    at = [result.columns.index(c) for c in order]
    assert sorted(tuple(map(str, r)) for r in got.select(*order).collect()) == sorted(tuple(str(r[i]) for i in at) for r in result.fetchall())


def test_classes_hold_the_pairs(spark):
    data = [(1, "x", "café"), (2, "x", "café"), (3, "x", "cafe"), (4, "y", "café"), (5, "x", "сafé"), (6, "x", None), (7, "x", "café"), (8, "x", "ՕK"), (9, "x", "OK"), (10, "x", "ᎠOG"), (11, "x", "DOG"), (12, None, "café")]
    df = spark.createDataFrame(data, "k long, owner string, text string")
    got = {r.key: (r.class_id, r.n_members) for r in look_alikes.same_look_classes(df, "k", "owner", "text").collect()}
    assert got == {1: (1, 4), 2: (1, 4), 5: (1, 4), 7: (1, 4), 8: (8, 2), 9: (8, 2), 10: (10, 2), 11: (10, 2)}
    pairs = {(r.a, r.b) for r in look_alikes.same_look_pairs(df, "k", "owner", "text").collect()}
    assert all(got[a][0] == got[b][0] for a, b in pairs) and {x for p in pairs for x in p} == set(got)
    assert look_alikes.same_look_classes(df.limit(0), "k", "owner", "text").collect() == []


def test_shards_are_numbered_from_one(spark):
    draws = spark.createDataFrame([("m", k % 3, k, 1, (k * 7919) % 101) for k in range(300)], "mix_name string, shard int, doc_id long, round_no int, place long")
    got = mixing.shuffled_shards(draws).collect()
    for shard in range(3):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, 101)) and [r.place for r in mine] == sorted(r.place for r in mine)
