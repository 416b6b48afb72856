"""Every core query agrees with its SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
PREFIXES = tuple(f"p{n}_" for n in range(1, 11) if n != 5)


def _shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(PREFIXES)])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{table}'")
    result = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(result.columns)
    order = sorted(got.columns)
    at = [result.columns.index(c) for c in order]
    assert sorted(tuple(map(_shown, r)) for r in got.select(*order).collect()) == sorted(tuple(_shown(r[i]) for i in at) for r in result.fetchall())
