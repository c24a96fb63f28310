"""Every registered core query gives what its DuckDB SQL gives."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from stratakeep.queries import all_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = all_queries()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(list(x)) if isinstance(x, list | tuple) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, duck, name):
    query, sql = QUERIES[name]
    got = query(spark, str(DATA))
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["database", "table", "part", "action", "link", "link_part_name"]
    assert {r.action for r in got.select("action").distinct().collect()} == {"link", "upload"}
