"""Every query that has SQL gives DuckDB's rows."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Slow in SQL or covered by tests of their own.
NAMES = sorted(set(entry.oracle_sql()) - {"pipeline"})


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(x) for x in r)) for r in got.select(*columns).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


#: Run by tests of their own, where their tables are checked.
PLAIN = sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"} if not re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", PLAIN)
def test_query_without_sql_runs(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert len(rows.collect()) > 0 or name in ("extract_candidates", "answers")
    assert len(set(rows.columns)) == len(rows.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
