"""Each registered query against its oracle, and driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from storyscale.plans.registry import QUERIES

NAMES = sorted(n for n, q in QUERIES.items() if q.oracle)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        return None if x is None else int(x) if isinstance(x, (bool, int)) or isinstance(x, float) and x.is_integer() else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, duck, name):
    got = QUERIES[name].run(spark, sf)
    want = duck.sql(QUERIES[name].oracle)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == plain(duck.sql(f"SELECT {quoted} FROM want").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
