"""Exact top-k search against sorting all products, the SQL, and awkward vectors."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from storyscale.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>"


def sorted_products(rows, asks, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if asks(i):
            scored = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), j) for j, w in ok if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=10, parts=3, every=5):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS q", "'mine' AS id", "'mine' AS score", "'mine' AS rank").repartition(parts)
    got = topk.search(df, F.col("vec_id") % every == 0, k).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted_products(rows, lambda i: i % every == 0, k)


def vectors(n, size, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(size)]) for i in range(n)]


def test_random_vectors(spark, nothing):
    check(spark, vectors(300, 8, 1))
    check(spark, vectors(60, 3, 2, 1e-3), k=4)  # many ties


def test_ties_and_repeated_vectors(spark, nothing):
    same = [(i, [0.5, -0.25]) for i in range(400)]
    check(spark, same + [(i, [0.5, float(i % 3)]) for i in range(400, 430)], parts=5, every=50)
    check(spark, [(7, [1.0]), (7, [1.0]), (5, [2.0]), (5, [3.0]), (8, [0.0])], k=3)


def test_awkward_vectors(spark, nothing):
    odd = [(5, [math.nan]), (10, None), (15, []), (20, [1.0, None]), (None, [1.0]), (25, [math.inf]), (30, [1.0, 2.0, 3.0]), (35, [-1.0]), (1, [0.1, 0.2]), (2, [1e-9, -1e-9]), (-5, [4.0])]
    check(spark, odd)
    check(spark, odd, k=2)


def test_large_components(spark, nothing):
    check(spark, [(i, [x * 1e9 for x in v]) for i, v in vectors(40, 4, 3)])  # beyond 2 ** 53
    check(spark, [(i, [x * 1e20 for x in v]) for i, v in vectors(40, 4, 4)])  # held to a long


def test_few_candidates(spark, nothing):
    check(spark, vectors(6, 2, 5))
    check(spark, vectors(1, 2, 6))
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []
    assert topk.search(spark.createDataFrame([(1, [1.0])], SCHEMA), F.lit(False)).collect() == []


def test_many_queries_in_blocks(spark, nothing, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    check(spark, vectors(300, 4, 7), every=2)


@pytest.mark.parametrize("name", ["op13_topk"])
def test_query_equals_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    cols = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall())
