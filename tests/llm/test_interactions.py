"""Replayed filters against a loop over documents and orders, the SQL, and awkward rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from storyscale.llm import interactions, queries

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def by_loops(docs, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out, removed = defaultdict(Counter), Counter()
    for i, text, part in docs:
        t, part = text or "", part or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first.get(t, i) < i,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = next((k for k, x in enumerate(order) if failed[x]), 5)
            for k, x in enumerate(order):
                c = out[part, order, k + 1]
                c.update({"kept": gone > k, "removed": gone == k, "redundant": failed[x] and gone < k, "unique_fails": failed[x] and sum(failed.values()) == 1, "good_lost": gone == k and i in good, "toxic_lost": gone == k and i in toxic})
                removed[part, x] += gone == k
    return {(p, o, s, *[c[n] for n in COUNTS], removed[p, o[s - 1]]) for (p, o, s), c in out.items()}


def told(df):
    rows = [tuple(r) for r in df.select("part", "filter_order", "step", *COUNTS, "shapley").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (4, None, None), (5, "", ""), (6, " \n", "en"), (7, "A B # " * 100, "de"), (8, "a b " * 60, "de"),
    (None, LONG, "en"), (None, None, "en"), (9, "É" * 300, "fr"), (10, "x " * 40_000, "fr"), (11, "% " + LONG, "it's"), (12, "ABC " + LONG, "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (7, 0, 1), (99, 1, 1), (None, 1, 1), (10, 1, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'mine' AS part", "'mine' AS mask", "'mine' AS first", "'mine' AS words", "'mine' AS id")
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_replay_equals_loops(spark, nothing):
    assert told(interactions.audit(*frames(spark))) == by_loops(DOCS, LABELS)


def test_empty_tables(spark, nothing):
    df, labels = frames(spark, [])
    assert interactions.audit(df, labels).collect() == []
    df, _ = frames(spark, DOCS[:4])
    assert told(interactions.audit(df, labels.limit(0))) == by_loops(DOCS[:4], [])


def test_copies_of_one_text(spark, nothing):
    docs = [(i, LONG, "en") for i in range(3000)] + [(-1, "other", "de")]
    got = {(p, o, s): c for p, o, s, *c in told(interactions.audit(*frames(spark, docs, [(0, 1, 0), (5, 1, 1)])))}
    assert got["en", "EABCD", 1][:2] == [1, 2999] and got["en", "EABCD", 1][4:6] == [1, 1]


def test_query_equals_sql(spark, sf):
    df = queries.queries()["op12_interactions"](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op12_interactions"])
    assert told(df) == set(con.sql(f"SELECT part, filter_order, step, {', '.join(COUNTS)}, shapley FROM want").fetchall())


def test_replay_is_one_shuffle_of_sums(spark, nothing):
    rows, letters = interactions.flagged(*frames(spark))
    plan = interactions.replay(rows, letters)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan
    with pytest.raises(ValueError, match="orders"):
        interactions.all_orders(rows, "ABCDEFGH")
