"""Periodic runs against a search of every period, and on awkward rows."""

import hashlib
import random
import re
import zlib

from storyscale.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_period(w, least=24, times=3):
    """(start, length, period) of all runs, by trying each period from the shortest."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        w = [str(r.randrange(r.choice([1, 2, 3, 10]))) for _ in range(r.randrange(0, 70))]
        for _ in range(r.randrange(3)):  # repetitions, also within repetitions
            if len(w) > 3:
                a = r.randrange(len(w))
                p = 1 + r.randrange(min(9, len(w) - a))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))] + ["x"] * r.randrange(2)
        yield w


def test_scan_equals_search_of_every_period():
    made = list(texts(5, 400))
    for least, times in ((24, 3), (6, 3), (4, 2), (2, 2)):
        for i in range(0, len(made), 9):
            part = made[i : i + 9]
            n, found, left = runs.scan([" ".join(w).encode() for w in part], least, times)
            for w, k, f, x in zip(part, n, found, left):
                want = every_period(w, least, times)
                assert (k, list(zip(*(a.tolist() for a in f)))) == (len(w), want)
                assert x.decode() == collapsed(w, want)


def test_long_repetitions_take_few_steps():
    for w in (["a"] * 100_000, ["a", "b", "c"] * 30_000, [str(i) for i in range(20_000)] * 3):
        _, (f,), _ = runs.scan([" ".join(w).encode()])
        assert (f.start.tolist(), f.length.tolist(), f.period.tolist()) == ([0], [len(w)], [len(set(w))])


def test_words_in_common_bound():
    assert runs.shortest_shared(24, 3) == 16 and runs.shortest_shared(2, 2) == 1


def test_query_equals_brute_force(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op11_runs"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = every_period(w) if len(w) < 1500 or h % 10 == 0 else None
        r = got[doc_id]
        if want is None:
            continue
        some += bool(want)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if want else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(want), *best, milli)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
    assert some > 5


def test_awkward_tables(awkward, nothing):
    got = runs.find(awkward).collect()
    assert len(got) == 11
    for r in got:
        w = WORD.findall(r["text"] or "")
        assert (r["n_words"], r["score"], r["shard"]) == (len(w), "clash", "clash")
        if len(w) < 2000:
            want = every_period(w)
            assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == collapsed(w, want)
    assert runs.find(nothing).collect() == []
    clash = awkward.selectExpr("doc_id", "text", "'mine' AS runs", "'mine' AS collapsed", "'mine' AS __text")
    assert {r["__text"] for r in runs.find(clash).collect()} == {"mine"}


def test_foremost_compares_exactly(spark):
    df = spark.createDataFrame([([(0, 30, 10), (5, 3, 1), (7, 300, 100)],), ([],), ([(1, 31, 10), (2, 310, 100), (3, 3101, 1000)],)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r[0] and tuple(r[0]) for r in df.select(runs.foremost(df["runs"])).collect()]
    assert got == [(0, 30, 10), None, (3, 3101, 1000)]
