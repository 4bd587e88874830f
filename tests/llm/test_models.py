"""Toxicity, language model, near duplicates and decontamination against brute force, held-out rows and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storyscale.llm import decontamination, lm, simhash, toxicity
from storyscale.llm.common import ready
from storyscale.llm.words import ALNUM, words

LOWER = {i: i + 32 for i in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels), carry=["doc_id"])
    rows = out.join(labels, "doc_id").where(toxicity.held_out()).select("toxic", "score").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc > 0.85 and np.mean([n < 0.7 for n in neg]) > 0.97


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, "The sun is up. " * 5 + ("You are a dreadnaught fool. " if i % 4 == 0 else "You are a kind friend. ") + "It was warm. " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    for r in out.collect():
        assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        assert [s["start"] for s in r["offending"]] == ([75] if r["predicted"] else [])


def test_toxicity_scores_by_brute_force(spark):
    """Noisy-or over the sentences by dictionaries and products, from the model's weights of words and stems."""
    d = "/root/testdata/sf0.001"
    docs, labels = ready(spark).read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))

    def keys(word):
        buf = np.frombuffer(word, np.uint8)
        w = words(buf, np.array([0, len(buf)]), ALNUM, toxicity.STEM)
        return {int(w.hash[0])} | ({int(w.prefix[0])} if w.prefix[0] else set())

    for r in toxicity.score(docs, model).limit(60).collect():
        fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in r["text"] or "")
        clean, n = 1.0, 0
        for part in re.split(r"[.!?\n]", fold):
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part)
            if found:
                n += 1
                z = model.bias + sum(weight.get(k, 0.0) for k in set().union(*(keys(w.encode()) for w in found)))
                clean /= 1 + math.exp(z)
        odds = math.log(max(1 / clean - 1, 1e-12))
        want = 1 / (1 + math.exp(-(model.scale * min(max(odds, -12), 12) + model.shift)))
        assert r["n_sentences"] == n and math.isclose(r["score"], want, rel_tol=1e-6), r["doc_id"]


def test_toxicity_gradient_by_differences():
    r = np.random.default_rng(2)
    n_sent, y = 40, np.array([1, 0, 1, 0, 0, 1.0])
    text = np.sort(r.integers(0, 6, n_sent))
    pairs = np.unique(r.integers(0, n_sent * 9, 150))
    sent, word, w, b, weight = pairs // 9, pairs % 9, r.random(9), -2.0, r.random(6)
    at = lambda w, b: toxicity.loss(w, b, word, sent, text, y, weight, n_sent)
    _, dw, db = at(w, b)
    e = 1e-6
    for i in range(9):
        step = e * (np.arange(9) == i)
        assert math.isclose((at(w + step, b)[0] - at(w - step, b)[0]) / (2 * e), dw[i], rel_tol=1e-5, abs_tol=1e-8)
    assert math.isclose((at(w, b + e)[0] - at(w, b - e)[0]) / (2 * e), db, rel_tol=1e-5)


def test_toxicity_fit_is_the_same_for_texts_of_one_id(spark):
    rows = [(i, f"you dread fool {i % 7} {k}" if i % 2 else f"you kind friend {i % 5} {k}") for i in range(300) for k in (0, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (toxicity.train(x, labels) for x in (df.repartition(3), df.orderBy(F.desc("text")).repartition(5)))
    assert np.array_equal(one.hashes, two.hashes) and np.allclose(one.weights, two.weights)


def test_toxicity_takes_awkward_tables(spark, awkward, nothing, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    out = toxicity.score(awkward, model)
    assert out.count() == awkward.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels.limit(0))).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


# -- language model


def reference(train):
    """Counts of words, and p(u, v, w): modified Kneser-Ney of order 3 by dictionaries."""
    c = Counter(w for t in train for w in t)
    triples = Counter(x for t in train for x in zip([None, None, *t], [None, *t], t))
    pairs = Counter((v, w) for _, v, w in triples)  # numbers of different u
    words = Counter(w for _, w in pairs)  # numbers of different v

    def level(counts):
        d = [0, *lm._discounts([sum(n == k for n in counts.values()) for k in range(1, 5)])]
        total, kept = Counter(), Counter()
        for key, n in counts.items():
            total[key[:-1]] += n
            kept[key[:-1]] += d[min(n, 3)]

        def p(key, low):
            h, n = key[:-1], counts[key]
            return max(n - d[min(n, 3)], 0) / total[h] + kept[h] / total[h] * low if total[h] else low

        return p

    one, two, three = level(Counter({(w,): n for w, n in words.items()})), level(pairs), level(triples)
    return c, lambda u, v, w: three((u, v, w), two((v, w), one((w,), 1 / (len(c) + 1))))


@pytest.mark.parametrize("wide", [False, True])
def test_lm(spark, docs, awkward, wide):
    df = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    frequent = spark.createDataFrame([(1000 + i, "the " * 300 + f"the the w{i}") for i in range(100)], "doc_id long, text string")  # words and pairs that fill buckets
    df = df.unionByName(frequent)
    rows = df.collect()
    model = lm.train(df.where(~lm.held_out()), wide=wide)
    out = lm.score(df, model).collect()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    end = "\n"
    train = [[*spaced(r["text"]), end] for r in rows if crc(r["doc_id"])]
    c, p = reference(train)
    n = sum(c.values())
    assert abs(sum(p("the", "the", w) for w in [*c, "\tunknown"]) - 1) < 1e-9
    want = []
    for r in rows:
        t = [*spaced(r["text"]), end]
        want.append((str(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t), sum(math.log10(p(*x)) for x in zip([None, None, *t], [None, *t], t))))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-7) and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-7)
    assert len(model.edges[0]) > 4 and model.split


def test_lm_sorts_numbers_alone(docs, monkeypatch):
    """A block's words, pairs and triples are sorted as single numbers, which costs a tenth of a sort by columns."""
    model = lm.train(docs)
    (h, starts, _), *_ = lm._blocks(docs.select("text").toArrow().to_batches())
    want = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}

    def refused(*_):
        raise AssertionError("sorted by columns")

    monkeypatch.setattr(np, "lexsort", refused)
    monkeypatch.setattr(np, "argsort", refused)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    for i, x in zip(ids, lm._score(model, h, starts)[3]):
        assert math.isclose(x, want[i], rel_tol=1e-9)
    twice = np.append(h, h)
    cols, c = lm._counted_triples(model, twice, np.append(starts, starts + len(h)))
    assert c.sum() == len(twice) and (c % 2 == 0).all() and len(cols) == 3


@pytest.mark.parametrize("most", [9, 1 << 31])
@pytest.mark.parametrize("kind", ["<u4", "<u8"])
def test_lm_sums_rows(most, kind):
    """Columns that fit one number of 64 bits and columns that don't."""
    r = np.random.default_rng(3)
    cols = [r.choice(r.integers(5, most, 6), 500).astype(kind) for _ in range(3)]
    n = r.integers(1, 9, 500)
    want, of = np.unique(np.stack(cols), axis=1, return_inverse=True)
    for counts, sums in ((None, np.bincount(of)), (n, np.bincount(of, n))):
        out, got = lm._summed(list(cols), counts)
        assert all(np.array_equal(a, b) and a.dtype == kind for a, b in zip(out, want, strict=True)) and np.array_equal(got, sums)


@pytest.mark.parametrize("low", [0, 60])
def test_lm_distinct_numbers(low):
    """Numbers that differ in their lowest bits alone, and in their highest alone."""
    r = np.random.default_rng(4)
    key = (np.uint64(1) << np.uint64(62)) + (r.integers(0, 4, 999).astype(np.uint64) << np.uint64(low))
    want, at = np.unique(key, return_inverse=True)
    got, row, place = lm._distinct(key, 64)
    assert np.array_equal(got, want) and np.array_equal(key[row], want) and np.array_equal(place, at)
    assert [len(x) for x in lm._distinct(key[:0], 64)] == [0, 0, 0]


def test_lm_places_within_ranges():
    r = np.random.default_rng(5)
    sizes, rows = r.choice([0, 1, 2, 3, 7, 64, 900], 300), r.choice([0, 1, 2, 40], 300)
    ranges = [np.sort(r.choice(2000, k, replace=False)).astype(np.uint32) for k in sizes]
    wanted = [np.sort(r.choice(2002, k, replace=False)).astype(np.uint32) for k in rows]
    hi = np.cumsum(sizes)
    place, there = lm._within(np.concatenate(ranges), hi - sizes, hi, np.concatenate(wanted), np.append(0, np.cumsum(rows)))
    want = [(lo + np.searchsorted(a, x), x in a) for lo, a, xs in zip(hi - sizes, ranges, wanted) for x in xs]
    assert list(zip(place.tolist(), there.tolist())) == want


@pytest.mark.parametrize("most", [3, 3000])
def test_lm_starts(tmp_path, most):
    starts = np.cumsum(np.random.default_rng(1).integers(1, most, 1000))
    lm._write_starts(f"{tmp_path}/x.{most}", starts)
    assert np.array_equal(lm._starts(f"{tmp_path}/x.{most}", np.arange(1000)), starts)


def test_lm_without_rows(docs, nothing):
    model = lm.train(nothing)
    assert lm.score(nothing, model).count() == 0
    r = lm.score(docs.limit(3), model).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


# -- near duplicates


def fingerprint(text):
    w = spaced(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in runs:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum((2 * n > len(runs)) << k for k, n in enumerate(ones))


def components_of(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = np.array([fps[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= 2):
            x, y = find(i), find(ids[a + 1 + b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs):
    base = docs.select("doc_id", "text").collect()
    more = [(5000 + i, (r["text"] + " again") if len(r["text"]) > 3000 else r["text"]) for i, r in enumerate(base[:60])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, (9001, None), (9002, ""), (9003, "a b"), (9004, "A  b")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = components_of(fps)
    got = {r["doc_id"]: (r["f"], r["component_id"]) for r in simhash.near_duplicates(df).withColumn("f", simhash.hexed(F.col("fp"))).collect()}
    assert got == {i: (format(fps[i], "016x"), want[i]) for i in texts}
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == set(want.values())


def test_links_in_large_buckets_and_chains(spark):
    """Fingerprints in chains and clusters, with a bucket bound so small that most go the half-way path."""
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))  # a chain of steps of up to two bits
    fps |= {r.getrandbits(64) for _ in range(200)}
    want = components_of({simhash._signed(x): x for x in fps})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for bucket in (3, 1024):
        got = {r["u"]: r["v"] for r in simhash.components(simhash.links(df, 2, bucket)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_thresholds_guarantee_the_radius():
    costs = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 9, 1: 90}]
    assert simhash.allocate(costs, 0) == (7.0, [0, 1, -1])
    both = np.full((65, 65), 250.0)  # independent bits
    np.fill_diagonal(both, 500)
    both[64, :] = both[:, 64] = 500
    both[64, 64] = 1000
    both[3, 40] = both[40, 3] = 500
    parts = simhash.group_bits(both, 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and any({3, 40} <= set(p) for p in parts)


def test_near_duplicates_take_awkward_tables(awkward, nothing):
    assert simhash.near_duplicates(awkward).count() == awkward.count() and simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and simhash.one_of_each(nothing).count() == 0
    odd = ["fp", "__id", "__fp", "__set", "__n", "id", "root", "first"]
    named = awkward.selectExpr("doc_id", "text", *[f"'mine {c}' AS {c}" for c in odd])
    for same in (False, True):
        back = simhash.one_of_each(named, similar_texts=same)
        assert back.columns == named.columns and {tuple(r)[2:] for r in back.collect()} == {tuple(f"mine {c}" for c in odd)}
    texts = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} <= texts
    groups = {}
    for r in simhash.near_duplicates(awkward).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()} == set(groups)
    # rows 1 to 3 have no word and go together, as do the three copies
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "8", "9", "None"]


# -- decontamination


def shingled(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    k = min(5, len(w))
    return w, k, Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def best(text, item):
    w, _, _ = shingled(text)
    iw, k, bag = shingled(item)
    size, top = min(len(iw), len(w)), 0.0
    if not iw or len(w) < k:
        return 0.0
    for a in range(len(w) - size + 1):
        g = Counter(tuple(w[q : q + k]) for q in range(a, a + size - k + 1))
        b = sum((g & bag).values())
        top = max(top, b / (sum(g.values()) + sum(bag.values()) - b))
    return top


def test_decontamination(spark, docs, sf, awkward):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()][:8]
    text = items[0][1].split()
    near, far = text.copy(), text.copy()
    near[len(near) // 2 :] = near[len(near) // 2 :][:-1] + ["changed"]
    far[::6] = ["other"] * len(far[::6])
    more = [(1, " ".join(["start"] * 20 + text + ["end"] * 20)), (2, " ".join(near)), (3, " ".join(far)), (4, items[1][1].upper().replace(" ", " -- ")), (5, " ".join(text * 3)), (6, None), (7, ""), (8, "tiny item"), (9, "TINY   item, tiny item")]
    items += [(900, "tiny item"), (901, None), (902, ""), (903, items[0][1])]
    df = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id > 20").limit(60))
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = df.collect()
    want = {(r["doc_id"], i): v for r in rows for i, t in items if (v := best(r["text"], t)) >= 0.8}
    for block in (32 << 20, 700):  # one block, and several
        got = {(r["doc_id"], m["item_id"]): m["similarity"] for r in decontamination.matches(df, b, block=block).collect() for m in r["matches"]}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_decontamination_takes_awkward_tables(spark, awkward, nothing):
    bench = spark.createDataFrame([(None, "no id here at all"), (2, None)], "item_id long, text string")
    out = decontamination.matches(awkward, bench)
    assert out.count() == awkward.count() and sum(len(r["matches"]) for r in out.collect()) == 1
    assert decontamination.matches(nothing, bench).count() == 0 and decontamination.matches(awkward, bench.limit(0)).where(F.size("matches") > 0).count() == 0
