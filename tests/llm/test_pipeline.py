"""The stages over one small table and over awkward ones."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from storyscale.llm import decontamination, packing, simhash
from storyscale.llm.common import ready


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ready(spark)
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf).persist()
        assert out.columns == columns and out.exceptAll(seen[-1]).isEmpty()  # rows of its predecessor alone
        seen.append(out)
    assert 0.5 * docs.count() < seen[-1].count() < docs.count()
    left = seen[-1]
    assert decontamination.matches(left, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(matches) > 0").isEmpty()
    groups = simhash.near_duplicates(left)
    assert groups.select("component_id").distinct().count() == left.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert pieces.select("doc_id").distinct().count() == left.count()
    assert corpus_pipeline.run(spark, sf).count() == packing.pack(left).count()


CLASHING = ("score", "predicted", "kept", "n_words", "votes", "posterior", "matches", "fp", "shard", "labels", "row", "__set", "detections", "base_failed")


def test_stages_keep_all_columns(spark, sf, awkward, nothing):
    """Columns named like those of operators come through with their values, types and order, on awkward rows too."""
    rows = awkward.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0"))
    rows = rows.select("doc_id", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING], F.lit(None).cast("date").alias("day"), "text").persist()
    given = Counter(tuple(r) for r in rows.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        got = Counter(tuple(r) for r in out.collect())
        assert out.schema.simpleString() == rows.schema.simpleString() and got and not got - given, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in given}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_near_dedup_finds_all_similar_texts(spark, sf):
    """One of each group by brute force over five-word shingles, joined with the groups of near fingerprints."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    spread = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(40)]  # a group beyond GROUP
    common = [" ".join([*base[:60], *(f"u{k}x{i}" for i in range(40))]) for k in range(60)]  # share many shingles, aren't similar
    extra = [(10**9 + i, t) for i, t in enumerate([*spread, *common, "a b", "A  B", "a c", ""])]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(5).persist()
    ready(spark)
    rows = {x["doc_id"]: (x["text"], x["component_id"]) for x in df.join(simhash.near_duplicates(df), "doc_id").collect()}
    sets, holders = {}, {}
    for i, (text, _) in rows.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(i, j):
        root[max(find(i), find(j))] = min(find(i), find(j))

    new = 0
    for i, (_, component) in rows.items():
        link(i, component)
    for i, s in sets.items():
        met = Counter(j for x in s for j in holders[x] if j < i)
        for j, both in met.items():
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                new += find(i) != find(j)
                link(i, j)
    assert new > 10
    kept = {x["doc_id"] for x in simhash.one_of_each(df, similar_texts=True).select("doc_id").collect()}
    assert kept == {find(i) for i in rows}
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {x["doc_id"] for x in stage(spark, df, sf).collect()} == kept
