"""What plans read and shuffle, pattern tables, SQL functions, gates."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storyscale.functions import lexicon as L
from storyscale.functions import patterns, sql
from storyscale.operators import errors, gates, objective, pairs, patternscan, profile, rollup
from storyscale.operators.ranking import Ranking, ranked
from storyscale.plans import evaluation
from storyscale.sources.tables import stories, values


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(df):
    p = plan(df)
    return len(re.findall(r"FileScan|Scan parquet", p)), len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single)", p))


@pytest.fixture(scope="module")
def judged(spark, sf):
    return evaluation.judged(spark, sf)


def test_scans_and_shuffles(judged):
    assert counts(errors.error_slices(judged)) == (1, 1)
    scans, _ = counts(errors.all_examples(judged))
    assert scans < 6
    assert counts(rollup.objective_summaries(judged)) == (1, 1)
    assert counts(rollup.evaluation_summary(judged))[0] == 1


def test_prompts_are_ranked_without_one_task(judged):
    assert "SinglePartition" not in plan(errors.prompt_stats(judged)) and "Window" not in plan(errors.prompt_stats(judged))


def test_rankings_equal_sorting(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), float(r.randrange(5)), r.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string, x double, y int").repartition(6)
    rankings = [Ranking("low", F.col("y") < 2, [F.col("x")], [F.col("t")], F.col("i"), 7), Ranking("high", F.lit(True), [-F.col("x"), F.col("y")], [], -F.col("i"), 3), Ranking("none", F.lit(False), [], [], F.col("i"), 5), Ranking("few", F.col("i") == 9, [], [], F.col("i"), 5)]
    got = sorted((x["ranking"], x["rank"], x["i"], x["n"], x["of"]) for x in ranked(df, rankings).collect())
    low = sorted((q for q in rows if q[3] < 2), key=lambda q: (q[2], q[1] or "", q[0]))
    high = sorted(rows, key=lambda q: (-q[2], q[3], -q[0]))
    want = [("low", k + 1, q[0], len(low), 3000) for k, q in enumerate(low[:7])] + [("high", k + 1, q[0], 3000, 3000) for k, q in enumerate(high[:3])] + [("few", 1, 9, 1, 3000)]
    assert got == sorted(want)
    assert ranked(df.limit(0), rankings).collect() == []


def test_table_of_patterns_equals_masks(spark):
    r = random.Random(2)
    letters = ["a", "e", "i", "o", "u", "c", "l", "r", "s", "t", "w", "y", "h", "k", "igh", "ow", "ee"]
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(2000)} | {*L.FINAL_E_EXCEPTIONS, *L.OW_LONG_O, *L.IRREGULAR_WORDS, "ace", "cake"}
    df = values(spark, "word", [(w,) for w in sorted(words)] + [(None,)])
    table = spark.createDataFrame(patternscan.spelled_patterns(), "pattern string, kind string, part string, min_length int")
    spelled = ["digraph", "blend", "final_e", "vowel_team", "r_controlled", "l_controlled", "diphthong", "irregular"]
    out = patternscan.classified(df, table).withColumn("m", patterns.mask(F.col("word")))
    for row in out.withColumn("names", patterns.pattern_names(F.col("m"))).collect():
        if row["word"] is None:
            assert row["found"] == []
        elif "irregular" in row["found"]:
            assert "irregular" in row["names"]
        else:
            assert row["found"] == [p for p in row["names"] if p in spelled], row
    own = spark.createDataFrame([("x", "contains", "b", None), ("x", "except", "abc", None), ("y", "word", "abc", None), ("z", "prefix", "ab", 4)], "pattern string, kind string, part string, min_length int")
    got = {x["word"]: x["found"] for x in patternscan.classified(values(spark, "word", [("abc",), ("b",), ("abcd",), ("",)]), own).collect()}
    assert got == {"abc": ["y"], "b": ["x"], "abcd": ["x", "z"], "": []}
    assert patternscan.classified(df, own.limit(0)).where("size(found) > 0").isEmpty()


def test_sql_functions_equal_columns(spark, sf):
    words = profile.vocabulary(stories(spark, sf)).select("word")
    both = sql.register(spark).sql("SELECT *, word_syllables(word) AS s, word_mask(word) AS m, word_stage(word_mask(word)) AS g FROM {w}", w=words)
    m = patterns.mask(F.col("word"))
    assert both.where((F.col("s") != patterns.syllables(F.col("word"))) | (F.col("m") != m) | (F.col("g") != patterns.stage(m))).isEmpty()
    assert "PythonUDF" not in plan(both) and "ArrowEval" not in plan(both)


def test_gate_is_measured_by_the_job(spark, tmp_path):
    rows = [(i, "diphthongs" if i % 7 else "magic") for i in range(100)]
    df = spark.createDataFrame(rows, "row_ord long, t string")
    gate = gates.Gate("odd targets", F.col("t") == "magic", ["t", "row_ord"])
    gate.watch(df).write.parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match=r"odd targets in 15 of 100 rows, among them \[\('magic', 0\), \('magic', 7\)"):
        gate.check()
    fine = gates.Gate("odd targets", F.col("t") == "none", ["t"])
    fine.watch(df).write.parquet(str(tmp_path / "b"))
    assert fine.check() == 100


def test_matched_keys_in_one_scan(spark):
    rows = [(i, m, str(p), "1", "1") for i, (m, p) in enumerate([("base", 1), ("tuned", 1), ("base", 2), *[("tuned", p) for p in range(3, 12)], ("other", 99)])]
    df = spark.createDataFrame(rows, "row_ord int, model string, prompt_id string, generation_id string, seed string")
    with pytest.raises(ValueError) as e:
        pairs.require_matched(df)
    assert "'only_base': [('2', '1', '1')]" in str(e.value) and str(e.value).count("'1', '1'") == 6
    pairs.require_matched(df.where("prompt_id IN ('1', '99')"))


def test_wide_targets_equal_rows(spark, sf):
    df = profile.with_words(stories(spark, sf)).where("row_ord < 40")
    long = {(r["row_ord"], r["target"]): (r["target_distinct"], r["target_credit"], r["target_pass"]) for r in objective.target_details(df).collect()}
    wide = objective.wide_targets(df).collect()
    got = {(r["row_ord"], d): tuple(r[f"{p}_target_{k}"] for k in ("distinct", "credit", "pass")) for r in wide for p, d in L.DISPLAY.items() if r[f"{p}_target_distinct"] is not None}
    assert got == long
