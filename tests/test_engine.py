"""Word and text tables, golden rollups, judge, files, report, command line and streaming."""

import csv
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyscale import cli
from storyscale.functions import numeric, patterns, text
from storyscale.functions.lexicon import DIMENSIONS
from storyscale.operators import judge, objective, pairs, profile, rollup
from storyscale.plans import judged, evaluation, registry, report
from storyscale.sources import io, judges
from storyscale.sources.lexicon import read_lexicon
from storyscale.sources.tables import stories, values
from storyscale.streaming.score import score_stream

WORDS = """cat 1 short_vowel 1|stop 1 blend 2|ship 1 digraph 2|cake 1 final_e 3|rain 1 vowel_team 4|queue 1 vowel_team 4|night 1 vowel_team 4|farm 1 r_controlled 5|ball 1 l_controlled 5|small 1 blend,l_controlled 5
coin 1 diphthong 6|cow 1 diphthong 6|snow 1 blend 2|low 1 short_vowel 1|rabbit 2 multisyllabic 7|apple 3 multisyllabic 7|stale 2 blend,final_e,l_controlled,multisyllabic 7|the 1 irregular 0|because 2 irregular,multisyllabic 7|any 1 irregular 0"""


def test_word_table(spark):
    want = [tuple(w.split(" ")) for line in WORDS.split("\n") for w in line.split("|")]
    w = F.col("word")
    names = F.filter(patterns.pattern_names(F.col("m")), lambda p: p != "basic_or_unclassified")
    df = values(spark, "word", [(x[0],) for x in want]).withColumn("m", patterns.mask(w))
    got = df.select("word", patterns.syllables(w).cast("string"), F.when(F.col("m") == 0, "short_vowel").otherwise(F.array_join(names, ",")), patterns.stage(F.col("m")).cast("string")).collect()
    assert [tuple(r) for r in got] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.floats(-1000, 1000), st.integers(-10**6, 10**6).map(lambda k: k / 20000), st.integers(-5000, 5000).map(lambda k: k / 32)), min_size=1, max_size=60))
def test_rounding_is_exact(spark, xs):
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(numeric.exact_round(F.col("x"))).collect()]
    assert got == [round(float(x), 4) + 0.0 for x in xs]


# fixed values: compliance and words of 42 recorded rows, three for each of seven prompts and either model, and their rollups
RECORDED = {
    "base": (
        "0.4977 0.5673 0.5024 0.7981 0.8294 0.7401 0.6202 0.5659 0.6259 1.0 1.0 1.0 0.7053 0.6893 0.7186 0.4842 0.3869 0.4313 0.6571 0.7081 0.6946",
        "215 171 205 208 170 177 208 205 147 202 209 138 190 206 167 190 199 211 175 161 203",
    ),
    "tuned": (
        "0.8571 0.6571 0.8207 0.8163 0.8205 0.907 0.8171 0.8696 0.8 1.0 1.0 1.0 0.803 0.9067 0.9048 0.7143 0.7692 0.7708 0.9014 0.8824 0.8136",
        "28 35 184 49 39 43 82 46 90 35 51 65 66 75 147 28 65 48 71 34 59",
    ),
}
SUMMARY = {"decodability_compliance": (0.6773, 0.8491, 0.1718), "word_count": (188.4286, 63.8095, -124.6191)}
BY_PROMPT = {
    "base": "0.5225 197.0 0.7892 185.0 0.604 186.6667 1.0 183.0 0.7044 187.6667 0.4341 200.0 0.6866 179.6667",
    "tuned": "0.7783 82.3333 0.8479 43.6667 0.8289 72.6667 1.0 50.3333 0.8715 96.0 0.7514 47.0 0.8658 54.6667",
}


@pytest.fixture(scope="module")
def recorded(spark):
    rows, n = [], 0
    for model, (rates, counts) in RECORDED.items():
        for i, (rate, count) in enumerate(zip(rates.split(), counts.split(), strict=True)):
            rows.append((n, model, f"p{i // 3}", str(i % 3 + 1), str(1001 + i % 3), "diphthongs", float(rate), int(count)))
            n += 1
    df = spark.createDataFrame(rows, "row_ord int, model string, prompt_id string, generation_id string, seed string, target_phonics string, decodability_compliance double, word_count int")
    rest = {*rollup.METRICS, *rollup.SECONDARY, "target_satisfaction_rate"} - set(df.columns)
    return df.withColumns({c: F.lit(0.0) for c in rest})


def test_recorded_summaries(recorded):
    got = {r["metric_key"]: (r["base_mean"], r["tuned_mean"], r["tuned_minus_base"]) for r in rollup.evaluation_summary(recorded, with_judge=False).collect()}
    assert {k: got[k] for k in SUMMARY} == SUMMARY
    by = {(r["model"], r["prompt_id"]): (r["Decodability compliance"], r["Mean word count"]) for r in rollup.objective_summary(recorded, "model", "prompt_id").collect()}
    for model, values_ in BY_PROMPT.items():
        want = list(map(float, values_.split()))
        assert [x for p in range(7) for x in by[model, f"p{p}"]] == want


def test_recorded_pairs(recorded):
    deltas = [r["compliance_delta"] for r in pairs.paired_comparison(recorded).collect()]
    assert len(deltas) == 21 and min(deltas) >= -0.01
    want = [round(float(t) - float(b), 4) for b, t in zip(RECORDED["base"][0].split(), RECORDED["tuned"][0].split())]
    assert sorted(deltas) == sorted(want)
    pairs.require_matched(recorded)
    with pytest.raises(ValueError, match="only_base"):
        pairs.require_matched(recorded.where("NOT (model = 'tuned' AND generation_id = '1')"))


def test_row_properties(spark, sf):
    df = objective.scored(stories(spark, sf))
    assert df.where("abs(decodability_compliance + above_level_rate - 1) > 0.00011 OR on_or_below_level_rate <> decodability_compliance AND word_count > 0 OR unique_word_count > word_count").isEmpty()
    assert df.where("permitted_ceiling_stage = 7 AND decodability_compliance < 1").isEmpty()
    rows = lambda d: sorted(d.collect(), key=lambda r: r["row_ord"])
    assert rows(objective.objective_rows(stories(spark, sf).repartition(7))) == rows(objective.objective_rows(stories(spark, sf)))


def test_lexicon(spark, tmp_path):
    (tmp_path / "lex.txt").write_text(";;; note\nANY  EH1 N IY0\nANY(2)  EH1 N IY0 Z\nGAMES  G EY1 M Z\nHM  HH M\n")
    lex = read_lexicon(spark, str(tmp_path / "lex.txt"))
    assert {r["word"]: r["syllables"] for r in lex.collect()} == {"any": 2, "games": 1, "hm": 1}
    df = values(spark, "row_ord model prompt_id generation_id seed target_phonics story", [("1", "base", "p", "1", "1", "vowel teams", "any games cat"), ("2", "base", "p", "1", "1", "vowel teams", "")])
    rate = lambda lex: {r["row_ord"]: r["above_level_words"] for r in objective.scored(df, lex).collect()}
    assert rate(lex) == {"1": "any", "2": ""} and rate(None) == {"1": "games", "2": ""} and read_lexicon(spark, None) is None


def test_empty_and_null_stories(spark):
    df = values(spark, "row_ord model prompt_id generation_id seed target_phonics story", [("1", "base", "p", "1", "1", "", ""), ("2", "tuned", "p", "1", "1", None, None)])
    for r in objective.objective_rows(df).collect():
        assert (r["word_count"], r["decodability_compliance"], r["incomplete_reasons"], r["target_phonics_coverage"]) == (0, 1.0, "empty_story", 0.0)


def test_judge_retries_log_and_merge(spark, tmp_path):
    calls, slept = [], []

    def flaky(messages):
        calls.append(messages)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert judge.call(flaky, [], bool, 4, 0.6, slept.append) == "ok" and slept == pytest.approx([0.6, 1.2])
    with pytest.raises(RuntimeError):
        judge.call(lambda m: "", [], bool, 2, 0, lambda s: None)
    df = values(spark, "model prompt_id generation_id seed target_phonics prompt story row_ord", [("base", "p", str(i), "1", "diphthongs", "do", f"story {i}", str(i)) for i in range(6)])
    asked = df.withColumn("messages", judge.story_messages(F.col("target_phonics"), F.col("prompt"), F.col("story")))
    assert "base" not in str(asked.select("messages").first())
    log = str(tmp_path / "log")
    first = judge.judge_with_log(spark, asked.limit(2), judges.recorded(2), log, pause=0)
    assert first.count() == 2
    all_ = judge.judge_with_log(spark, asked, judges.recorded(0), log, pause=0)
    scores = [r["spec_adherence_score"] for r in judge.validate(all_, "response", judge.STORY_DIMENSIONS).collect()]
    assert sorted(scores) == [0, 0, 0, 0, 2, 2]  # what was judged stays
    groups = judge.consistency_messages(df).collect()
    assert len(groups) == 1 and groups[0]["messages"][1]["content"].count("[generation_id=") == 6


def dying(at):
    """A judge that breaks off at one story."""
    answer = judges.recorded(1)

    def judge_of(messages):
        if f"story {at}" in messages[1]["content"]:
            raise TimeoutError
        return answer(messages)

    return judge_of


def test_judge_back_off():
    slept = []
    with pytest.raises(RuntimeError):
        judge.call(lambda m: "", [], bool, 6, judge.doubling, slept.append)
    assert slept == [1, 2, 4, 8, 16, 20]
    accept = judge.acceptable(("consistency",))
    assert accept('x {"consistency": {"score": 1, "justification": "y"}}') and not accept('{"consistency": {"score": true, "justification": "y"}}') and not accept("none")


def test_judged_run_writes_all_files(spark, sf, tmp_path):
    rows = stories(spark, sf).where("row_ord < 50")
    who = lambda m: json.dumps({d: {"score": len(m[1]["content"]) % 3, "justification": "Said."} for d in ("spec_adherence", "robustness", "task_quality", "consistency")})
    out = judged.judged_rows(spark, objective.scored(rows), who, str(tmp_path / "log"), pause=0).persist()
    judged.write_run(out, str(tmp_path / "r"))
    read = lambda n: list(csv.DictReader((tmp_path / "r" / n).open(encoding="utf-8")))
    assert len(list((tmp_path / "r").rglob("*.csv"))) == 10
    scored = read("scored_outputs.csv")
    assert len(scored) == 50 and all(r["spec_adherence_score"] and r["consistency_score"] for r in scored)
    mean = {r["metric_key"]: r for r in read("evaluation_summary.csv")}["task_quality_score"]
    for m in ("base", "tuned"):
        got = [int(r["task_quality_score"]) for r in scored if r["model"] == m]
        assert abs(float(mean[f"{m}_mean"]) - sum(got) / len(got)) < 1e-4
    assert {r["failure_type"] for r in read("error_analysis.csv")} >= {"low_task_quality"}
    again = judged.judged_rows(spark, objective.scored(rows), dying(""), str(tmp_path / "log"), pause=0)  # all is in the logs: nobody is asked
    assert again.where("consistency_score is not null").count() == 50


def test_chat_judges():
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    assert judges.resolve(None, "m", {"OPENAI_API_KEY": "k"}).body(m)["messages"] == m
    a = judges.resolve("anthropic", "m", {"ANTHROPIC_API_KEY": "k"})
    assert a.body(m)["system"] == "s" and a.headers()["x-api-key"] == "k"
    with pytest.raises(ValueError):
        judges.resolve(None, "m", {})


def test_text_helpers(spark):
    df = values(spark, "t", [("  long text here  ",), ("short",), (None,)])
    assert [r[0] for r in df.select(text.truncate(F.col("t"), 8)).collect()] == ["long te…", "short", ""]


def test_mid_phrase_as_in_sql(spark, tmp_path):
    """A word begins behind any character but A-Z, a-z, 0-9 and _, as the query's SQL takes it."""
    ends = ["elleêan", "ellean", "elle an", "El and", "señor", "seño7an", "x_the", "naïf—to", "dіTHE", "wıth", "an"]
    (tmp_path / "d").mkdir()
    docs = spark.createDataFrame([(i, f"Cat and dog run to the hill. They sit. {e}", "src01") for i, e in enumerate(ends)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/documents.parquet/*.parquet')")
    query = registry.QUERIES["objective_rows"]
    want = con.execute(f"SELECT row_ord, incomplete_reasons FROM ({query.oracle}) ORDER BY row_ord").fetchall()
    got = query.run(spark, str(tmp_path / "d")).select("row_ord", "incomplete_reasons").orderBy("row_ord").collect()
    assert [tuple(r) for r in got] == want and want[0][1] == "ends_mid_phrase,no_terminal_punctuation"


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "outputs.csv")
    io.export_csv(stories(spark, sf).where("row_ord < 60").orderBy("row_ord").drop("row_ord"), path, bom=True)
    return path


def test_outputs_come_back(spark, sf, outputs):
    rows = stories(spark, sf).where("row_ord < 60").orderBy("row_ord")
    assert [r["story"] for r in io.read_outputs(spark, outputs).orderBy("row_ord").collect()] == [r["story"] for r in rows.collect()]


def test_command_evaluate(outputs, tmp_path, capsys):
    assert cli.main(["evaluate", outputs, "--to", str(tmp_path / "r")]) == 0
    assert len(list(csv.DictReader((tmp_path / "r/objective_rows.csv").open(encoding="utf-8", newline="")))) == 60
    assert "Summary by model" in capsys.readouterr().out
    assert cli.main(["evaluate", outputs, "--to", str(tmp_path / "r"), "--matched"]) == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("model,prompt_id,generation_id,seed,target_phonics,prompt,story\nbase,p,1,1,magic,x,y\n")
    assert cli.main(["evaluate", str(bad), "--to", str(tmp_path / "r")]) == 1


def test_command_judge_and_errors(outputs, tmp_path):
    five = tmp_path / "five"
    run = ["judge", outputs, "--to", str(five), "--log", str(tmp_path / "log"), "--pause", "0", "--legacy"]
    judged_rows = lambda: [r for r in csv.DictReader((five / "judge_rows.csv").open(encoding="utf-8", newline="")) if r["subjective_total"]]
    count = lambda: len({tuple(r[k] for k in judged.FIVE_KEYS) for r in judged_rows()})
    assert cli.main([*run, "--limit", "10"]) == 0 and count() == 10
    assert cli.main([*run, "--limit", "10"]) == 0 and count() == 10  # the limit counts what was judged before
    assert cli.main(run) == 0 and len(judged_rows()) == 60
    assert cli.main(["errors", str(five / "scored_rows.parquet"), "--to", str(five)]) == 0
    assert "Likely cause:" in (five / "error_analysis.md").read_text()
    assert cli.main(["errors", str(tmp_path / "none.parquet"), "--to", str(five)]) == 1


def test_command_prompts(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"prompt_id": "a", "target_phonics": ["diphthongs"]}, {"prompt_id": "b", "target_phonics": ["blends"]}]))
    assert cli.main(["prompts", str(tmp_path / "p.json"), "--to", str(tmp_path / "r")]) == 0
    text_ = (tmp_path / "r/prompts_ready.json").read_text()
    assert "coin, out, toy, cloud" in text_ and text_ == json.dumps(json.loads(text_), indent=2, ensure_ascii=False)


def test_command_profile(tmp_path):
    (tmp_path / "s.csv").write_text("story,menon_hiebert_level,extra\nThe cat sat.,3.0,x\nA long day,abc,y\n")
    assert cli.main(["profile", str(tmp_path / "s.csv"), "--to", str(tmp_path / "r")]) == 0
    out = list(csv.DictReader((tmp_path / "r/profiled.csv").open(encoding="utf-8-sig")))
    assert [r["extra"] for r in out] == ["x", "y"] and out[1]["review_reason"] == "missing or unsupported assigned level"


def test_report(spark, sf):
    told = evaluation.judged(spark, sf).join(stories(spark, sf).select("row_ord", F.concat(F.lit("```\n"), F.left("story", F.lit(60))).alias("story")), "row_ord").withColumn("coherence_justification", F.lit("Told so."))
    out = report.error_report(told)
    sections = dict(x.split("\n\n", 1) for x in out.removeprefix("## ").split("\n\n## "))
    assert list(sections) == ["How to read this", "Largest gains", "Smallest gains", "Failure modes", "Prompt difficulty", "Concentration", "Conditions harder than average", "Examples", "Likely causes"]
    assert sections["Largest gains"].count("\n| ") == 5 and "| all tuned outputs |" in sections["Concentration"]
    assert "Most difficult prompt: " in sections["Prompt difficulty"] and sections["Conditions harder than average"].count("\n- ") == 5
    examples = sections["Examples"].split("### ")[1:]
    assert len(examples) == 8  # two gains, five modes, the hardest prompt
    assert all("- Judge on coherence: Told so." in x and x.count("````text\n```\n") == 2 and "\n- Base: compliance" in x for x in examples)
    assert all(x in sections["Failure modes"] for x in report.MODE_NOTES) and "% |" in sections["Failure modes"]
    plain = report.error_report(evaluation.judged(spark, sf))
    assert "Tuned story" not in plain and "## Likely causes" in plain
    assert report.percent(0.12345) == "12.3%" and report.percent(None) == "n/a"


def test_interpretation(spark):
    rows = [("base", "p", 0.5, 0.2, 0.5, 0.0, 1), ("tuned", "p", 0.6, 0.3, 0.505, 0.0, 2), ("tuned", "q", 0.6, 0.3, 0.505, 0.0, None)]
    df = spark.createDataFrame(rows, "model string, prompt_id string, decodability_compliance double, weighted_above_level_rate double, target_satisfaction_rate double, phonics_leakage_rate double, score int")
    df = df.withColumns({f"{d}_score": F.col("score") for d in DIMENSIONS})
    out = report.interpretation(rollup.interpretation(df), rollup.hardest_prompts(df))
    good, bad = out.split("Regressed by the metrics:")[0], out.split("Regressed by the metrics:")[1]
    assert "decodability compliance: 0.500 to 0.600" in good and "weighted above level rate: 0.200 to 0.300" in bad and "satisfaction" not in out
    assert "coherence: 1.00 to 2.00" in out and "  - p: " in out and "  - q: " not in out
    assert "missing" in report.interpretation(rollup.interpretation(df.where("model = 'tuned'")), rollup.hardest_prompts(df))


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# note\nA=1\nexport B='two'\nC\n")
    env = {"A": "0"}
    io.load_env(str(tmp_path / ".env"), env)
    assert env == {"A": "0", "B": "two"}


def test_stream_equals_batch(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    stories(spark, sf).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = score_stream(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").exceptAll(objective.objective_rows(spark.read.parquet(source))).isEmpty() and spark.table("scored").count() == 200


def test_profile_json(spark):
    r = profile.story_profile(values(spark, "story", [("snow and snow",)])).first()
    assert json.loads(r["flagged_words_json"])[1] == {"word": "snow", "count": 2, "patterns": ["blend"], "notes": ["not found in CMU pronunciation dictionary", "ow may represent long-o"]}
