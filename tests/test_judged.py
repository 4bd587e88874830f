"""The log of judge responses: what a run that dies loses, null keys, tasks at once, and what is accepted."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyscale.functions.lexicon import DIMENSIONS, STORY_DIMENSIONS
from storyscale.operators import judge
from storyscale.plans import evaluation, judged
from storyscale.sources import judgelog, judges
from storyscale.sources.tables import values

KEYS = ("model", "prompt_id", "generation_id", "seed")


def asked(spark, n, key=str):
    rows = [("base", "p", key(i), "1", "diphthongs", "do", f"story {i}.", str(i)) for i in range(n)]
    df = values(spark, "model prompt_id generation_id seed target_phonics prompt story row_ord", rows).withColumn("row_ord", F.col("row_ord").cast("long"))
    return df.withColumn("messages", judge.story_messages(F.col("target_phonics"), F.col("prompt"), F.col("story")))


def noting(folder, at=None, score=1):
    """A judge that notes each request in a file of its own, and breaks off at one story."""
    answer = judges.recorded(score, (*STORY_DIMENSIONS, *judge.CONSISTENCY))

    def judge_of(messages):
        story = messages[1]["content"].split("Story to evaluate:\n")[1].split("\n")[0]
        (folder / f"{story} {time.time_ns()}").touch()
        if story == f"story {at}.":
            raise TimeoutError
        return answer(messages)

    return judge_of


def calls(folder):
    return Counter(f.name.split(".")[0] for f in folder.iterdir())


def test_run_that_dies_loses_one_chunk_a_task(spark, tmp_path):
    log, told = str(tmp_path / "log"), tmp_path / "told"
    told.mkdir()
    df = asked(spark, 12)
    with pytest.raises(Exception):
        judge.judge_with_log(spark, df, noting(told, 5), log, pause=0, retries=1, wait=0, tasks=1, chunk=2)
    assert judgelog.replies(spark, log, KEYS).count() == 4  # two chunks are through; only the third is lost
    assert judge.judge_with_log(spark, df, noting(told), log, pause=0, limit=1, tasks=1).count() == 5  # the limit counts what is left
    out = judge.judge_with_log(spark, df.union(df), noting(told), log, pause=0, tasks=3, chunk=2)
    assert out.count() == 12
    assert all(n <= 2 for n in calls(told).values()) and sum(calls(told).values()) == 14  # stories 4 and 5 twice
    judge.judge_with_log(spark, df, noting(told, ""), log, pause=0)
    assert sum(calls(told).values()) == 14  # nobody is asked
    commits = [json.loads(f.read_text()) for f in (tmp_path / "log/commits").iterdir()]
    assert sorted(c["asked"] for c in commits) == [1, 7] and all((tmp_path / "log/replies" / f).exists() for c in commits for f in c["files"])


def test_task_that_runs_again_skips_its_chunks(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()
    log = judgelog._ready(spark, str(tmp_path / "log"))
    rows = [r for r in asked(spark, 6).withColumn("chunk", F.expr("row_ord div 2")).orderBy("row_ord").collect()]
    dies = judgelog.ReplyWriter(log, "plan", KEYS, noting(told, 4))
    with pytest.raises(TimeoutError):
        dies.write(iter(rows))
    again = judgelog.ReplyWriter(log, "plan", KEYS, noting(told)).write(iter(rows))
    assert again.asked == 2 and len(again.files) == 3
    assert calls(told) == Counter({"story 4": 2, **{f"story {i}": 1 for i in (0, 1, 2, 3, 5)}})


def test_null_keys_end(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()
    df = asked(spark, 3, lambda i: None if i == 1 else str(i)).drop("messages")
    ask = noting(told, score=2)
    for _ in range(2):
        out = judged.judged_stories(spark, df, ask, str(tmp_path / "log"), KEYS, STORY_DIMENSIONS, pause=0)
        assert [r["robustness_score"] for r in out.orderBy("row_ord").collect()] == [2, 2, 2]
    assert calls(told) == Counter({f"story {i}": 1 for i in range(3)})


def test_four_tasks_ask_at_once(spark, tmp_path):
    here = tmp_path / "here"
    here.mkdir()
    answer = judges.recorded(1)

    def waits(messages):
        (here / str(time.time_ns())).touch()
        end = time.time() + 60
        while len(list(here.iterdir())) < 4:
            if time.time() > end:
                raise TimeoutError
            time.sleep(0.05)
        return answer(messages)

    assert judge.judge_with_log(spark, asked(spark, 8), waits, str(tmp_path / "log"), pause=0, retries=1, tasks=4, chunk=2).count() == 8


def test_plan_is_told_once(spark, tmp_path):
    """Rows are read once for the plan, and the job that asks reads the plan alone."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("judge", "judge")
    judge.judge_with_log(spark, asked(spark, 300), judges.recorded(1), str(tmp_path / "log"), pause=0, chunk=10)
    jobs = len(tracker.getJobIdsForGroup("judge"))
    spark.sparkContext.setJobGroup("more", "more")
    judge.judge_with_log(spark, asked(spark, 30), judges.recorded(1), str(tmp_path / "log2"), pause=0, chunk=10)
    assert len(tracker.getJobIdsForGroup("more")) == jobs  # ten times the stories need no more jobs
    spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize(("payloads", "dims"), [(evaluation.PAYLOADS, STORY_DIMENSIONS), (evaluation.FIVE, DIMENSIONS), (evaluation.ONE, judge.CONSISTENCY)])
def test_accepted_is_what_validates(spark, payloads, dims):
    more = [("brace", "{ then ```json\n" + evaluation._OK + "\n```"), ("twice", evaluation._OK.replace('"robustness": ', '"robustness": 1, "robustness": ')), ("nan", evaluation._OK.replace('"score": 1,', '"score": NaN,'))]
    df = judge.validate(values(spark, "id payload", [*payloads, *more]), "payload", dims)
    accept = judge.acceptable(dims)
    for r in df.select("id", "payload", "error").collect():
        assert accept(r["payload"] or "") == (r["error"] is None), tuple(r)


def test_judgements_are_stored_before_conditions(spark, tmp_path):
    """The plan of judged rows holds no validation, whatever stands on it."""
    df = asked(spark, 5).drop("messages")
    who = judges.recorded(1, (*DIMENSIONS, *judge.CONSISTENCY))
    out = judged.judged_rows(spark, df, who, str(tmp_path / "log"), pause=0, dims=DIMENSIONS)
    assert out.where("coherence_score = 1 AND consistency_score = 1").count() == 5
    assert len(out.where("coherence_score = 1")._jdf.queryExecution().optimizedPlan().toString()) < 20_000


@pytest.mark.parametrize("parts", [True, False])
def test_group_message_passes_in_pieces(spark, tmp_path, parts):
    """No plan, row or aggregate holds a group's texts; what the judge reads is the whole message of the judged rows, in order."""
    told = tmp_path / "told"
    told.mkdir()
    answer = judges.recorded(1, (*STORY_DIMENSIONS, *judge.CONSISTENCY))

    def who(messages):
        content = messages[1]["content"]
        if "Generations for the same prompt" in (first := content if isinstance(content, str) else next(content)):
            (told / str(time.time_ns())).write_text(json.dumps([first] if isinstance(content, str) else [first, *content]))
        return answer(messages)

    who.reads_parts = parts
    df = asked(spark, 12, lambda i: None if i == 3 else str(i % 7)).drop("messages")
    df = df.union(df.withColumn("model", F.lit("tuned")))
    out = judged.judged_rows(spark, df, who, str(tmp_path / "log"), pause=0, limit=9, tasks=2)
    was = out.where("robustness_score IS NOT NULL")
    assert was.count() == out.where("consistency_score IS NOT NULL").count() < df.count() and was.where("generation_id IS NULL").count() > 0
    got = [json.loads(f.read_text()) for f in told.iterdir()]
    want = [r["messages"][1]["content"] for r in judge.consistency_messages(was).collect()]
    assert sorted(map("".join, got)) == sorted(want) and len(want) == 2
    assert sum(map(len, got)) == (was.count() + 4 if parts else 2)
    for log in ("stories", "groups"):
        assert not {"messages", "part", "story"} & set(spark.read.parquet(f"{tmp_path}/log/{log}/plans/*").columns)
