"""The judged evaluation end to end: row metrics, story and consistency judgements, summaries, failures, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.functions.lexicon import DIMENSIONS, METRICS, SECONDARY, STORY_DIMENSIONS
from storyscale.operators import errors, judge, objective, rollup
from storyscale.sources import io, judgelog
from storyscale.sources.shared import stored, work_dir

#: A story's judgement is known by these; seeds repeat with generations.
STORY_KEYS = ("model", "prompt_id", "generation_id")
GROUP_KEYS = ("model", "prompt_id")
#: What a story of the five dimensions is known by.
FIVE_KEYS = (*STORY_KEYS, "seed")
_SLICES = (
    "failure_type", "rank", "n_tuned_flagged", "pct_tuned_flagged", "model", "prompt_id", "generation_id", "seed", "target_phonics", "above_level_rate", "title_present", "sentence_count", "incomplete_output",
    "spec_adherence_score", "robustness_score", "task_quality_score", "consistency_score", "story", "spec_adherence_justification", "robustness_justification", "task_quality_justification", "consistency_justification",
)
_SCORES = [f"{d}_{k}" for k in ("score", "justification") for d in (*STORY_DIMENSIONS, *judge.CONSISTENCY)]


def _judgements(spark: SparkSession, replies: DataFrame, keys: tuple[str, ...], dims: tuple[str, ...], raw: str) -> DataFrame:
    """keys with scores, justifications and the JSON of the accepted responses, stored: later conditions on them then copy no validation."""
    made = stored(judge.validate(replies, "response", dims), work_dir(spark, "judgements")).where("error IS NULL")
    return made.select(*keys, *[f"{d}_{k}" for d in dims for k in ("score", "justification")], F.col("raw_json").alias(raw))


def _put_back(rows: DataFrame, told: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with what is told of their keys; a null in a key is a value like others.

    Judgements of stories grow with the rows but their files are small, so they need a hint to be merged, never broadcast.
    """
    own = [c for c in told.columns if c not in keys]
    told = told.select(*[F.col(k).alias(f"__{k}") for k in keys], *own)
    same = [F.col(k).cast("string").eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(told, same, "left").select(*rows.columns, *own)


def judged_rows(spark: SparkSession, rows: DataFrame, who: judge.Judge, log: str, pause: float = 0.2, limit: int | None = None, dims: tuple[str, ...] = STORY_DIMENSIONS, **how) -> DataFrame:
    """Scored rows with story scores and, on judged rows, the consistency score of their group; nulls where a row isn't judged.

    The logs, one of stories and one of groups, make the run resumable; ``limit`` bounds the stories
    that are asked about in this run. Groups judged once keep their score.
    """
    told = _stories(spark, rows, who, f"{log}/stories", STORY_KEYS, dims, pause=pause, limit=limit, **how)
    out = _put_back(rows, told.hint("merge"), STORY_KEYS)
    replies = judge.consistency_with_log(spark, rows, told, who, f"{log}/groups", judge.acceptable(judge.CONSISTENCY), pause=pause, **({"chunk": 1} | how))
    groups = _judgements(spark, replies, GROUP_KEYS, judge.CONSISTENCY, "raw_consistency_judge_json")
    was = F.col(f"{dims[0]}_score").isNotNull()
    own = [c for c in groups.columns if c not in GROUP_KEYS]
    return _put_back(out, groups, GROUP_KEYS).withColumns({c: F.when(was, F.col(c)) for c in own})


def _stories(spark: SparkSession, rows: DataFrame, who: judge.Judge, log: str, keys: tuple[str, ...], dims: tuple[str, ...], **how) -> DataFrame:
    """The judgements of stories, by ``keys``."""
    asked = rows.withColumn("messages", judge.story_messages(F.col("target_phonics"), F.col("prompt"), F.col("story"), dims))
    return _judgements(spark, judge.judge_with_log(spark, asked, who, log, keys, judge.acceptable(dims), **how), keys, dims, "raw_story_judge_json")


def judged_stories(spark: SparkSession, rows: DataFrame, who: judge.Judge, log: str, keys: tuple[str, ...], dims: tuple[str, ...], **how) -> DataFrame:
    """Rows with the scores of their stories, judged by ``keys``."""
    return _put_back(rows, _stories(spark, rows, who, log, keys, dims, **how).hint("merge"), keys)


def five_dimensions(spark: SparkSession, rows: DataFrame, who: judge.Judge, log: str, limit: int | None = None, **how) -> DataFrame:
    """Rows with the five scores of the earlier judge and their total, judged by model, prompt, generation and seed.

    ``limit`` bounds all judged stories, those of earlier runs included; waits double after each failure.
    """
    if limit is not None:
        limit = max(limit - judgelog.replies(spark, log, FIVE_KEYS).count(), 0)
    out = judged_stories(spark, rows, who, log, FIVE_KEYS, DIMENSIONS, limit=limit, **({"wait": judge.doubling} | how))
    return out.withColumn("subjective_total", judge.subjective_total(DIMENSIONS))


def write_summaries(rows: DataFrame, models: str, prompts: str) -> None:
    """The objective summaries by model and by prompt, of one pass over the rows."""
    both = stored(rollup.objective_summaries(rows), work_dir(rows.sparkSession, "summaries"))
    titles = [t for t in (METRICS | SECONDARY).values()]
    io.export_csv(rollup.by_model(both).orderBy("model"), models, ["model", "n", *titles])
    io.export_csv(rollup.by_prompt(both).orderBy("model", "prompt_id"), prompts, ["model", "prompt_id", "target_phonics", "n", *titles])


def write_slices(rows: DataFrame, path: str) -> None:
    """The worst rows of each failure type; what isn't judged fails by its own metrics alone."""
    rows = rows.withColumns({c: F.lit(None).cast("string" if c.endswith("justification") else "int") for c in _SCORES if c not in rows.columns})
    io.export_csv(errors.error_slices(rows).orderBy("failure_type", "rank"), path, list(_SLICES))


def write_run(rows: DataFrame, to: str) -> None:
    """The ten files of a judged run, and the rows as Parquet for the failure report."""
    was = F.col("spec_adherence_score").isNotNull()
    done = rows.where(was)
    keys = [*STORY_KEYS, "seed", "target_phonics"]
    whole = [*[c for c in objective.ROW if c != "row_ord"], *_SCORES, "raw_story_judge_json", "raw_consistency_judge_json", "prompt", "story"]
    rows.write.mode("overwrite").parquet(f"{to}/scored_rows.parquet")
    ordered = rows.orderBy("row_ord")
    io.export_csv(ordered, f"{to}/scored_outputs.csv", whole)
    io.export_csv(rollup.evaluation_summary(done), f"{to}/evaluation_summary.csv", ["metric", "metric_key", "metric_family", "base_mean", "tuned_mean", "tuned_minus_base", "n_base", "n_tuned", "note"])
    write_summaries(rows, f"{to}/objective/objective_eval_summary.csv", f"{to}/objective/objective_eval_by_prompt.csv")
    io.export_csv(ordered, f"{to}/objective/objective_eval_results.csv", [c for c in objective.ROW if c != "row_ord"])
    io.export_csv(rollup.subjective_summary(done, "model").orderBy("model"), f"{to}/subjective/llm_judge_summary.csv")
    io.export_csv(rollup.subjective_summary(done, "model", "prompt_id").orderBy("model", "prompt_id"), f"{to}/subjective/llm_judge_by_prompt.csv")
    io.export_csv(done.orderBy("row_ord"), f"{to}/subjective/llm_judge_results.csv", [*keys, *_SCORES, "raw_story_judge_json", "raw_consistency_judge_json"])
    io.export_csv(ordered, f"{to}/subjective/final_evaluation.csv", whole)
    write_slices(done, f"{to}/error_analysis.csv")
