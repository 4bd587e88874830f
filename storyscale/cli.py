"""Command line: evaluate, judge, errors, profile, prompts."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.functions.lexicon import DIMENSIONS, STORY_DIMENSIONS
from storyscale.operators import errors, gates, judge, objective, pairs, profile, prompts, rollup
from storyscale.plans import judged, report
from storyscale.sources import io, judgelog, judges
from storyscale.sources.lexicon import read_lexicon
from storyscale.sources.shared import stored, work_dir

KEYS = ("model", "prompt_id", "generation_id", "seed")


def _scored(spark: SparkSession, a: argparse.Namespace, keep: tuple[str, ...] = ()) -> DataFrame:
    """The scored rows, stored, in one pass over the input, which also tells the first rows whose targets no pattern has."""
    unknown = objective.unknown_targets(F.col("targets"))
    gate = gates.Gate("unknown target_phonics", F.size(unknown) > 0, [*KEYS, unknown.alias("unknown")])
    rows = gate.watch(objective.scored(io.read_outputs(spark, a.outputs), read_lexicon(spark, a.lexicon)))
    rows = stored(rows.drop(*[c for c in ("story", "prompt") if c not in keep]), work_dir(spark, "scored"))
    gate.check()
    return rows


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Row metrics, summaries, pairs and failure slices of generated stories: six files."""
    rows = _scored(spark, a, ("story",))
    if a.matched:
        pairs.require_matched(rows)
    io.export_csv(rows.orderBy("row_ord"), f"{a.to}/objective_rows.csv", [c for c in objective.ROW if c != "row_ord"])
    judged.write_summaries(rows, f"{a.to}/objective_summary.csv", f"{a.to}/objective_by_prompt.csv")
    io.export_csv(rollup.evaluation_summary(rows, with_judge=False), f"{a.to}/evaluation_summary.csv")
    paired = stored(pairs.paired_comparison(rows), work_dir(spark, "pairs"))
    io.export_csv(paired.orderBy(*pairs.KEYS), f"{a.to}/paired_comparison.csv")
    judged.write_slices(rows, f"{a.to}/error_analysis.csv")
    print(report.console(rollup.summarize(rows, "model").orderBy("model"), "Summary by model"))
    print(report.console(rollup.summarize(rows, "model", "prompt_id").orderBy("model", "prompt_id"), "Summary by model and prompt"))
    print(report.console(pairs.means(paired), "Mean differences of pairs"))


def judge_stories(spark: SparkSession, a: argparse.Namespace) -> None:
    """A judged run: objective rows, judge scores of stories and groups (resumable through Parquet logs), summaries, failures."""
    io.load_env(a.env, os.environ)
    dims = DIMENSIONS if a.legacy else STORY_DIMENSIONS
    who = judges.recorded(dims=(*dims, *judge.CONSISTENCY)) if a.provider == "recorded" else judges.resolve(a.provider, a.model)
    rows = _scored(spark, a, ("story", "prompt"))
    how = {"pause": a.pause, "limit": a.limit, "retries": a.max_retries, "tasks": a.tasks}
    if a.legacy:
        out = stored(judged.five_dimensions(spark, rows, who, f"{a.log}/five", **how), work_dir(spark, "judged"))
        out.write.mode("overwrite").parquet(f"{a.to}/scored_rows.parquet")
        io.export_csv(out.orderBy("row_ord"), f"{a.to}/judge_rows.csv", [*KEYS, *[f"{d}_{k}" for d in dims for k in ("score", "justification")], "subjective_total"])
        print(report.interpretation(rollup.interpretation(out), rollup.hardest_prompts(out)))
    else:
        judged.write_run(stored(judged.judged_rows(spark, rows, who, a.log, **how), work_dir(spark, "judged")), a.to)


def error_analysis(spark: SparkSession, a: argparse.Namespace) -> None:
    """The failure report of scored and judged rows in Parquet."""
    io.require_files(spark, a.rows)
    Path(a.to).mkdir(parents=True, exist_ok=True)
    df = io.require_columns(spark.read.parquet(a.rows), ("model", *pairs.KEYS, "decodability_compliance", *errors.SCORES), a.rows)
    Path(a.to, "error_analysis.md").write_text(report.error_report(df), encoding="utf-8")


def profile_stories(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pattern profile and level review of labelled stories; other columns pass through."""
    df = io.read_csv(spark, a.stories, ("story", "menon_hiebert_level"))
    out = profile.select_targets(profile.level_review(profile.story_profile(df)))
    io.export_csv(out.orderBy("row_ord").drop("row_ord", "words", "tally"), f"{a.to}/profiled.csv", bom=True)


def build_prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Generation prompts of evaluation cases."""
    io.export_json(io.read_prompts(spark, a.prompts).withColumn("prompt", prompts.build(F.col("target_phonics"))), f"{a.to}/prompts_ready.json")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="storyscale", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, f, inputs in (
        ("evaluate", evaluate, ["outputs"]),
        ("judge", judge_stories, ["outputs"]),
        ("errors", error_analysis, ["rows"]),
        ("profile", profile_stories, ["stories"]),
        ("prompts", build_prompts, ["prompts"]),
    ):
        c = sub.add_parser(name, help=f.__doc__)
        c.set_defaults(run=f)
        for i in inputs:
            c.add_argument(i)
        c.add_argument("--to", default="results")
        if name == "evaluate":
            c.add_argument("--lexicon", help="pronunciations: lines WORD  P1 P2 ...")
            c.add_argument("--matched", action="store_true", help="fail unless base and tuned have the same keys")
        if name == "judge":
            c.add_argument("--provider", default="recorded")
            c.add_argument("--model")
            c.add_argument("--limit", type=int)
            c.add_argument("--log", default="judge_log")
            c.add_argument("--env", default=".env")
            c.add_argument("--pause", type=float, default=0.2)
            c.add_argument("--max-retries", type=int, default=4, help="requests for one story before the run gives up")
            c.add_argument("--tasks", type=int, default=judgelog.TASKS, help="requests at once")
            c.add_argument("--lexicon")
            c.add_argument("--legacy", action="store_true", help="five dimensions, as the errors command reads them")
    a = p.parse_args(argv)
    try:
        a.run(SparkSession.builder.appName("storyscale").getOrCreate(), a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
