"""Grouped summaries of row metrics, with means over rounded rows rounded again, and the long comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.functions.lexicon import DIMENSIONS, JUDGE_METRICS, METRICS, SECONDARY, SECONDARY_NOTE
from storyscale.functions.numeric import exact_round, rounded_means

#: Summary column, row metric, decimals.
SHORT = (
    ("mean_decodability_compliance", "decodability_compliance", 4),
    ("mean_distinct_decodability_compliance", "distinct_decodability_compliance", 4),
    ("mean_weighted_above_level_rate", "weighted_above_level_rate", 4),
    ("mean_above_level_distance", "mean_above_level_distance", 4),
    ("mean_above_level_rate", "above_level_rate", 4),
    ("mean_target_satisfaction_rate", "target_satisfaction_rate", 4),
    ("phonics_leakage_rate", "phonics_leakage_rate", 4),
    ("title_rate", "title_rate", 4),
    ("mean_word_count", "word_count", 2),
)


def summarize(df: DataFrame, *keys: str) -> DataFrame:
    """n and the short means of each group; with a prompt key the targets of its first row."""
    first = [F.min_by("target_phonics", "row_ord").alias("target_phonics")] if "prompt_id" in keys else []
    return rounded_means(df.groupBy(*keys), {name: (F.col(c), d) for name, c, d in SHORT}, *first, F.count(F.lit(1)).alias("n"))


def titled(df: DataFrame, metrics: dict[str, str], *keys: str, targets: bool = False) -> DataFrame:
    """n and the means of each group under their titles."""
    first = [F.min_by("target_phonics", "row_ord").alias("target_phonics")] if targets else []
    return rounded_means(df.groupBy(*keys), {t: F.col(k) for k, t in metrics.items()}, *first, F.count(F.lit(1)).alias("n"))


def objective_summary(df: DataFrame, *keys: str) -> DataFrame:
    return titled(df, METRICS | SECONDARY, *keys, targets="prompt_id" in keys)


def objective_summaries(df: DataFrame) -> DataFrame:
    """Titled means of each model and of each model's prompts in one pass: prompt_id and target_phonics are null in a model's own row, which ``of_model`` tells."""
    groups = df.groupingSets([["model"], ["model", "prompt_id"]], "model", "prompt_id")
    of_model = F.grouping("prompt_id") == 1
    out = rounded_means(groups, {t: F.col(k) for k, t in (METRICS | SECONDARY).items()}, of_model.alias("of_model"), F.min_by("target_phonics", "row_ord").alias("target_phonics"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("target_phonics", F.when(~F.col("of_model"), F.col("target_phonics")))


def by_model(summaries: DataFrame) -> DataFrame:
    """The models' rows of ``objective_summaries``."""
    return summaries.where("of_model").drop("of_model", "prompt_id", "target_phonics")


def by_prompt(summaries: DataFrame) -> DataFrame:
    """The prompts' rows of ``objective_summaries``."""
    return summaries.where("NOT of_model").drop("of_model")


def subjective_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Of judged rows alone."""
    return titled(df.where(F.col("spec_adherence_score").isNotNull()), JUDGE_METRICS, *keys)


def dimension_means(df: DataFrame, dims: tuple[str, ...], *keys: str) -> DataFrame:
    """n and the mean score of each dimension, by any keys."""
    return rounded_means(df.groupBy(*keys), {f"mean_{d}": F.col(f"{d}_score") for d in dims}, F.count(F.lit(1)).alias("n"))


def evaluation_summary(df: DataFrame, with_judge: bool = True) -> DataFrame:
    """A row for each metric: means of base and tuned, their difference, row counts.

    Both models are aggregated in one pass; the single wide row is then turned to long form.
    """
    families = [(k, t, "objective", "") for k, t in METRICS.items()]
    if with_judge:
        families += [(k, t, "objective_secondary", SECONDARY_NOTE) for k, t in SECONDARY.items()] + [(k, t, "judge", "") for k, t in JUDGE_METRICS.items()]
    of = {m: F.col("model") == m for m in ("base", "tuned")}
    value = lambda k, f: F.coalesce(F.col(k), F.lit(0)) if f == "judge" else F.col(k)
    means = {f"{k}.{m}": F.when(when, value(k, f)) for k, _, f, _ in families for m, when in of.items()}
    wide = rounded_means(df, means, *[F.count_if(when).alias(f"n_{m}") for m, when in of.items()])
    rows = F.array(*[F.struct(F.lit(t).alias("metric"), F.lit(k).alias("metric_key"), F.lit(f).alias("metric_family"), F.col(f"`{k}.base`").alias("base_mean"), F.col(f"`{k}.tuned`").alias("tuned_mean"), F.lit(note).alias("note")) for k, t, f, note in families])
    long = wide.select("n_base", "n_tuned", F.inline(rows))
    return long.withColumn("tuned_minus_base", F.when((F.col("n_base") > 0) & (F.col("n_tuned") > 0), exact_round(F.col("tuned_mean") - F.col("base_mean"))))


#: Metric, its row column, whether more is better (1) or worse (-1), and the least difference that counts.
FLAGS = (
    ("mean_decodability_compliance", "decodability_compliance", 1, 0.01),
    ("mean_weighted_above_level_rate", "weighted_above_level_rate", -1, 0.01),
    ("mean_target_satisfaction_rate", "target_satisfaction_rate", 1, 0.01),
    ("phonics_leakage_rate", "phonics_leakage_rate", -1, 0.01),
    *[(f"mean_{d}", f"{d}_score", 1, 0.05) for d in DIMENSIONS],
)


def interpretation(df: DataFrame) -> DataFrame:
    """metric, family, the means b and t of base and tuned (judge scores: of judged rows), their verdict and row counts, in one pass."""
    was = F.col(f"{DIMENSIONS[0]}_score").isNotNull()
    of = {(n, m): (F.col("model") == m) & (was if margin == 0.05 else F.lit(True)) for n, _, _, margin in FLAGS for m in ("base", "tuned")}
    means = {f"{n}.{m}": F.when(of[n, m], F.col(c)) for n, c, _, _ in FLAGS for m in ("base", "tuned")}
    counts = [F.count_if(when).alias(f"{n}.n_{m}") for (n, m), when in of.items()]
    cell = lambda n, k: F.col(f"`{n}.{k}`")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("judge" if margin == 0.05 else "objective").alias("family"), cell(n, "base").alias("b"), cell(n, "tuned").alias("t"), F.lit(s).alias("s"), F.lit(margin).alias("m"), cell(n, "n_base").alias("n_base"), cell(n, "n_tuned").alias("n_tuned")) for n, _, s, margin in FLAGS])
    gain = F.col("s") * (F.col("t") - F.col("b"))
    verdict = F.when(gain > F.col("m"), "improved").when(gain < -F.col("m"), "regressed").otherwise("unchanged")
    return rounded_means(df, means, *counts).select(F.inline(rows)).select("metric", "family", "b", "t", verdict.alias("verdict"), "n_base", "n_tuned")


HARDEST = ("overall_spec_adherence", "decodability_adherence", "target_phonics_pattern_emphasis", "narrative_completeness")


def hardest_prompts(df: DataFrame, k: int = 3) -> DataFrame:
    """The k prompts that the judge finds hardest for the tuned model."""
    done = df.where((F.col("model") == "tuned") & F.col(f"{HARDEST[0]}_score").isNotNull())
    return dimension_means(done, HARDEST, "prompt_id").drop("n").orderBy(*[f"mean_{d}" for d in HARDEST], "prompt_id").limit(k)
