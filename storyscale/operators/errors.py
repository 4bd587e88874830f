"""Failure slices, representative examples, likely causes, difficulty and concentration.

Rankings of whole tables share a scan and keep their first rows in each task (``ranking``); ties go by
the pair's keys or the row's order, so results are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyscale.functions.numeric import exact_mean, exact_round, rounded_means
from storyscale.functions.text import parse_targets
from storyscale.operators.ordered import numbered
from storyscale.operators.pairs import pair_rows
from storyscale.operators.ranking import Ranking, ranked
from storyscale.sources.shared import stored, work_dir
from storyscale.sources.tables import KEYS

HIGH_SLICE = 0.25
HIGH_ABOVE = 0.20
WEAK = 0.85
SCORES = ("decodability_adherence_score", "target_phonics_pattern_emphasis_score", "coherence_score", "narrative_completeness_score", "overall_spec_adherence_score")

#: Failure type of a slice and its condition.
SLICES = (
    ("high_above_level_rate", f"above_level_rate >= {HIGH_SLICE}D"),
    ("missing_title", "title_rate = 0"),
    ("duplicate_sentences", "has_duplicate_sentences = 1"),
    ("incomplete_output", "incomplete_output = 1"),
    ("phonics_leakage", "phonics_leakage = 1"),
    ("low_spec_adherence", "spec_adherence_score = 0"),
    ("low_robustness", "robustness_score = 0"),
    ("low_task_quality", "task_quality_score = 0"),
    ("low_consistency", "consistency_score = 0"),
)


def _labelled(df: DataFrame, name: str, conditions) -> DataFrame:
    """A row for each condition that a row meets: overlapping slices in one pass."""
    labels = F.array_compact(F.array(*[F.when(F.expr(c) if isinstance(c, str) else c, F.lit(n)) for n, c in conditions]))
    return df.withColumn(name, F.explode(labels))


def top(df: DataFrame, part: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each part, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(name) <= k)


def error_slices(df: DataFrame, k: int = 8) -> DataFrame:
    """The worst k tuned rows of each failure type, with how many it has: one scan, one shuffle of a few rows."""
    order = [F.col("spec_adherence_score"), F.col("task_quality_score"), F.col("robustness_score"), -F.col("above_level_rate")]
    slices = [Ranking(n, F.expr(c), order, [], F.col("row_ord"), k) for n, c in SLICES]
    out = ranked(df.where("model = 'tuned'"), slices).withColumnsRenamed({"ranking": "failure_type", "n": "n_tuned_flagged"})
    return out.withColumn("pct_tuned_flagged", exact_round(F.col("n_tuned_flagged") / F.greatest(F.col("of"), F.lit(1)))).drop("of")


def flags(target_phonics: Column) -> dict[str, Column]:
    """What a target cell asks for."""
    t = parse_targets(target_phonics)
    n = F.size(F.array_distinct(t))
    has = lambda name: F.array_contains(t, name)
    return {"vowel_teams": has("vowel teams"), "diphthongs": has("diphthongs"), "r_controlled": has("r-controlled vowels"), "multisyllabic": has("multisyllabic words"), "multi_target": n >= 2, "n_targets": n}


_FIELDS = ["row_ord", "target_phonics", "decodability_compliance", "above_level_rate", "weighted_above_level_rate", "target_satisfaction_rate", "word_count", *SCORES]


def examined_pairs(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """KEYS, base and tuned of the complete pairs, unjudged scores as 0, and compliance_delta."""
    df = df.withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in SCORES})
    pairs = pair_rows(df, [*_FIELDS, *more]).where("base IS NOT NULL AND tuned IS NOT NULL")
    return pairs.withColumn("compliance_delta", exact_round(F.col("tuned.decodability_compliance") - F.col("base.decodability_compliance")))


# fixed values: causes
COVERAGE, CONFLICT, CAPACITY, BEHAVIOR, RULES = "training-data coverage", "conflicting training objectives", "small-model capacity", "generation behavior", "rule-based evaluation limitation"
# fixed values: cause of a mode that no rule explains
DEFAULTS = {"largest_compliance_gain": BEHAVIOR, "least_compliance_gain": CONFLICT, "low_decodability_adherence": COVERAGE, "low_target_phonics_emphasis": COVERAGE, "low_coherence": BEHAVIOR, "incomplete_narrative": BEHAVIOR, "high_above_level": BEHAVIOR, "prompt_difficulty": COVERAGE}


def likely_cause(mode: Column) -> Column:
    """The likely cause of a pair's failure mode: the first rule that fits, else the mode's default."""
    t, b = (lambda c: F.col(f"tuned.{c}")), (lambda c: F.col(f"base.{c}"))
    f = flags(t("target_phonics"))
    complete, cohere, emphasis, decod = t("narrative_completeness_score"), t("coherence_score"), t("target_phonics_pattern_emphasis_score"), t("decodability_adherence_score")
    compliance, above, words, satisfied = t("decodability_compliance"), t("above_level_rate"), t("word_count"), t("target_satisfaction_rate")
    hard = (f["vowel_teams"] | f["diphthongs"] | f["r_controlled"] | f["multisyllabic"]) & ((emphasis == 0) | (satisfied < 0.5)) & (words >= 40)
    high = (mode == "high_above_level") | ((above >= HIGH_ABOVE) & (cohere >= 1))
    default = F.lit(BEHAVIOR)
    for m, cause in DEFAULTS.items():
        default = F.when(mode == m, cause).otherwise(default)
    return (
        F.when(mode.isin("least_compliance_gain", "prompt_difficulty") & (compliance >= 0.99) & (b("decodability_compliance") >= 0.99), RULES)
        .when((mode == "low_decodability_adherence") & (compliance >= 0.9) & (decod == 0), RULES)
        .when((mode == "high_above_level") & (decod >= 2) & (above >= HIGH_ABOVE), RULES)
        .when((mode.isin("low_coherence", "incomplete_narrative") | (complete == 0) | (cohere == 0)) & ((words <= 40) | (complete == 0)), BEHAVIOR)
        .when((compliance > b("decodability_compliance") + 0.05) & (satisfied + 0.2 < b("target_satisfaction_rate")) & (emphasis == 0), CONFLICT)
        .when(hard & f["multi_target"] & (f["n_targets"] >= 3), CAPACITY)
        .when(hard, COVERAGE)
        .when(high & (t("weighted_above_level_rate") >= 0.5), COVERAGE)
        .when(high, BEHAVIOR)
        .when((mode == "low_target_phonics_emphasis") & (cohere >= 1) & (words >= 40), COVERAGE)
        .otherwise(default)
    )


def ceiling_note(delta: Column, tuned: Column) -> Column:
    """What a small gain means."""
    more = F.when((delta == 0) & (tuned >= 0.99), " Ceiling effect: both models already near-perfect on this metric.").when(tuned < WEAK, " Tuned absolute compliance remains relatively weak.").otherwise("")
    return F.concat(F.lit("Smallest paired compliance_delta."), more)


#: Mode, severity column, note.
MODES = (
    ("low_decodability_adherence", "decodability_adherence_score", "Tuned subjective decodability_adherence_score == 0."),
    ("low_target_phonics_emphasis", "target_phonics_pattern_emphasis_score", "Tuned target_phonics_pattern_emphasis_score == 0."),
    ("low_coherence", "coherence_score", "Tuned coherence_score == 0."),
    ("incomplete_narrative", "narrative_completeness_score", "Tuned narrative_completeness_score == 0."),
    ("high_above_level", "above_level_rate", "Tuned above_level_rate >= 0.20."),
)


GAINS = ("largest_compliance_gain", "least_compliance_gain")


def _rankings(gains: int, more: int) -> list[Ranking]:
    """Gains by their difference and keys; of each failure mode its worst pair, and the first ``more`` by a shorter order."""
    t = lambda c: F.col(f"tuned.{c}")
    delta, keys, row = F.col("compliance_delta"), list(map(F.col, KEYS)), t("row_ord")
    out = [Ranking(c, F.lit(True), [sign * delta], keys, row, gains) for c, sign in zip(GAINS, (-1, 1)) if gains]
    for m, c, _ in MODES:
        above = c == "above_level_rate"
        severity = [-t(c) if above else t(c), t("overall_spec_adherence_score")]
        when = t(c) >= HIGH_ABOVE if above else t(c) <= 0
        if more:
            out.append(Ranking(m, when, [*severity, F.lit(0.0) if above else -t("above_level_rate")], [], row, 1))
            out.append(Ranking(f"{m}+", when, severity, [], row, more + 1))
    return out


def pair_examples(pairs: DataFrame, gains: int = 5, more: int = 4) -> DataFrame:
    """KEYS, category, rank, notes, compliance_delta, base, tuned, n and of: the largest and smallest gains, each failure mode's worst pair and, ranked from 2, up to ``more`` others.

    All rankings share one scan of the pairs.
    """
    out = ranked(pairs, _rankings(gains, more))
    extra = F.endswith("ranking", F.lit("+"))
    out = out.withColumns({"category": F.rtrim("ranking", F.lit("+")), "extra": extra})
    of_mode = Window.partitionBy("category")  # a few rows each
    out = out.withColumn("rep", F.max(F.when(~F.col("extra") & ~F.col("category").isin(*GAINS), F.col("tuned.row_ord"))).over(of_mode))
    out = out.where(~F.col("extra") | (F.col("tuned.row_ord") != F.col("rep")))
    out = out.withColumn("rank", F.when(F.col("extra"), F.row_number().over(Window.partitionBy("category", "extra").orderBy("rank")) + 1).otherwise(F.col("rank")))
    note = F.lit("Largest paired gain in objective decodability_compliance.")
    note = F.when(F.col("category") == GAINS[1], ceiling_note(F.col("compliance_delta"), F.col("tuned.decodability_compliance"))).otherwise(note)
    for m, _, n in MODES:
        told = F.when(F.col("extra"), F.lit(f"{n} additional flagged example.")).otherwise(F.format_string(f"{n.replace('%', '%%')} n_tuned_flagged=%d/%d.", "n", "of"))
        note = F.when(F.col("category") == m, told).otherwise(note)
    return out.where(~F.col("extra") | (F.col("rank") <= more + 1)).withColumn("notes", note).select(*KEYS, "category", "rank", "notes", "compliance_delta", "base", "tuned", "n", "of")


def largest_gains(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pair_examples(pairs, k, 0).where(F.col("category") == GAINS[0])


def least_gains(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pair_examples(pairs, k, 0).where(F.col("category") == GAINS[1])


def least_gain_representative(pairs: DataFrame) -> DataFrame:
    """The first least gain without ceiling effect, else the first."""
    return least_gains(pairs).orderBy(F.contains("notes", F.lit("Ceiling effect")), "rank").limit(1)


def representatives(pairs: DataFrame) -> DataFrame:
    """The worst pair of each mode, with the mode's count among all."""
    return pair_examples(pairs, 0, 1).where("rank = 1")


def extras(pairs: DataFrame, k: int = 4) -> DataFrame:
    """Up to k more pairs of each mode, ranked from 2."""
    return pair_examples(pairs, 0, k).where("rank > 1")


def prompt_stats(df: DataFrame) -> DataFrame:
    """Figures of the tuned rows of each prompt, the base mean beside them, and the prompt's difficulty rank."""
    df = df.withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in SCORES})
    tuned = F.col("model") == "tuned"
    of = lambda c: F.when(tuned, F.col(c))
    means = {
        "tuned_compliance": of("decodability_compliance"),
        "base_compliance": F.when(F.col("model") == "base", F.col("decodability_compliance")),
        "above": of("above_level_rate"),
        "satisfaction": of("target_satisfaction_rate"),
    }
    stats = rounded_means(
        df.groupBy("prompt_id"),
        means,
        F.min_by(of("target_phonics"), F.when(tuned, F.col("row_ord"))).alias("target_phonics"),
        F.count_if(tuned).alias("n"),
        *[exact_mean(of(s)).alias(s.removesuffix("_score")) for s in SCORES],
        *[F.count_if(tuned & (F.col(s) <= 0)).alias(f"n_low_{s.removesuffix('_score')}") for s in SCORES[:4]],
        F.count_if(tuned & (F.col("above_level_rate") >= HIGH_ABOVE)).alias("n_high_above"),
    ).where("n > 0")
    order = ["overall_spec_adherence", "target_phonics_pattern_emphasis", "satisfaction", "decodability_adherence", F.desc("above"), "prompt_id"]
    return numbered(stats, order, "rank").withColumn("rank", F.col("rank").cast("int"))


def hardest_examples(df: DataFrame, pairs: DataFrame, k: int = 5, stats: DataFrame | None = None) -> DataFrame:
    """The worst pair of each of the k hardest prompts (of ``prompt_stats``, if they are at hand)."""
    hard = (prompt_stats(df) if stats is None else stats).where(F.col("rank") <= k).select("prompt_id", "rank", "overall_spec_adherence", "target_phonics_pattern_emphasis", "satisfaction")
    t = lambda c: F.col(f"tuned.{c}")
    order = [t("overall_spec_adherence_score"), t("target_phonics_pattern_emphasis_score"), t("decodability_adherence_score"), F.desc("tuned.above_level_rate"), t("row_ord")]
    worst = top(pairs.join(F.broadcast(hard), "prompt_id"), ["prompt_id"], order, 1, "__first").drop("__first")  # hard: k rows
    notes = F.format_string("Prompt-level difficulty rank #%d. tuned_overall=%.2f, emphasis=%.2f, tgt_sat=%.2f.", "rank", exact_round(F.col("overall_spec_adherence"), 2), exact_round(F.col("target_phonics_pattern_emphasis"), 2), exact_round(F.col("satisfaction"), 2))
    return worst.withColumn("category", F.lit("prompt_difficulty")).withColumn("notes", notes)


def all_examples(df: DataFrame) -> DataFrame:
    """Gains, failures and the hardest prompts' worst pairs under each other, with their likely cause.

    The pairs are made once and stored without texts; two scans of them serve all rankings.
    """
    pairs = stored(examined_pairs(df), work_dir(df.sparkSession, "pairs"))
    cols = [*KEYS, "category", "rank", "notes", "compliance_delta", "base", "tuned"]
    out = pair_examples(pairs).select(cols).unionByName(hardest_examples(df, pairs).select(cols))
    return out.withColumn("likely_cause", likely_cause(F.col("category")))


def cause_tally(examples: DataFrame) -> DataFrame:
    """How often each cause explains a first-ranked example; gains are no failure."""
    return examples.where("rank = 1 AND category <> 'largest_compliance_gain'").groupBy("likely_cause").agg(F.count(F.lit(1)).alias("n"))


CONDITIONS = ("vowel teams prompts", "diphthongs prompts", "r-controlled vowels prompts", "multisyllabic words prompts", "multi-target prompts (>=2)", "single-target prompts", "all tuned outputs")


def concentration(df: DataFrame) -> DataFrame:
    """Means and shares of the tuned rows under each of seven overlapping conditions."""
    tuned = df.where("model = 'tuned'").withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in SCORES})
    f = flags(F.col("target_phonics"))
    tests = [f["vowel_teams"], f["diphthongs"], f["r_controlled"], f["multisyllabic"], f["multi_target"], ~f["multi_target"], F.lit(True)]
    low = lambda c: (F.col(c) <= 0).cast("int")
    means = {
        "mean_decodability_compliance": F.col("decodability_compliance"),
        "mean_above_level_rate": F.col("above_level_rate"),
        "mean_target_satisfaction": F.col("target_satisfaction_rate"),
        "mean_decodability_adherence": F.col("decodability_adherence_score"),
        "mean_target_phonics_pattern_emphasis": F.col("target_phonics_pattern_emphasis_score"),
        "mean_overall_spec_adherence": F.col("overall_spec_adherence_score"),
        "pct_low_emphasis": low("target_phonics_pattern_emphasis_score"),
        "pct_low_decod_subj": low("decodability_adherence_score"),
        "pct_incomplete": low("narrative_completeness_score"),
    }
    out = rounded_means(_labelled(tuned, "condition", list(zip(CONDITIONS, tests))).groupBy("condition"), means, F.count(F.lit(1)).alias("n_outputs"))
    total = tuned.agg(F.count(F.lit(1)).alias("__n"))
    out = out.join(F.broadcast(total)).withColumn("share_of_tuned", exact_round(F.col("n_outputs") / F.col("__n"))).drop("__n")  # total is one row
    listed = df.sparkSession.createDataFrame([(c,) for c in CONDITIONS], "condition string")
    return listed.join(out, "condition", "left").fillna(0, ["n_outputs"]).fillna(0.0, ["share_of_tuned"])


def verdicts(table: DataFrame) -> DataFrame:
    """Whether a condition looks harder than all tuned rows, by a margin of 0.05 in one of three figures."""
    overall = table.where(F.col("condition") == CONDITIONS[-1]).select(F.col("pct_low_emphasis").alias("e"), F.col("pct_low_decod_subj").alias("d"), F.col("mean_overall_spec_adherence").alias("o"))
    out = table.where((F.col("n_outputs") > 0) & (F.col("condition") != CONDITIONS[-1])).join(F.broadcast(overall))  # overall is one row
    out = out.withColumns({
        "worse_emphasis": F.col("pct_low_emphasis") > F.col("e") + F.lit(0.05),
        "worse_decodability": F.col("pct_low_decod_subj") > F.col("d") + F.lit(0.05),
        "worse_overall": F.col("mean_overall_spec_adherence") + F.lit(0.05) < F.col("o"),
    })
    return out.select("condition", "worse_emphasis", "worse_decodability", "worse_overall", (F.col("worse_emphasis") | F.col("worse_decodability") | F.col("worse_overall")).alias("harder"))
