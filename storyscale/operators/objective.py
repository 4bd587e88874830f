"""Row metrics of a story: level metrics, target coverage, title, leakage, sentences, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyscale.functions import text
from storyscale.functions.lexicon import DISPLAY, PASS_WORDS, STAGES
from storyscale.functions.numeric import exact_round
from storyscale.operators.profile import distinct_with, tallied, with_lexicon, with_words

INTERNAL = {d: p for p, d in DISPLAY.items()}


def stage_of_target(t: Column) -> Column:
    """Stage of a display name; null of an unknown one."""
    return F.get(F.filter(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(STAGES[p]).alias("s")) for p, d in DISPLAY.items()]), lambda x: x["d"] == t), F.lit(0))["s"]


def ceiling(targets: Column) -> Column:
    """Highest stage among the targets; 0 of none."""
    return F.coalesce(F.array_max(F.transform(targets, stage_of_target)), F.lit(0))


def ceiling_label(targets: Column, ceiling_stage: Column) -> Column:
    """The first display name of that stage among the targets."""
    out = F.lit("")
    for p, d in reversed(DISPLAY.items()):
        out = F.when((ceiling_stage == STAGES[p]) & F.array_contains(targets, d), d).otherwise(out)
    return out


def unknown_targets(targets: Column) -> Column:
    """Targets that no pattern has, in order."""
    return F.filter(targets, lambda t: ~t.isin(list(INTERNAL)))


def with_levels(df: DataFrame) -> DataFrame:
    """``df`` (with words and permitted_ceiling_stage) with the level metrics.

    A word stands above the ceiling by its highest stage alone; without a ceiling none does.
    """
    top = F.col("permitted_ceiling_stage")
    above = lambda t: (top > 0) & (t["stage"] > top)
    df = df.withColumns({
        "above_level_words": F.array_join(F.transform(F.filter("words", above), lambda w: w["word"]), ", "),
        "above_level_word_occurrences": tallied("freq", above),
        "above_level_distinct_words": tallied("words", above),
        "max_above_level_distance": F.aggregate("tally", F.lit(0), lambda a, t: F.when(above(t), F.greatest(a, t["stage"] - top)).otherwise(a)),
        "__distance": tallied("freq", above, lambda t, n: (t["stage"] - top) * n),
    })
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    above, distinct = ratio("above_level_word_occurrences", "word_count"), ratio("above_level_distinct_words", "unique_word_count")
    below = F.when(F.col("word_count") == 0, 0.0).otherwise(F.try_divide((F.col("word_count") - F.col("above_level_word_occurrences")).cast("double"), F.col("word_count").cast("double")))
    return df.withColumns({
        "above_level_rate": exact_round(above),
        "distinct_above_level_rate": exact_round(distinct),
        "decodability_compliance": exact_round(1.0 - above),
        "distinct_decodability_compliance": exact_round(1.0 - distinct),
        "on_or_below_level_rate": exact_round(below),
        "mean_above_level_distance": exact_round(ratio("__distance", "above_level_word_occurrences")),
        "weighted_above_level_rate": exact_round(ratio("__distance", "word_count")),
    }).drop("__distance")


def with_targets(df: DataFrame) -> DataFrame:
    """``df`` (with words) with parsed targets, ceiling, distinct counts, passes and coverage."""
    df = df.withColumn("targets", text.parse_targets(F.col("target_phonics")))
    df = df.withColumns({f"{p}_distinct_count": distinct_with(p) for p in DISPLAY} | {"permitted_ceiling_stage": ceiling(F.col("targets"))})
    count = F.create_map(*[x for p, d in DISPLAY.items() for x in (F.lit(d), F.col(f"{p}_distinct_count"))])
    df = df.withColumn("__counts", F.transform("targets", lambda t: F.coalesce(F.element_at(count, t), F.lit(0))))
    credit = lambda n: F.least(n / float(PASS_WORDS), F.lit(1.0))
    total = F.aggregate("__counts", F.lit(0.0), lambda a, n: a + credit(n))
    pick = lambda ok: F.array_join(F.filter("targets", lambda t, i: (F.get(F.col("__counts"), i) >= PASS_WORDS) == F.lit(ok)), ", ")
    return df.withColumns({
        "permitted_ceiling_label": ceiling_label(F.col("targets"), F.col("permitted_ceiling_stage")),
        "targets_requested": F.size("targets"),
        "targets_passed": F.size(F.filter("__counts", lambda n: n >= PASS_WORDS)),
        "targets_passed_list": pick(True),
        "targets_failed_list": pick(False),
        "target_satisfaction_rate": exact_round(F.when(F.size("targets") > 0, total / F.size("targets")).otherwise(0.0)),
    }).drop("__counts")


def target_details(df: DataFrame) -> DataFrame:
    """A row for each requested target of a story (with words): distinct words, credit and whether it passes; null of an unknown name."""
    count = F.create_map(*[x for p, d in DISPLAY.items() for x in (F.lit(d), distinct_with(p))])
    df = df.withColumn("__count", count).withColumn("target", F.explode(F.array_distinct(text.parse_targets(F.col("target_phonics")))))
    n = F.element_at("__count", F.col("target"))
    return df.withColumns({"target_distinct": n, "target_credit": exact_round(F.least(n / float(PASS_WORDS), F.lit(1.0))), "target_pass": (n >= PASS_WORDS).cast("int")}).drop("__count")


#: Columns of ``wide_targets``.
WIDE = [f"{p}_target_{k}" for p in DISPLAY for k in ("distinct", "credit", "pass")]


def wide_targets(df: DataFrame) -> DataFrame:
    """``df`` (with words) with WIDE: distinct words, credit and pass of each pattern that the story requests, null of others.

    What ``target_details`` tells in rows; row by row, so without a pivot's shuffle.
    """
    df = df.withColumn("__targets", text.parse_targets(F.col("target_phonics"))).withColumns({f"{p}_target_distinct": F.when(F.array_contains("__targets", d), distinct_with(p)) for p, d in DISPLAY.items()})
    n = {p: F.col(f"{p}_target_distinct") for p in DISPLAY}
    made = {f"{p}_target_credit": exact_round(F.when(n[p].isNotNull(), F.least(n[p] / float(PASS_WORDS), F.lit(1.0)))) for p in DISPLAY} | {f"{p}_target_pass": (n[p] >= PASS_WORDS).cast("int") for p in DISPLAY}
    return df.withColumns(made).drop("__targets")


PARTS = ("__lines", "__raw", "__low", "__title", "__body", "__end", "__sentences", "__norms")


def with_text_parts(df: DataFrame, story: str = "story") -> DataFrame:
    """``df`` with PARTS of the story. Later columns read them several times, so each is computed once, by itself."""
    s = F.coalesce(F.col(story), F.lit(""))
    df = df.withColumns({"__lines": text.first_lines(s), "__raw": text.strip(s), "__low": F.lower(s)}).withColumn("__title", text.title(F.col("__lines")))
    df = df.withColumn("__body", text.body(s, F.col("__title"))).withColumn("__end", text.ending(s, F.col("__body")))
    return df.withColumn("__sentences", text.sentences(F.col("__body"))).withColumn("__norms", text.normalized_sentences(F.col("__sentences")))


def with_text_checks(df: DataFrame, story: str = "story") -> DataFrame:
    """``df`` with title, leakage, sentence and completeness checks."""
    df = with_text_parts(df, story)
    df = df.withColumns({
        "title_rate": F.col("__title").isNotNull().cast("int"),
        "detected_title": F.coalesce("__title", F.lit("")),
        "phonics_leakage_terms": text.leakage_terms(F.col("__low")),
        "sentence_count": F.size("__sentences"),
        "__repeated": text.repeated(F.col("__norms")),
        "incomplete_reasons": text.incomplete_reasons(F.col("__raw"), F.col("__body"), F.col("__end"), F.col("__sentences")),
    })
    return df.withColumns({
        "phonics_leakage_rate": (F.col("phonics_leakage_terms") != "").cast("int"),
        "has_duplicate_sentences": (F.size("__repeated") > 0).cast("int"),
        "duplicate_sentence_norms": F.array_join(F.slice("__repeated", 1, 5), " | "),
        "incomplete_output": (F.col("incomplete_reasons") != "").cast("int"),
    }).drop(*PARTS, "__repeated")


ROW = (
    "row_ord", "model", "prompt_id", "generation_id", "seed", "target_phonics", "decodability_compliance", "distinct_decodability_compliance", "weighted_above_level_rate",
    "mean_above_level_distance", "target_phonics_coverage", "phonics_leakage_rate", "title_rate", "word_count", "above_level_rate", "off_target_phonics_rate", "on_level_rate",
    "title_present", "no_phonics_leakage", "phonics_leakage", "sentence_count", "no_duplicate_sentences", "has_duplicate_sentences", "complete_output", "incomplete_output",
    "detected_title", "duplicate_sentence_norms", "incomplete_reasons", "phonics_leakage_terms", "above_level_words", "permitted_ceiling_stage",
)


def scored(df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """All row metrics beside the input columns; without a lexicon each row stands alone, so this works on streams too."""
    df = with_words(df)
    if lexicon is not None:
        df = with_lexicon(df, lexicon)
    df = with_text_checks(with_levels(with_targets(df))).drop("words", "tally")
    return df.withColumns({
        "target_phonics_coverage": F.col("target_satisfaction_rate"),
        "off_target_phonics_rate": F.col("above_level_rate"),
        "on_level_rate": F.col("decodability_compliance"),
        "title_present": F.col("title_rate"),
        "has_title": F.col("title_rate"),
        "phonics_leakage": F.col("phonics_leakage_rate"),
        "no_phonics_leakage": 1 - F.col("phonics_leakage_rate"),
        "no_duplicate_sentences": 1 - F.col("has_duplicate_sentences"),
        "complete_output": 1 - F.col("incomplete_output"),
    })


def objective_rows(df: DataFrame) -> DataFrame:
    return scored(df).select(*ROW)
