"""Distinct words of a story with their frequency, patterns and stage, computed in the story's own row.

Words come from one Arrow pass (``wordscan``) and are put back on the row; all metrics are then
sums over ``tally``, which has one entry for each mask of patterns in the story: no shuffle,
whatever one story or prompt holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyscale.functions import patterns, text
from storyscale.functions.lexicon import DISPLAY, LEVELS, MAX_TARGETS, PASS_WORDS, PATTERNS, TIE_ORDER, L_CONTROLLED_DISPLAY
from storyscale.functions.numeric import exact_round
from storyscale.operators import wordscan
from storyscale.sources.package import ship


def with_words(df: DataFrame, story: str = "story") -> DataFrame:
    """``df`` with word_count, unique_word_count, words (distinct words in order) and tally (their sums by mask)."""
    ship(df.sparkSession)
    df = df.withColumn("__scan", F.arrow_udf(wordscan.scan, wordscan.SCAN)(story))
    return df.withColumns({
        "word_count": F.col("__scan.total"),
        "unique_word_count": F.size("__scan.words"),
        "words": F.col("__scan.words"),
        "tally": F.col("__scan.tally"),
    }).drop("__scan")


def with_lexicon(df: DataFrame, lexicon: DataFrame, key: str = "row_ord") -> DataFrame:
    """``df`` of with_words, its words classified anew with the syllables of a lexicon where it has them.

    Words are joined one row each and put together again by ``key``, which must be unique; the words
    of a story are bounded by its text. Spark broadcasts the lexicon if it finds it small.
    """
    w = F.col("w.word")
    rows = df.select(key, F.explode("words").alias("w")).join(lexicon.select(F.col("word").alias("__word"), "syllables"), w == F.col("__word"), "left")
    m = patterns.mask(w, F.coalesce("syllables", patterns.syllables(w)))
    rows = rows.select(key, F.struct(w.alias("word"), F.col("w.freq").alias("freq"), m.alias("mask"), patterns.stage(m).alias("stage")).alias("w"))
    again = rows.groupBy(key).agg(F.sort_array(F.collect_list("w")).alias("__words"))
    out = df.join(again, key, "left").withColumn("words", F.coalesce("__words", "words")).drop("__words")
    one = F.lit(1).alias("words")
    return out.withColumn("tally", F.transform("words", lambda w: F.struct(w["mask"].alias("mask"), w["stage"].alias("stage"), w["freq"].alias("freq"), one)))


def vocabulary(df: DataFrame, story: str = "story") -> DataFrame:
    """(word, freq) over all stories: counted before the shuffle, so frequent words are no load."""
    return df.select(F.explode(text.words(F.col(story))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def words_with(pattern: str) -> Column:
    """Distinct words of a pattern, in order."""
    return F.transform(F.filter("words", lambda w: patterns.has(w["mask"], pattern)), lambda w: w["word"])


def tallied(of: str, when, value=lambda t, n: n) -> Column:
    """Sum over the masks that meet ``when`` of their ``of`` (freq: occurrences, words: distinct words)."""
    return F.aggregate("tally", F.lit(0), lambda a, t: F.when(when(t), a + value(t, t[of])).otherwise(a))


def tokens_with(pattern: str) -> Column:
    """Occurrences of a pattern's words."""
    return tallied("freq", lambda t: patterns.has(t["mask"], pattern))


def distinct_with(pattern: str) -> Column:
    """How many distinct words a pattern has."""
    return tallied("words", lambda t: patterns.has(t["mask"], pattern))


PROFILED = (*PATTERNS, "irregular")


def story_profile(df: DataFrame) -> DataFrame:
    """Counts, percentages and words of each pattern, and the patterns present."""
    df = with_words(df)
    total = F.greatest(F.col("word_count"), F.lit(1))
    df = df.withColumns({f"{p}_count": tokens_with(p) for p in PROFILED} | {f"{p}_words": F.array_join(words_with(p), ", ") for p in PROFILED})
    df = df.withColumns({f"{p}_pct": exact_round(F.lit(100.0) * F.col(f"{p}_count") / total, 1) for p in PROFILED})
    present = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{p}_count") > 0, F.lit(p)) for p in PATTERNS])), ", ")
    flagged = F.transform(
        F.filter("words", lambda w: F.size(patterns.notes(w["word"], w["mask"])) > 0),
        lambda w: F.struct(w["word"].alias("word"), w["freq"].alias("count"), patterns.pattern_names(w["mask"]).alias("patterns"), patterns.notes(w["word"], w["mask"]).alias("notes")),
    )
    return df.withColumn("present_patterns", present).withColumn("flagged_words_json", F.to_json(flagged))


def select_targets(df: DataFrame) -> DataFrame:
    """target_phonics of a profiled story: its best covered patterns, at most three."""
    names = {p: DISPLAY.get(p, L_CONTROLLED_DISPLAY) for p in PATTERNS}
    found = F.array(*[F.struct((-distinct_with(p)).alias("n"), F.lit(-TIE_ORDER[p]).alias("tie"), F.lit(names[p]).alias("name")) for p in PATTERNS])
    best = F.slice(F.array_sort(F.filter(found, lambda x: x["n"] <= -PASS_WORDS)), 1, MAX_TARGETS)
    return df.withColumn("selected_targets", F.when(F.size(best) == 0, F.lit(DISPLAY["short_vowel"])).otherwise(F.array_join(F.transform(best, lambda x: x["name"]), ", ")))


def level_review(df: DataFrame, level: str = "menon_hiebert_level") -> DataFrame:
    """Whether a profiled story fits its labelled level: target and above-level pattern tokens, verdict and reasons."""
    lev = F.col(level).try_cast("double").try_cast("int")
    known = lev.between(2, 8)
    total = F.greatest(F.col("word_count"), F.lit(1))
    count = lambda when: sum((F.when(when(LEVELS[p]), F.col(f"{p}_count")).otherwise(0) for p in PATTERNS), F.lit(0))
    df = df.withColumn("assigned_level", F.when(known, lev)).withColumns({
        "target_pattern_count": F.when(known, count(lambda x: lev == x)),
        "above_level_count": F.when(known, count(lambda x: lev < x)),
    })
    above = F.col("above_level_count") / total
    reasons = F.array_join(F.array_compact(F.array(
        F.when((lev >= 3) & (F.col("target_pattern_count") < 2), F.lit("fewer than 2 target-pattern tokens")),
        F.when(above > 0.05, F.lit("more than 5% above-level pattern tokens")),
    )), "; ")
    return df.withColumns({
        "target_pattern_pct": exact_round(F.lit(100.0) * F.col("target_pattern_count") / total, 1),
        "above_level_pct": exact_round(F.lit(100.0) * F.col("above_level_count") / total, 1),
        "review_reason": F.when(F.col("assigned_level").isNull(), "missing or unsupported assigned level").otherwise(reasons),
    }).withColumn("review_required", F.when(F.col("review_reason") == "", "NO").otherwise("YES"))
