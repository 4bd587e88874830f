"""Queries of word, text, profile and row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.functions import patterns, sql, text
from storyscale.functions.lexicon import DISPLAY, PATTERNS
from storyscale.functions.numeric import exact_round
from storyscale.operators import objective, patternscan, profile, prompts
from storyscale.plans import oracle as O
from storyscale.plans.query import query
from storyscale.sources.shared import spread
from storyscale.sources.tables import quoted, read, stories, values

_VOCAB = "(SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM counted GROUP BY word)"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profile.vocabulary(stories(spark, sf_dir))
    return v.withColumn("syl", patterns.syllables(F.col("word"))).withColumn("mask", patterns.mask(F.col("word"), F.col("syl")))


@query(O.query("SELECT word, count(*) AS freq FROM tokens GROUP BY word", O.STORIES, O.TOKENS))
def tokenize_counts(spark, sf_dir):
    """Frequency of each normalised word."""
    return profile.vocabulary(stories(spark, sf_dir))


_RAW = [(w,) for w in ("Cat", "dog's", "DOG’S", "don't", "can’t", "o'clock", "'s", "it's", "n't", "I'm", "rock'n", "s's", "Isn’t", "a")]


@query(f"SELECT raw, {O.normal_word('raw')} AS word FROM (VALUES {quoted(_RAW)}) t(raw)")
def normalize_word_cases(spark, sf_dir):
    """Possessives and contractions."""
    return values(spark, "raw", _RAW).withColumn("word", text.normalize_word(F.col("raw")))


@query(O.query(f"SELECT word, CAST({O.syllables('word')} AS INT) AS syllables FROM {_VOCAB}", O.STORIES, O.TOKENS))
def syllables_vocab(spark, sf_dir):
    """Syllables of each word by spelling."""
    return _vocabulary(spark, sf_dir).select("word", F.col("syl").alias("syllables"))


@query(O.query(f"SELECT word, {O.magic_e('word')} AS magic_e FROM {_VOCAB}", O.STORIES, O.TOKENS))
def magic_e_vocab(spark, sf_dir):
    """Whether each word has a lengthening final e."""
    return profile.vocabulary(stories(spark, sf_dir)).select("word", patterns.magic_e(F.col("word")).alias("magic_e"))


@query(O.query(f"SELECT word, CAST(syl AS INT) AS syllables, array_to_string({O.PATTERN_LIST}, ',') AS patterns, array_to_string({O.NOTES}, '; ') AS notes FROM classified", *O.TO_STAGED))
def classify_vocab(spark, sf_dir):
    """Syllables, patterns and notes of each word, classified once for the whole corpus."""
    w, m = F.col("word"), F.col("mask")
    return _vocabulary(spark, sf_dir).select("word", F.col("syl").alias("syllables"), F.array_join(patterns.pattern_names(m), ",").alias("patterns"), F.array_join(patterns.notes(w, m), "; ").alias("notes"))


_SPELLED = "list_filter([" + ", ".join(f"CASE WHEN p_{p} THEN '{p}' END" for p in sorted(("digraph", "blend", "final_e", "vowel_team", "r_controlled", "l_controlled", "diphthong", "irregular"))) + "], lambda x: x IS NOT NULL)"


@query(O.query(f"SELECT word, array_to_string({_SPELLED}, ',') AS patterns FROM classified", *O.TO_STAGED))
def classify_by_table(spark, sf_dir):
    """Spelling patterns of each word, found by an automaton over a table of patterns."""
    # the table has an irregular word's other patterns too; it stands alone here as in the other classification
    table = spark.createDataFrame(patternscan.spelled_patterns(), "pattern string, kind string, part string, min_length int")
    out = patternscan.classified(profile.vocabulary(stories(spark, sf_dir)), table)
    alone = F.when(F.array_contains("found", "irregular"), F.array(F.lit("irregular"))).otherwise(F.col("found"))
    return out.select("word", F.array_join(alone, ",").alias("patterns"))


@query(O.query(f"SELECT word, total AS freq, CAST(syl AS INT) AS syllables, {O.STAGE} AS stage, array_to_string({O.PATTERN_LIST}, ',') AS patterns FROM classified", *O.TO_STAGED))
def sql_functions(spark, sf_dir):
    """Words of the documents counted and classified in plain SQL."""
    docs = spread(read(spark, sf_dir, "documents").select("text"))
    return sql.register(spark).sql(
        """SELECT word, freq, word_syllables(word) AS syllables, word_stage(mask) AS stage, array_join(word_patterns(mask), ',') AS patterns FROM
           (SELECT *, word_mask(word) AS mask FROM (SELECT word, count(*) AS freq FROM (SELECT explode(words) AS word FROM (SELECT story_words(text) AS words FROM {docs})) GROUP BY word))""",
        docs=docs,
    )


@query(O.query(f"SELECT word, {O.STAGE} AS stage, NOT p_irregular AND {O._REST} AS short_vowel FROM classified", *O.TO_STAGED))
def word_stage_vocab(spark, sf_dir):
    """Highest stage of each word and whether it is a short-vowel word."""
    return _vocabulary(spark, sf_dir).select("word", patterns.stage(F.col("mask")).alias("stage"), patterns.has(F.col("mask"), "short_vowel").alias("short_vowel"))


_LEXICON = [("any", "2"), ("apple", "2"), ("stale", "1"), ("smile", "1"), ("zebra", "0")]
_WORDS = [(w,) for w in "any apple stale smile the because snow window queue night rabbit zebra".split()]


@query(f"SELECT word, CAST(syl AS INT) AS syllables, array_to_string({O.PATTERN_LIST}, ',') AS patterns, {O.STAGE} AS stage FROM ({O.classify(f'(SELECT w.word, CASE WHEN l.n IS NOT NULL THEN greatest(CAST(l.n AS INT), 1) END AS lex FROM (VALUES {quoted(_WORDS)}) w(word) LEFT JOIN (VALUES {quoted(_LEXICON)}) l(word, n) USING (word))', f'coalesce(lex, {O.syllables('word')})')})")
def lexicon_override(spark, sf_dir):
    """A lexicon's syllables go before those by spelling."""
    lex = values(spark, "word n", _LEXICON).withColumn("n", F.greatest(F.col("n").cast("int"), F.lit(1)))
    df = values(spark, "word", _WORDS).join(lex, "word", "left").withColumn("syllables", F.coalesce("n", patterns.syllables(F.col("word"))))
    m = patterns.mask(F.col("word"), F.col("syllables"))
    return df.select("word", "syllables", F.array_join(patterns.pattern_names(m), ",").alias("patterns"), patterns.stage(m).alias("stage"))


_PER_PATTERN = ", ".join(
    f"CAST(coalesce(sum(freq) FILTER (p_{p}), 0) AS INT) AS {p}_count, coalesce(string_agg(word, ', ' ORDER BY word) FILTER (p_{p}), '') AS {p}_words" for p in profile.PROFILED
)
_PROFILE_CTE = f"""grouped AS MATERIALIZED (SELECT s.row_ord, CAST(coalesce(sum(freq), 0) AS INT) AS word_count, CAST(count(word) AS INT) AS unique_word_count, {_PER_PATTERN} FROM stories s LEFT JOIN staged USING (row_ord) GROUP BY s.row_ord),
profiled AS MATERIALIZED (SELECT *, {', '.join(O.rounded(f'100::double * {p}_count / greatest(word_count, 1)', 1) + f' AS {p}_pct' for p in profile.PROFILED)},
  array_to_string(list_filter([{', '.join(f"CASE WHEN {p}_count > 0 THEN '{p}' END" for p in PATTERNS)}], lambda x: x IS NOT NULL), ', ') AS present_patterns FROM grouped)"""
_PROFILE_COLUMNS = ["row_ord", "word_count", "unique_word_count", *[f"{p}_{k}" for p in profile.PROFILED for k in ("count", "pct", "words")], "present_patterns"]


@query(O.query(f"SELECT {', '.join(_PROFILE_COLUMNS)} FROM profiled", *O.TO_STAGED, _PROFILE_CTE))
def story_profile(spark, sf_dir):
    """Counts, shares and words of each pattern in each story."""
    return profile.story_profile(stories(spark, sf_dir)).select(*_PROFILE_COLUMNS)


_FLAGGED = f"SELECT row_ord, word, {{'word': word, 'count': freq, 'patterns': {O.PATTERN_LIST}, 'notes': {O.NOTES}}} AS w FROM staged"


@query(O.query(f"SELECT s.row_ord, CASE WHEN count(word) = 0 THEN '[]' ELSE CAST(to_json(list(w ORDER BY word)) AS VARCHAR) END AS flagged_words_json FROM stories s LEFT JOIN ({_FLAGGED}) f USING (row_ord) GROUP BY s.row_ord", *O.TO_STAGED))
def story_profile_json(spark, sf_dir):
    """Words with notes of each story, as JSON."""
    return profile.story_profile(stories(spark, sf_dir)).select("row_ord", "flagged_words_json")


_LEVEL = "CASE row_ord % 9 WHEN 0 THEN '3.0' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(row_ord % 9 AS VARCHAR) END"
_LEVEL_SQL = {k: " + ".join(f"CASE WHEN {c.format(lv)} THEN {p}_count ELSE 0 END" for p, lv in profile.LEVELS.items()) for k, c in {"target": "lev = {}", "above": "lev < {}"}.items()}


@query(O.query(
    f"""SELECT row_ord, CAST(assigned_level AS INT) AS assigned_level, CAST(t AS INT) AS target_pattern_count, {O.rounded('100::double * t / n', 1)} AS target_pattern_pct, CAST(a AS INT) AS above_level_count, {O.rounded('100::double * a / n', 1)} AS above_level_pct,
    CASE WHEN review_reason = '' THEN 'NO' ELSE 'YES' END AS review_required, review_reason FROM (SELECT *, CASE WHEN assigned_level IS NULL THEN 'missing or unsupported assigned level'
    ELSE array_to_string(list_filter([CASE WHEN lev >= 3 AND t < 2 THEN 'fewer than 2 target-pattern tokens' END, CASE WHEN a::double / n > 0.05::double THEN 'more than 5% above-level pattern tokens' END], lambda x: x IS NOT NULL), '; ') END AS review_reason
    FROM (SELECT *, CASE WHEN lev BETWEEN 2 AND 8 THEN lev END AS assigned_level, greatest(word_count, 1) AS n, CASE WHEN lev BETWEEN 2 AND 8 THEN {_LEVEL_SQL['target']} END AS t, CASE WHEN lev BETWEEN 2 AND 8 THEN {_LEVEL_SQL['above']} END AS a
    FROM (SELECT *, CAST(trunc(TRY_CAST({_LEVEL} AS DOUBLE)) AS INT) AS lev FROM profiled)))""", *O.TO_STAGED, _PROFILE_CTE))  # fmt: skip
def level_review(spark, sf_dir):
    """Each story against a labelled level."""
    level = F.expr(f"CASE row_ord % 9 WHEN 0 THEN '3.0' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(row_ord % 9 AS STRING) END")
    df = profile.level_review(profile.story_profile(stories(spark, sf_dir).withColumn("menon_hiebert_level", level)))
    return df.select("row_ord", "assigned_level", "target_pattern_count", "target_pattern_pct", "above_level_count", "above_level_pct", "review_required", "review_reason")


_CANDIDATES = " UNION ALL ".join(
    f"SELECT row_ord, '{DISPLAY.get(p, profile.L_CONTROLLED_DISPLAY)}' AS name, count(*) FILTER (p_{p}) AS n, {profile.TIE_ORDER[p]} AS tie FROM staged GROUP BY row_ord" for p in PATTERNS
)


@query(O.query(
    f"""SELECT s.row_ord, coalesce(string_agg(name, ', ' ORDER BY n DESC, tie DESC, name), 'short-vowel words') AS selected_targets FROM stories s LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY row_ord ORDER BY n DESC, tie DESC, name) AS r FROM ({_CANDIDATES}) WHERE n >= 4) c ON s.row_ord = c.row_ord AND r <= 3 GROUP BY s.row_ord""", *O.TO_STAGED))  # fmt: skip
def select_targets(spark, sf_dir):
    """The best covered patterns of each story."""
    return profile.select_targets(profile.with_words(stories(spark, sf_dir))).select("row_ord", "selected_targets")


_TARGETS = [(t,) for t in ("short-vowel words", " final-e words ,, vowel teams,", "", "magic words, diphthongs", "consonant digraphs, consonant blends", "l-controlled vowels")] + [(None,)]


@query(f"SELECT raw, array_to_string(ts, '|') AS targets, array_to_string(list_filter(ts, lambda t: t NOT IN ({O.texts(DISPLAY.values())})), '|') AS unknown FROM (SELECT raw, {O.targets('raw')} AS ts FROM (VALUES {quoted(_TARGETS)}) t(raw))")
def parse_targets(spark, sf_dir):
    """Target cells and the names that no pattern has."""
    df = values(spark, "raw", _TARGETS).withColumn("ts", text.parse_targets(F.col("raw")))
    return df.select("raw", F.array_join("ts", "|").alias("targets"), F.array_join(objective.unknown_targets(F.col("ts")), "|").alias("unknown"))


@query(f"SELECT raw, CAST(top AS INT) AS ceiling_stage, {O.ceiling_label('ts', 'top')} AS ceiling_label FROM (SELECT *, {O.ceiling('ts')} AS top FROM (SELECT raw, {O.targets('raw')} AS ts FROM (VALUES {quoted(_TARGETS)}) t(raw)))")
def permitted_ceiling(spark, sf_dir):
    """Ceiling stage and label of target cells."""
    df = values(spark, "raw", _TARGETS).withColumn("ts", text.parse_targets(F.col("raw"))).withColumn("ceiling_stage", objective.ceiling(F.col("ts")))
    return df.select("raw", "ceiling_stage", objective.ceiling_label(F.col("ts"), F.col("ceiling_stage")).alias("ceiling_label"))


_LEVEL_COLUMNS = "row_ord, word_count, unique_word_count, permitted_ceiling_stage, above_level_words, above_level_word_occurrences, above_level_distinct_words, above_level_rate, distinct_above_level_rate, decodability_compliance, distinct_decodability_compliance, on_or_below_level_rate, mean_above_level_distance, max_above_level_distance, weighted_above_level_rate"


@query(O.query(f"SELECT {_LEVEL_COLUMNS} FROM levels", *O.TO_LEVELS))
def level_metrics(spark, sf_dir):
    """Above-level measures of each story."""
    return objective.with_levels(objective.with_targets(profile.with_words(stories(spark, sf_dir)))).select(*_LEVEL_COLUMNS.split(", "))


_COUNTS = [f"{p}_distinct_count" for p in DISPLAY]


@query(O.query(f"SELECT row_ord, target_satisfaction_rate, {', '.join(_COUNTS)} FROM levels", *O.TO_LEVELS))
def target_satisfaction(spark, sf_dir):
    """Coverage credit of each story and distinct words of each pattern."""
    return objective.with_targets(profile.with_words(stories(spark, sf_dir))).select("row_ord", "target_satisfaction_rate", *_COUNTS)


@query(O.query(
    f"""SELECT row_ord, CAST(len(targets) AS INT) AS targets_requested, CAST(len(list_filter(counts, lambda n: n >= 4)) AS INT) AS targets_passed, array_to_string(list_filter(targets, lambda t, i: counts[i] >= 4), ', ') AS targets_passed_list,
    array_to_string(list_filter(targets, lambda t, i: counts[i] < 4), ', ') AS targets_failed_list, permitted_ceiling_stage, {O.ceiling_label('targets', 'permitted_ceiling_stage')} AS permitted_ceiling_label FROM levels""", *O.TO_LEVELS))  # fmt: skip
def target_pass_lists(spark, sf_dir):
    """Targets that each story passes and fails."""
    df = objective.with_targets(profile.with_words(stories(spark, sf_dir)))
    return df.select("row_ord", "targets_requested", "targets_passed", "targets_passed_list", "targets_failed_list", "permitted_ceiling_stage", "permitted_ceiling_label")


@query(O.query(
    f"""SELECT row_ord, target, n AS target_distinct, {O.rounded('least(n::double / 4, 1::double)')} AS target_credit, CAST(n >= 4 AS INT) AS target_pass FROM
    (SELECT row_ord, targets[i] AS target, counts[i] AS n FROM (SELECT *, unnest(generate_series(1, len(targets))) AS i FROM levels))""", *O.TO_LEVELS))  # fmt: skip
def target_details(spark, sf_dir):
    """Each requested target of each story."""
    return objective.target_details(profile.with_words(stories(spark, sf_dir))).select("row_ord", "target", "target_distinct", "target_credit", "target_pass")


_WIDE = ", ".join(f"max(n) FILTER (target = '{d}') AS {p}_target_distinct, max({O.rounded('least(n::double / 4, 1::double)')}) FILTER (target = '{d}') AS {p}_target_credit, max(CAST(n >= 4 AS INT)) FILTER (target = '{d}') AS {p}_target_pass" for p, d in DISPLAY.items())


@query(O.query(f"SELECT row_ord, {_WIDE} FROM (SELECT row_ord, targets[i] AS target, counts[i] AS n FROM (SELECT *, unnest(generate_series(1, len(targets))) AS i FROM levels)) GROUP BY row_ord", *O.TO_LEVELS))
def target_details_wide(spark, sf_dir):
    """A story's requested targets in columns of their own; the others are null."""
    out = objective.wide_targets(profile.with_words(stories(spark, sf_dir)))
    return out.select("row_ord", *objective.WIDE)


_LEAKS = [(t,) for t in ("Phonics fun", "The FINAL exam", "A short vowel and a digraph", "the cat sat", "R-Controlled and r controlled", "")] + [(None,)]


@query(f"SELECT story, {O.leakage('story')} AS terms FROM (VALUES {quoted(_LEAKS)}) t(story)")
def leakage_cases(spark, sf_dir):
    """Terms that give the exercise away."""
    return values(spark, "story", _LEAKS).withColumn("terms", text.leakage_terms(F.lower("story")))


_CASES = [(str(i), t) for i, t in enumerate((
    "", "  \n ", "**The Cat**\n\nThe cat sat. The cat ran.", "# The Frog\nA frog can hop. It is fun.", "Title: The Fun Game\n\nWe run. We hop.", "Title - Title: Big Dog\nThe dog ran. It sat.", "Title:\nThe cat sat. It ran.",
    "A Big Day\n\nThe sun is up. We run.", "It is hot.\n\nThe sun is up. We run.", "**Title: The Pig**\nA pig dug. It sat.", "The cat sat. The cat sat! the cat sat", "The cat sat. Then it ran to the", '"Stop!" said Sam. "Go!"',
    'He said "go. We ran.', "**Only a Title**", "The cat sat...", "We run and", "\n\n  ## Late Title  \r\nIt ran.\r\nIt sat.", "one two three four five six seven eight nine ten eleven twelve thirteen\n\nText here.", "title: **Bold One**\nx. y", "No end,", "It was 5 — \n\n\nfine [", "  ***  \n\na. b",
)) ] + [("n", None)]
_CASES_SQL = f"cases AS (SELECT * FROM (VALUES {quoted(_CASES)}) t(id, story)),\n{O.title_ctes('cases', 'id')}"


@query(O.query("SELECT id, CAST(title_text IS NOT NULL AS INT) AS has_title, coalesce(title_text, '') AS title, body FROM checked", _CASES_SQL))
def title_cases(spark, sf_dir):
    """Title and body of telling texts."""
    df = objective.with_text_parts(values(spark, "id story", _CASES)).withColumn("t", F.col("__title"))
    return df.select("id", F.col("t").isNotNull().cast("int").alias("has_title"), F.coalesce("t", F.lit("")).alias("title"), F.col("__body").alias("body"))


@query(O.query("SELECT id, CAST(len(parts) AS INT) AS sentence_count, array_to_string(repeated, '|') AS repeated, reasons FROM checked", _CASES_SQL))
def incomplete_cases(spark, sf_dir):
    """Sentences, repeats and signs of unfinished text."""
    df = objective.with_text_checks(values(spark, "id story", _CASES))
    return df.select("id", "sentence_count", F.replace("duplicate_sentence_norms", F.lit(" | "), F.lit("|")).alias("repeated"), F.col("incomplete_reasons").alias("reasons"))


@query(O.query("SELECT row_ord, CAST(i AS INT) AS i, parts[i] AS sentence, regexp_replace(regexp_replace(" + O.strip("lower(parts[i])") + r", '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g') AS norm FROM (SELECT row_ord, parts, unnest(generate_series(1, len(parts))) AS i FROM parted)", O.STORIES, O.title_ctes("stories", "row_ord")))
def sentences(spark, sf_dir):
    """Each sentence of each story and its normal form."""
    df = objective.with_text_parts(stories(spark, sf_dir)).select("row_ord", F.posexplode("__sentences").alias("i", "sentence"))
    return df.select("row_ord", (F.col("i") + 1).alias("i"), "sentence", text.normalize_sentence(F.col("sentence")).alias("norm"))


@query(O.query("SELECT row_ord, s AS sentence FROM (SELECT row_ord, unnest(repeated) AS s FROM repeats)", O.STORIES, O.title_ctes("stories", "row_ord")))
def duplicate_sentences(spark, sf_dir):
    """Sentences that a story repeats."""
    return objective.with_text_parts(stories(spark, sf_dir)).select("row_ord", F.explode(text.repeated(F.col("__norms"))).alias("sentence"))


@query(O.query(f"SELECT {', '.join(objective.ROW)} FROM objective", *O.TO_OBJECTIVE))
def objective_rows(spark, sf_dir):
    """All row metrics of each story."""
    return objective.objective_rows(stories(spark, sf_dir))


_NUMBERS = [(x,) for x in ("3", "3.7", " 2 ", "-1.5", "", "abc", "1e2", "0", "nan x")] + [(None,)]


@query(f"SELECT x, coalesce(TRY_CAST(nullif(x, '') AS DOUBLE), 0::double) AS f, coalesce(CAST(trunc(TRY_CAST(nullif(x, '') AS DOUBLE)) AS INT), 0) AS i FROM (VALUES {quoted(_NUMBERS)}) t(x)")
def safe_cast_cases(spark, sf_dir):
    """Numbers from cells, with a default."""
    return values(spark, "x", _NUMBERS).select("x", text.safe_double(F.col("x")).alias("f"), text.safe_int(F.col("x")).alias("i"))


@query("SELECT k, n, " + O.rounded("k::double / n") + " AS r4, " + O.rounded("k::double / n", 1) + " AS r1, printf('%.1f%%', " + O.rounded("100::double * k / n", 1) + ") AS pct FROM (SELECT CAST(k AS INT) AS k, CAST(n AS INT) AS n FROM (SELECT unnest(generate_series(-40, 640)) AS k) CROSS JOIN (VALUES (8), (16), (32), (160), (625), (800)) t(n))")
def format_cases(spark, sf_dir):
    """Rounding and percentages of ratios that come close to ties."""
    ns = spark.createDataFrame([(n,) for n in (8, 16, 32, 160, 625, 800)], "n int")
    df = ns.select(F.explode(F.sequence(F.lit(-40), F.lit(640))).alias("k"), "n")
    x = F.col("k").cast("double") / F.col("n")
    return df.select("k", "n", exact_round(x).alias("r4"), exact_round(x, 1).alias("r1"), F.format_string("%.1f%%", exact_round(F.lit(100.0) * F.col("k") / F.col("n"), 1)).alias("pct"))


@query(f"SELECT prompt_id, {prompts.oracle('ts')} AS prompt FROM (SELECT prompt_id, {O.targets('targets')} AS ts FROM (VALUES {quoted(prompts.CASES)}) t(prompt_id, targets))")
def build_prompts(spark, sf_dir):
    """Generation prompts of the evaluation cases."""
    df = values(spark, "prompt_id targets", prompts.CASES)
    return df.select("prompt_id", prompts.build(text.parse_targets(F.col("targets"))).alias("prompt"))




@query(O.query(
    "SELECT pattern, CAST(count(DISTINCT word) AS BIGINT) AS distinct_words, CAST(sum(total) AS BIGINT) AS tokens FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS pattern, word, total FROM classified WHERE p_{p}" for p in profile.PROFILED) + ") GROUP BY pattern", *O.TO_STAGED))
def pattern_set_ops(spark, sf_dir):
    """Distinct words and tokens of each pattern over the corpus."""
    df = _vocabulary(spark, sf_dir).select("freq", "word", F.explode(patterns.pattern_names(F.col("mask"))).alias("pattern")).where(F.col("pattern") != "basic_or_unclassified")
    return df.groupBy("pattern").agg(F.count(F.lit(1)).alias("distinct_words"), F.sum("freq").alias("tokens"))  # a word stands once in the vocabulary


