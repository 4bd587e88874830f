"""The word functions as SQL functions of a session; Catalyst puts their bodies in place of the calls.

``register(spark)`` makes story_words, word_syllables, word_mask, word_stage and word_patterns
temporary functions, so that plain SQL tokenises and classifies as the DataFrame functions do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from storyscale.functions import lexicon as L
from storyscale.functions.patterns import ADVANCED, BIT


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(word: str, xs) -> str:
    return f"{word} IN ({', '.join(map(_quoted, xs))})"


def _holds(word: str, xs) -> str:
    return "(" + " OR ".join(f"contains({word}, {_quoted(x)})" for x in xs) + ")"


def _mask(w: str) -> str:
    vowels = ", ".join(map(_quoted, "aeiou"))
    tests = {
        "digraph": _holds(w, L.DIGRAPHS),
        "blend": f"({' OR '.join([f'startswith({w}, {_quoted(b)})' for b in L.INITIAL_BLENDS] + [f'endswith({w}, {_quoted(b)})' for b in L.FINAL_BLENDS])})",
        "final_e": f"(length({w}) >= 4 AND right({w}, 1) = 'e' AND substr({w}, -3, 1) IN ({vowels}) AND substr({w}, -2, 1) NOT IN ({vowels}) AND NOT {_among(w, L.FINAL_E_EXCEPTIONS)})",
        "vowel_team": _holds(w, L.VOWEL_TEAMS),
        "r_controlled": _holds(w, L.R_CONTROLLED),
        "l_controlled": _holds(w, L.L_CONTROLLED),
        "diphthong": f"({_holds(w, [d for d in L.DIPHTHONGS if d != 'ow'])} OR (contains({w}, 'ow') AND NOT {_among(w, L.OW_LONG_O)}))",
    }
    regular = " + ".join(f"IF({t}, {BIT[p]}, 0)" for p, t in tests.items())
    return f"IF(word_syllables({w}) >= 2, {BIT['multisyllabic']}, 0) + IF({_among(w, L.IRREGULAR_WORDS)}, {BIT['irregular']}, {regular})"


def _stage(m: str) -> str:
    out = f"CASE WHEN {m} = 0 THEN {L.STAGES['short_vowel']}"
    for s in sorted({L.STAGES[p] for p in L.PATTERNS}, reverse=True):
        out += f" WHEN ({m} & {sum(BIT[p] for p in L.PATTERNS if L.STAGES[p] == s)}) <> 0 THEN {s}"
    return out + " ELSE 0 END"


def _patterns(m: str) -> str:
    tests = {p: f"({m} & {b}) <> 0" for p, b in BIT.items()} | {"basic_or_unclassified": f"({m} & {ADVANCED}) = 0"}
    return "array_compact(array(" + ", ".join(f"IF({tests[p]}, {_quoted(p)}, NULL)" for p in sorted(tests)) + "))"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE = "CASE WHEN endswith(w, '\\'s') AND length(w) > 2 THEN left(w, length(w) - 2) WHEN endswith(w, 'n\\'t') AND length(w) > 3 THEN left(w, length(w) - 3) ELSE split_part(w, '\\'', 1) END"

#: Name with parameters, type and body of each function.
FUNCTIONS = {
    "story_words(story STRING)": ("ARRAY<STRING>", f"transform(regexp_extract_all(translate(coalesce(story, ''), {_quoted(_UPPER + '’')}, {_quoted(_UPPER.lower() + chr(39))}), '[a-z]+(?:\\'[a-z]+)?', 0), w -> {_BASE})"),
    "word_syllables(word STRING)": ("INT", "IF(length(word) <= 3, 1, greatest(regexp_count(word, '[aeiouy]+') - IF(endswith(word, 'e') AND substr(word, -2, 1) NOT IN ('l', 'y'), 1, 0) + IF(endswith(word, 'le') AND substr(word, -3, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y'), 1, 0), 1))"),
    "word_mask(word STRING)": ("INT", _mask("word")),
    "word_stage(mask INT)": ("INT", _stage("mask")),
    "word_patterns(mask INT)": ("ARRAY<STRING>", _patterns("mask")),
}


def register(spark: SparkSession) -> SparkSession:
    """The session, with FUNCTIONS as temporary functions."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return spark
