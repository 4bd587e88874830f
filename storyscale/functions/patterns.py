"""Spelling patterns of a word, as one integer of bits that filters and sums can test cheaply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyscale.functions.lexicon import (
    DIGRAPHS,
    DIPHTHONGS,
    FINAL_BLENDS,
    FINAL_E_EXCEPTIONS,
    INITIAL_BLENDS,
    IRREGULAR_WORDS,
    L_CONTROLLED,
    OW_LONG_O,
    PATTERNS,
    R_CONTROLLED,
    STAGES,
    VOWEL_TEAMS,
)

BIT = {p: 1 << i for i, p in enumerate(PATTERNS)} | {"irregular": 1 << len(PATTERNS)}
ADVANCED = (1 << len(PATTERNS)) - 1


_VOWELS = "aeiouy"


def _at(w: Column, place: int) -> Column:
    """The character at a place from the end (-1: the last)."""
    return F.substring(w, place, 1)


def syllables(w: Column) -> Column:
    """Syllables by spelling: groups of vowels, less a silent final e, plus one for consonant and final le."""
    groups = F.regexp_count(w, F.lit(f"[{_VOWELS}]+"))
    ends_e = _at(w, -1) == "e"
    silent = ends_e & ~_at(w, -2).isin("l", "y")
    le = ends_e & (_at(w, -2) == "l") & ~_at(w, -3).isin(*_VOWELS)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(groups - silent.cast("int") + le.cast("int"), F.lit(1)))


def magic_e(w: Column) -> Column:
    """A final e behind vowel and consonant that lengthens the vowel."""
    return (_at(w, -1) == "e") & (F.length(w) >= 4) & _at(w, -3).isin(*"aeiou") & ~_at(w, -2).isin(*"aeiou") & ~w.isin(FINAL_E_EXCEPTIONS)


def _any(w: Column, parts: list[str]) -> Column:
    """Whether a word holds one of the parts: byte searches, which are cheaper than a regular expression."""
    out = F.contains(w, F.lit(parts[0]))
    for p in parts[1:]:
        out |= F.contains(w, F.lit(p))
    return out


def mask(w: Column, n_syllables: Column | None = None) -> Column:
    """Bits of the word's patterns; an irregular word has only its own and the one of several syllables."""
    n = syllables(w) if n_syllables is None else n_syllables
    bit = lambda name, when: F.when(when, BIT[name]).otherwise(0)
    diphthong = _any(w, [d for d in DIPHTHONGS if d != "ow"]) | (F.contains(w, F.lit("ow")) & ~w.isin(OW_LONG_O))
    starts = [F.left(w, F.lit(n)).isin([b for b in INITIAL_BLENDS if len(b) == n]) for n in (2, 3)]
    regular = (
        bit("digraph", _any(w, DIGRAPHS))
        + bit("blend", starts[0] | starts[1] | F.right(w, F.lit(2)).isin(FINAL_BLENDS))
        + bit("final_e", magic_e(w))
        + bit("vowel_team", _any(w, VOWEL_TEAMS))
        + bit("r_controlled", _any(w, R_CONTROLLED))
        + bit("l_controlled", _any(w, L_CONTROLLED[-1:]))  # al is a part of the others
        + bit("diphthong", diphthong)
    )
    return bit("multisyllabic", n >= 2) + F.when(w.isin(IRREGULAR_WORDS), BIT["irregular"]).otherwise(regular)


def has(m: Column, pattern: str) -> Column:
    """Whether a mask has a pattern; short_vowel: none at all, basic_or_unclassified: none but irregular."""
    if pattern == "short_vowel":
        return m == 0
    if pattern == "basic_or_unclassified":
        return m.bitwiseAND(F.lit(ADVANCED)) == 0
    return m.bitwiseAND(F.lit(BIT[pattern])) != 0


def stage(m: Column) -> Column:
    """Highest stage of a mask; 0 of an irregular word of one syllable."""
    out = F.when(m == 0, STAGES["short_vowel"])
    for s in sorted({STAGES[p] for p in PATTERNS}, reverse=True):
        bits = sum(BIT[p] for p in PATTERNS if STAGES[p] == s)
        out = out.when(m.bitwiseAND(F.lit(bits)) != 0, s)
    return out.otherwise(0)


def pattern_names(m: Column) -> Column:
    """Sorted names of a mask's patterns."""
    names = sorted([*BIT, "basic_or_unclassified"])
    return F.array_compact(F.array(*[F.when(has(m, p), F.lit(p)) for p in names]))


def notes(w: Column, m: Column, in_lexicon: Column | None = None) -> Column:
    """Sorted remarks for a reviewer."""
    several = F.bit_count(m.bitwiseAND(F.lit(ADVANCED))) >= 2
    regular = m.bitwiseAND(F.lit(BIT["irregular"])) == 0
    missing = F.lit(True) if in_lexicon is None else ~in_lexicon
    return F.array_compact(F.array(
        F.when(several, F.lit("contains multiple target patterns")),
        F.when(w.isin(FINAL_E_EXCEPTIONS), F.lit("final-e spelling exception")),
        F.when(missing, F.lit("not found in CMU pronunciation dictionary")),
        F.when(regular & w.isin(OW_LONG_O), F.lit("ow may represent long-o")),
    ))
