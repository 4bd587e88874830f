"""Words classified by a table of patterns: one Aho-Corasick automaton finds the parts of all patterns.

The table has the columns pattern, kind, part and min_length. A word has a pattern if one of its parts
is found in it (kind contains), at its start (prefix), at its end (suffix) or is the whole word
(word), and the word has at least min_length letters (null: any), unless the whole word is listed as
``except``. Parts of one pattern may be of several kinds; an ``except`` may name a part, which then
doesn't count in that word while others do (its part is "word:part").
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.functions import lexicon as L
from storyscale.sources.package import ship

#: Rows of a table of patterns at most: it goes to every task.
MOST = 1 << 20
_FORM = {"contains": "{}", "prefix": "^{}", "suffix": "{}$", "word": "^{}$"}


def spelled_patterns() -> list[tuple[str, str, str, int | None]]:
    """The table of the spelling patterns, from their fixed lists."""
    out = [(p, "contains", x, None) for p, xs in (("digraph", L.DIGRAPHS), ("vowel_team", L.VOWEL_TEAMS), ("r_controlled", L.R_CONTROLLED), ("l_controlled", L.L_CONTROLLED), ("diphthong", L.DIPHTHONGS)) for x in xs]
    out += [("blend", "prefix", x, None) for x in L.INITIAL_BLENDS] + [("blend", "suffix", x, None) for x in L.FINAL_BLENDS]
    out += [("final_e", "suffix", f"{v}{c}e", 4) for v in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"]
    out += [("final_e", "except", w, None) for w in L.FINAL_E_EXCEPTIONS] + [("diphthong", "except", f"{w}:ow", None) for w in L.OW_LONG_O]
    return out + [("irregular", "word", w, None) for w in L.IRREGULAR_WORDS]


class Automaton:
    """All parts of a table of (pattern, kind, part, min_length)."""

    def __init__(self, rows: list[tuple]) -> None:
        self.found: dict[str, list[tuple[str, str, int]]] = {}
        self.excepted: set[tuple[str, str, str | None]] = set()
        for pattern, kind, part, least in rows:
            if kind == "except":
                word, _, what = part.partition(":")
                self.excepted.add((pattern, word, what or None))
            else:
                self.found.setdefault(_FORM[kind].format(part), []).append((pattern, part, least or 0))
        self.automaton = ahocorasick.Automaton()
        for form, hits in self.found.items():
            self.automaton.add_word(form, hits)
        if self.found:
            self.automaton.make_automaton()

    def patterns(self, word: str) -> list[str]:
        """Sorted names of the patterns that a word has."""
        hits = self.automaton.iter(f"^{word}$") if self.found else ()
        has = {p for _, rows in hits for p, part, least in rows if len(word) >= least and (p, word, part) not in self.excepted}
        return sorted(p for p in has if (p, word, None) not in self.excepted)


def classified(words: DataFrame, patterns: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with ``found``: the sorted names of the patterns that each word has. A null word has none."""
    rows = [tuple(r) for r in patterns.select("pattern", "kind", "part", "min_length").limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"a table of patterns has {MOST} rows at most")
    ship(words.sparkSession)
    made: dict[str, Automaton] = {}

    def find(batch: pa.Array) -> pa.Array:
        if "it" not in made:  # once a worker
            made["it"] = Automaton(rows)
        known = batch.dictionary_encode()
        each = [made["it"].patterns(w) for w in known.dictionary.to_pylist()]
        return pa.array([[] if i is None else each[i] for i in known.indices.to_pylist()], pa.list_(pa.string()))

    return words.withColumn("found", F.arrow_udf(find, "array<string>")(F.col(word_col)))
