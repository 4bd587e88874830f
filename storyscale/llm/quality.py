"""Quality rules by weak supervision, in DataFrame functions alone.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). Votes are grouped to
patterns in Spark; there are at most 3 ** (number of rules) of them, whatever the size of the
corpus, and expectation-maximisation over their counts estimates each rule's accuracy and the
share of good documents. A document is kept if its posterior probability of being good reaches
the threshold and the base rules do not fail it.

A null or wordless text has zero counts and fails the base rules; an empty table gives no rows
and the starting accuracies; repeated rows are rated alike. A very long text is one row of work,
counted whole. A posterior that ties with the threshold is kept; patterns of equal count are fitted in
their own order, so the fit is the same each time. Input columns named like an output column give way
to it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyscale.llm.common import SPACE, checkpointed, work_dir

_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    name: str
    value: str  #: SQL over the features
    bad: str  #: SQL condition on ``v`` for the vote bad
    good: str  #: for the vote good


RULES = (
    Rule("length", "n_words", "v < 10", "v >= 40"),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", "v > 0.2", "v <= 0.02"),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", "v > 0.1", "v <= 0.01"),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", "v > 0.03", "v <= 0.005"),
    Rule("marks", "(word_chars - n_alnum) / greatest(word_chars, 1)", "v > 0.1", "v <= 0.06"),
    Rule("word_length", "word_chars / greatest(n_words, 1)", "v < 2.5 or v > 12", "v between 3.5 and 9"),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", "v > 0.3", "v = 0 and n_lines > 1"),
    Rule("digits", "n_digits / greatest(word_chars, 1)", "v > 0.15", "v <= 0.03"),
    Rule("line_ends", "n_ended_lines / greatest(n_lines, 1)", "v < 0.2", "v >= 0.6"),
    Rule("distinct", "n_distinct_words / greatest(n_words, 1)", "v < 0.25", "v >= 0.4"),
)


class Model(NamedTuple):
    """prior: share of good documents; good, bad: for each rule the chances of the votes -1, 0 and 1 on good and on bad documents."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]


#: Where EM starts, and what an empty table gives: votes are right more often than wrong.
START = Model(0.8, ((0.05, 0.25, 0.7),) * len(RULES), ((0.5, 0.25, 0.25),) * len(RULES))


def _shared(value: Column, body) -> Column:
    """``body`` of a value that is computed once for all places where body uses it."""
    return F.transform(F.array(value), body)[0]


def _word_windows(words: Column) -> Column:
    """Hashes of all windows of five words."""

    def windows(h: Column) -> Column:
        n = F.size(h) - WINDOW
        return F.when(n < 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        )

    return _shared(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice.

    Most texts repeat no window, which a hash set tells. The others sort (hash, place), keep the
    places whose neighbour has the same hash, and add up what each adds to the cover.
    """

    def places(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        return F.array_sort(
            F.transform(
                F.filter(pairs, lambda p, i: F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
                lambda p: p["i"],
            )
        )

    def cover(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")), lambda a, p: F.struct((a["covered"] + p + WINDOW - F.greatest(a["end"], p)).alias("covered"), (p + WINDOW).alias("end")), lambda a: a["covered"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_shared(_shared(pairs, places), cover)).cast("long")


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    has_word = lambda x: F.btrim(x, F.lit(_BLANKS)) != ""
    out = df.withColumns({
        "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")),
        "__lines": F.filter(F.split(text, "\n"), has_word),
        "__chars": F.length(text).cast("long"),
    })
    out = out.withColumn("__windows", _word_windows(F.col("__words")))
    without = lambda chars: F.col("__chars") - F.length(F.translate(text, chars, ""))
    return out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("__windows")),
        "n_alnum": F.length(F.regexp_replace(F.array_join("__words", ""), r"[^\p{L}\p{N}]+", "")).cast("long"),
        "n_digits": without("0123456789").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_ended_lines": F.size(F.filter("__lines", lambda x: F.right(F.btrim(x, F.lit(_BLANKS)), F.lit(1)).isin(".", "!", "?", '"', ":", "»"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("__words")).cast("long"),
    }).drop("__words", "__lines", "__chars", "__windows")


#: The counts that need no fit, in DuckDB.
COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS five FROM t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (SELECT unnest(generate_series(0, {WINDOW - 1})) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o
"""


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(r: Rule) -> Column:
    return F.expr(f"case when {r.bad.replace('v ', f'({r.value}) ')} then -1 when {r.good.replace('v ', f'({r.value}) ')} then 1 else 0 end")


def votes() -> Column:
    return F.array(*map(_vote, RULES))


def _gains(model: Model) -> list[tuple[float, float, float]]:
    """Log odds of good that each vote of each rule adds. A vote never counts against its meaning."""
    out = []
    for g, b in zip(model.good, model.bad, strict=True):
        no, none, yes = (math.log(x / y) for x, y in zip(g, b, strict=True))
        out.append((min(no, 0.0), 0.0, max(yes, 0.0)))
    return out


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def posterior(model: Model) -> Column:
    """Probability of good from the array of votes."""
    logit = F.lit(_logit(model.prior))
    for i, (no, _, yes) in enumerate(_gains(model)):
        v = F.get("votes", i)
        logit += F.when(v < 0, no).when(v > 0, yes).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior_weight: float = 0.01) -> Model:
    """EM over counted vote patterns: each rule's accuracy on good and on bad documents, and the share of good.

    The starting chances count as ``prior_weight`` of all documents, which keeps the classes from
    trading places and a rule that hardly votes near its start.
    """
    model = START
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    if not total:
        return model
    m = prior_weight * total
    for _ in range(rounds):
        gains = _gains(model)
        seen = {1: [[m * x for x in r] for r in START.good], 0: [[m * x for x in r] for r in START.bad]}
        good = m * START.prior
        for v, n in patterns:
            p = 1 / (1 + math.exp(-_logit(model.prior) - sum(gains[j][x + 1] for j, x in enumerate(v))))
            good += n * p
            for j, x in enumerate(v):
                seen[1][j][x + 1] += n * p
                seen[0][j][x + 1] += n * (1 - p)
        rates = {k: tuple(tuple(x / sum(r) for x in r) for r in rows) for k, rows in seen.items()}
        model = Model(min(max(good / (total + m), 0.05), 0.95), rates[1], rates[0])
    return model


def rate(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with features, votes, posterior, base_failed and kept.

    The counts are written once to the shared folder and read by both the fit and the result, so
    whole texts are worked on once, without a shuffle.
    """
    carried = df.columns if carry is None else carry
    rated = with_features(df, text_col).withColumn("votes", votes()).withColumn("base_failed", base_failed())
    made = [c for c in rated.columns if c not in df.columns or c in ("votes", "base_failed")]
    own = [c for c in rated.columns if c in {*made, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_alnum", "n_digits", "n_lines", "n_ended_lines", "n_distinct_words"}]
    rated = checkpointed(rated.select(*[c for c in carried if c not in own], *own), work_dir(df.sparkSession, "quality"))
    counted = rated.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(RULES) rows
    model = fit([(tuple(r["votes"]), r["n"]) for r in counted])
    rated = rated.withColumn("posterior", posterior(model))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
