"""License scan by ordered signature rules, in DataFrame functions alone.

A text becomes canonical words: A-Z in lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``,
one space between. Few texts hold one of the rules' roots; the others are done with a word
count. A candidate text is held against the rules whose root and keyword it contains, all in its
own row: no shuffle, whatever one source holds. Each match is an interval of words; one that lies within an
interval of better priority, or within a wider or earlier one of its own priority, is suppressed.

A null text is empty; repeated rows give equal results; an empty table gives none. Of equal
intervals of one priority the first in label order stays. Input columns named like an output
column give way to it. A very long text is one row of work; nothing of it is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyscale.llm.license_rules import BASE, RULES, SIGN, SIGNED, Rule, root_of, roots_regex

#: Chance that a kept detection of a priority names a real license notice.
CONFIDENCE = (0.99, 0.95, 0.8, 0.5)
_MARK = "\x01"
_SPAN = "struct<start:int,end:int,priority:int,label:string>"


def _literal(rules: tuple[Rule, ...]) -> Column:
    fields = lambda r: {"label": r.label, "priority": r.priority, "root": root_of(r), "keyword": f" {r.keyword}", "regex": f" ((?:{r.regex}))(?= )"}
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in fields(r).items()]) for r in rules])


def _words_in(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1


def _spans(canon: Column, rule: Column) -> Column:
    """Intervals of words that a rule matches: its matches are marked, then the marked words counted off."""
    marked = F.split(F.btrim(F.regexp_replace(canon, rule["regex"], F.lit(f" {_MARK}$1"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i).otherwise(-1)), lambda i: i >= 0)
    matches = F.regexp_extract_all(canon, rule["regex"], F.lit(1))
    pairs = F.arrays_zip(starts.alias("s"), matches.alias("m"))
    return F.transform(pairs, lambda p: F.struct(p["s"].alias("start"), (p["s"] + _words_in(p["m"])).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label")))


def _detect(canon: Column, roots: Column, rules: tuple[Rule, ...]) -> Column:
    """All intervals of the rules, by start, widest first, best priority first, label; ``roots``: those in the text."""
    likely = F.filter(_literal(rules), lambda r: F.array_contains(roots, r["root"]) & F.contains(canon, r["keyword"]))
    spans = F.flatten(F.transform(likely, lambda r: _spans(canon, r)))
    key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["priority"].alias("priority"), s["label"].alias("label"))
    back = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["priority"].alias("priority"), s["label"].alias("label"))
    return F.transform(F.array_sort(F.transform(spans, key)), back)


def _flags(spans: Column) -> Column:
    """For each interval, in order of start, whether it stays: one sweep with the furthest end of each priority so far."""
    levels = range(len(CONFIDENCE))
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in levels], F.array().cast("array<boolean>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        inside = F.lit(False)
        for p in levels:
            inside |= (s["priority"] >= p) & (a[f"m{p}"] >= s["end"])
        return F.struct(*[F.when(s["priority"] == p, F.greatest(a[f"m{p}"], s["end"])).otherwise(a[f"m{p}"]).alias(f"m{p}") for p in levels], F.array_append(a["kept"], ~inside).alias("kept"))

    return F.aggregate(spans, start, step, lambda a: a["kept"])


def canonical(text: Column) -> Column:
    """Words with one space before, between and after them; case is kept, and the plus behind a GPL's version as SIGN, part of its last word."""
    text = F.when(F.contains(text, F.lit("+")), F.regexp_replace(text, SIGNED, f"$1{SIGN}")).otherwise(text)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, detections (kept intervals), base_places, n_base, first_word, last_word, base_labels, labels and score."""
    canon = F.col("__canon")
    likely = F.col("__low").rlike(f" (?:{roots_regex()})")
    empty = F.array().cast(f"array<{_SPAN}>")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = df.withColumn("__canon", canonical(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__low", F.lower("__canon")).withColumn("__likely", likely)
    out = out.withColumns({
        "n_words": F.when(F.length(F.btrim(canon)) == 0, F.lit(0)).otherwise(_words_in(F.btrim(canon))).cast("long"),
        "__canon": F.when(F.col("__likely"), F.translate(canon, upper, upper.lower())),  # only A-Z, unlike lower()
    }).drop("__low", "__likely")
    out = out.withColumn("__roots", F.array_distinct(F.regexp_extract_all(canon, F.lit(f" (?=({roots_regex()}))"), F.lit(1))))
    out = out.withColumns({
        "__spans": F.when(canon.isNotNull(), _detect(canon, F.col("__roots"), RULES)).otherwise(empty),
        "base_places": F.when(canon.isNotNull(), _detect(canon, F.col("__roots"), BASE)).otherwise(empty),
    })
    out = out.withColumn("__flags", _flags(F.col("__spans")))
    out = out.withColumn("detections", F.filter("__spans", lambda s, i: F.get(F.col("__flags"), i)))
    labels = lambda c: F.transform(c, lambda s: s["label"])
    starts = F.transform("base_places", lambda s: s["start"])
    weights = F.transform("detections", lambda s: F.get(F.array(*map(F.lit, CONFIDENCE)), s["priority"]))
    return out.withColumns({
        "n_base": F.size("base_places").cast("long"),
        "first_word": F.array_min(starts).cast("long"),
        "last_word": F.array_max(starts).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(labels(F.col("base_places")))), ","),
        "labels": F.array_join(F.array_sort(F.array_union(labels(F.col("base_places")), labels(F.col("detections")))), ","),
        "score": F.greatest(F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.size("base_places") > 0, F.lit(CONFIDENCE[3])).otherwise(0.0)),
    }).drop("__canon", "__roots", "__spans", "__flags")
