"""A pronunciation lexicon as (word, syllables): an optional, better source of syllables than spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def syllables_of(pronunciations: DataFrame) -> DataFrame:
    """(word, syllables) of (word, phonemes array): the least positive count of phonemes that carry a stress digit, else 1."""
    n = F.size(F.filter("phonemes", lambda p: p.rlike("[0-9]$")))
    return pronunciations.groupBy("word").agg(F.coalesce(F.min(F.when(n > 0, n)), F.lit(1)).alias("syllables"))


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """(word, phonemes) of a text file with lines ``WORD  P1 P2 ...``; ``WORD(2)`` is another pronunciation, ``;;;`` a comment."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith(";;;") & (F.trim("value") != ""))
    return lines.select(F.lower(F.regexp_replace(parts[0], r"\(\d+\)$", "")).alias("word"), F.slice(parts, 2, 1000).alias("phonemes"))


def read_lexicon(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The lexicon at ``path``; None where no path is given, so that syllables go by spelling."""
    return syllables_of(read_pronunciations(spark, path)) if path else None
