"""Matched pairs of base and tuned rows.

A pair is one group of the keys: the last base row and the last tuned row are picked while
grouping, which needs one shuffle of partial results and no self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.functions.numeric import exact_round, rounded_means
from storyscale.operators.ranking import Ranking, ranked
from storyscale.sources.tables import KEYS

MODELS = ("base", "tuned")


def pair_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """KEYS, base and tuned: structs of the columns of the last row (by row_ord) of each model, or null."""
    row = F.struct(*columns)
    last = [F.max_by(F.when(F.col("model") == m, row), F.when(F.col("model") == m, F.col("row_ord"))).alias(m) for m in MODELS]
    return df.groupBy(*KEYS).agg(*last)


_METRICS = {"decodability_compliance": "compliance_delta", "weighted_above_level_rate": "weighted_rate_delta", "target_satisfaction_rate": "satisfaction_delta"}


def paired_comparison(df: DataFrame) -> DataFrame:
    """Metrics of both sides of each complete pair and the differences tuned - base."""
    pairs = pair_rows(df, ["target_phonics", "word_count", *_METRICS]).where("base IS NOT NULL AND tuned IS NOT NULL")
    cols = [F.col("base.target_phonics").alias("target_phonics")]
    for metric, delta in _METRICS.items():
        cols += [F.col(f"{m}.{metric}").alias(f"{m}_{metric}") for m in MODELS]
        cols.append(exact_round(F.col(f"tuned.{metric}") - F.col(f"base.{metric}")).alias(delta))
    return pairs.select(*KEYS, *cols, *[F.col(f"{m}.word_count").alias(f"{m}_word_count") for m in MODELS])


def unmatched(df: DataFrame) -> DataFrame:
    """One row: how many keys lack a side."""
    return pair_rows(df, ["row_ord"]).agg(F.count_if(F.expr("base IS NULL OR tuned IS NULL")).alias("unmatched"))


def means(pairs: DataFrame) -> DataFrame:
    """One row: the mean of each difference."""
    return rounded_means(pairs, {f"mean_{d}": F.col(d) for d in _METRICS.values()}, F.count(F.lit(1)).alias("n"))


def key_gate(df: DataFrame) -> DataFrame:
    """Keys of one model that the other lacks; no row if the two sets are equal."""
    keys = {m: df.where(F.col("model") == m).select(*KEYS) for m in MODELS}
    only = lambda a, b: keys[a].subtract(keys[b]).withColumn("side", F.lit(f"only_{a}"))
    return only("base", "tuned").unionByName(only("tuned", "base"))


def require_matched(df: DataFrame) -> None:
    """Raise if base and tuned differ in their keys, naming the first five of each side: one scan of the rows."""
    sides = {"only_base": "base IS NOT NULL AND tuned IS NULL", "only_tuned": "base IS NULL AND tuned IS NOT NULL"}
    keys = [F.col(k) for k in KEYS]
    rows = ranked(pair_rows(df, ["row_ord"]), [Ranking(n, F.expr(c), [], keys, F.lit(0), 5) for n, c in sides.items()]).orderBy("ranking", "rank").collect()
    found = {s: [tuple(r[k] for k in KEYS) for r in rows if r["ranking"] == s] for s in sides}
    if rows:
        raise ValueError(f"base and tuned keys differ: {found}")
