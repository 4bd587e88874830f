"""Relations of the engine over the driver's tables.

The driver has no generated stories, so its documents stand in: source is the prompt, blocks of 40
ids the generation, and the model is drawn from the id. All is computed row by row, so the mapping
needs no shuffle (a small table is dealt out to all cores first); (prompt, generation) has two documents on average, which gives matched and
unmatched pairs and repeated keys. Recorded judge scores are stand-ins made from labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.functions.lexicon import TARGET_LISTS
from storyscale.sources.shared import spread

KEYS = ("prompt_id", "generation_id", "seed")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_ord, model, prompt_id, generation_id, seed, target_phonics, prompt, story."""
    block = F.floor(F.col("doc_id") / 40)
    target = F.get(F.array(*map(F.lit, TARGET_LISTS)), (F.substring("source", 4, 9).cast("int") % len(TARGET_LISTS)))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        F.col("doc_id").alias("row_ord"),
        F.when((F.col("doc_id") * 7919) % 1009 % 2 == 0, "base").otherwise("tuned").alias("model"),
        F.col("source").alias("prompt_id"),
        block.cast("string").alias("generation_id"),
        (block + 1000).cast("string").alias("seed"),
        target.alias("target_phonics"),
        F.concat(F.lit("Write a decodable story: "), target).alias("prompt"),
        F.col("text").alias("story"),
    )


def recorded_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_ord and the recorded scores of the judged rows (dimensions of both judge versions)."""
    q, t = F.col("quality").cast("int"), F.col("toxic").cast("int")
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_ord"),
        (q + 1 - t).alias("spec_adherence_score"),
        (2 * q).alias("task_quality_score"),
        (2 - t - (1 - q)).alias("robustness_score"),
        (q + (1 - t)).alias("overall_spec_adherence_score"),
        (2 * q * (1 - t)).alias("decodability_adherence_score"),
        ((F.col("doc_id") % 3).cast("int") * q).alias("target_phonics_pattern_emphasis_score"),
        (2 - 2 * t).alias("coherence_score"),
        (1 + q).alias("narrative_completeness_score"),
    )


def values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small inline relation of strings."""
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def quoted(rows: list[tuple]) -> str:
    """The same relation as VALUES for an oracle."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def as_label(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
