"""Corpus pipeline: from documents to packed token sequences.

Toxic documents, then documents of low quality go; one document of each near-duplicate group stays;
documents that hold a benchmark item go; the rest is packed. Each stage works on all that the one
before kept; all but the last return the columns of documents. Stages are written as Parquet to the
shared folder between each other.

Columns beyond those of documents pass through with their values, whatever their names; what the operators define for nulls, empty and
repeated rows and very long texts, which every stage takes whole, holds for the stages (see their modules). Ties: of a group's rows the
one of the smallest id stays, and of rows that repeat that id and text any one. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.llm import decontamination, packing, quality, simhash, toxicity
from storyscale.llm.common import checkpointed, delete, ready, table, work_dir


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator uses: its own columns can't clash with theirs, and come back by ``named``."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__input_{i}" for i, c in enumerate(docs.columns)])


def named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, by its names, of rows that an operator made of ``plain`` documents."""
    return kept.select(plain(docs).columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    rows = plain(docs)
    model = toxicity.train(rows, table(ready(spark), sf_dir, "labels"))
    return named(toxicity.score(rows, model).where("predicted = 0"), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted quality rules keep."""
    ready(spark)
    return named(quality.rate(plain(docs)).where("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: near fingerprints, or five-word shingles with similarity 0.8."""
    ready(spark)
    return named(simhash.one_of_each(plain(docs), similar_texts=True), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontamination.matches(plain(docs), table(ready(spark), sf_dir, "benchmark"))
    return named(found.where(F.size("matches") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids."""
    ready(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express fitted models, XXH64 fingerprints or tokenizers: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    root = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"{root}/{name}")
        if before:
            delete(spark, before)
        before = f"{root}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
