"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.llm import decontamination, elias_fano, interactions, licenses, lm, packing, quality, runs, sharding, simhash, token_counts, topk, toxicity
from storyscale.llm.common import ready, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.matches(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", F.inline("matches"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs.withColumn("edits", token_counts.scripted_edits()))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, carry=["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, lm.train(docs.where(~lm.held_out())))
    return out.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = elias_fano.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's rules and base look at, before any fit."""
    out = quality.with_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = runs.find(docs, carry=["doc_id"]).withColumn("most", runs.foremost(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        sha(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _on_ready(f: Callable) -> Callable:
    return wraps(f)(lambda spark, sf_dir: f(ready(spark), sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _on_ready(f) for f in (op1_decontamination, op2_token_counts, op3_licenses, op4_sharding, op5_toxicity, op6_lm, op7_packing, op8_elias_fano, op9_quality, quality_counts, op10_simhash, op11_runs, op12_interactions, op13_topk)}


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the others (64-bit hash draws, fitted posteriors, tokenizers, CRC): they are tested against brute force."""
    return {"quality_counts": quality.COUNTS_SQL, "op12_interactions": interactions.AUDIT_SQL, "op13_topk": topk.SEARCH_SQL}
