"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import licences, lines, mixing, ngram_join, oracles, phrases, pivots, secrets, sharding, tokens, toxicity
from vecloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(of(*base)), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_find_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(table(spark, sf_dir, "documents"), threshold=0.8)
    names = F.array_join(F.transform("licences", lambda x: x["licence"]), ",")
    best = F.coalesce(F.array_max(F.transform("licences", lambda x: x["dice"])), F.lit(0.0))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), names.alias("licences"), best.alias("best_dice"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, near=8)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op6_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.find_lines(table(spark, sf_dir, "documents"), percent=80, least_chars=1)  # every line that is not blank
    gone = F.array_except("long_lines", "kept_lines")
    return found.select("doc_id", "n_lines", F.size("long_lines").cast("long").alias("n_long"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_find_secrets": op2_find_secrets,
        "op3_ngram_join": op3_ngram_join,
        "op4_find_licences": op4_find_licences,
        "op5_decontaminate": op5_decontaminate,
        "op6_dedup_lines": op6_dedup_lines,
        "op7_near_vectors": op7_near_vectors,
        "op8_toxicity": op8_toxicity,
        "op9_shard": op9_shard,
        "op10_token_ids": op10_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_find_secrets": oracles.find_secrets(),
        "op3_ngram_join": oracles.ngram_join(4, 85),
        "op5_decontaminate": oracles.decontaminate(10, 8),
    }
