"""The opN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import chat, decontaminate, jaccard, lm, mixing, pii, quality, repeats, sst, toxicity
from citeloom.llm.common import shared_folder, table
from citeloom.llm.oracles import ORACLES

#: A conversation whose texts hold the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat.chat_digest(turns.unionByName(extra))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", "slot", "position", "in_mix")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links", "group_id")


#: A deployment passes its own key; this one makes the query repeatable.
QUERY_KEY = b"citeloom query key"


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), QUERY_KEY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_encoder() -> sst.Encoder:
    return sst.encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)


def op9_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sst.write_shards(table(spark, sf_dir, "documents"), shared_folder(spark, "sst"), byte_encoder)
    return sst.read_shards(manifest).drop("position")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.find_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_score": op2_lm_score,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mix": op5_source_mix,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_decontaminate": op8_decontaminate,
    "op9_sst_shards": op9_sst_shards,
    "op10_suffix_dedup": op10_suffix_dedup,
}

__all__ = ["ORACLES", "QUERIES"]
