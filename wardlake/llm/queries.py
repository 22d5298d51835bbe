"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import binary_packing, byte_bpe, chat, edit_embedding, jaccard_join, merkle, packing, ppm, quality, repeated_units, toxicity
from wardlake.llm import vector_graph, whitening
from wardlake.llm.common import held_out, table
from wardlake.llm.oracle import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.with_next(table(spark, sf_dir, "documents"))


def verdicts(scored: DataFrame, parts: int, remainder: int) -> DataFrame:
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out("doc_id", parts, remainder).alias("held_out"), "score", predicted.alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out("doc_id", 3, 1))
    return verdicts(toxicity.score(docs, model), 3, 1)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op5_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_units.without_repeats(docs)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return verdicts(quality.score(docs, quality.fit(docs, labels, ~held_out("doc_id", 4, 2))), 4, 2)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_turns(given.unionByName(extra)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return binary_packing.summary(binary_packing.decompose(table(spark, sf_dir, "documents"), vocabulary))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    without_breaks = F.replace("text", F.lit("\n"), F.lit(""))
    tampered = F.when(F.coalesce(~held_out("doc_id", 2, 0), F.lit(True)) | F.col("doc_id").isNull(), F.col("text")).otherwise(without_breaks)
    return merkle.checked(merkle.manifest(docs, claimed=tampered))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_edit_embedding": op2_edit_embedding,
    "op3_toxicity": op3_toxicity,
    "op4_ppm": op4_ppm,
    "op5_vector_graph": op5_vector_graph,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_whitening": op11_whitening,
    "op12_binary_packing": op12_binary_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}
