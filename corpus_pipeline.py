"""From raw documents to packed training sequences, one stage after the other.

Every stage reads all that the one before it kept and returns the columns of
``documents``; the last returns the packing. Null and empty texts pass the filters by
their scores, are never near copies, and are packed as pieces of length 0; an empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import jaccard_join, packing, quality, repeated_units, toxicity
from wardlake.llm.common import held_out, table
from wardlake.session import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return toxicity.without_toxic(docs, model)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return quality.with_quality(docs, network)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; ``n_chars`` becomes the length of what is left."""
    left = repeated_units.without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_classifier", reject_low_quality),
    ("ngram_jaccard_join", one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The classifiers are fitted, so SQL can't express the rows; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
