"""The bounded, labelled sample that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import id_and_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: DataFrame | None, rows: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0 or 1) of at most ``rows`` labelled documents.

    The documents are those with the smallest hashes of their ids, so the choice does not
    depend on partitioning. ``learn`` is a condition on the labels' ``doc_id``. A document
    with several labels has the larger one; labels other than 0 and 1 and rows without an
    id are left out. The chosen ids, at most ``rows``, are broadcast.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")
