"""Reading the tables and walking Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one step inside a task holds as Python objects.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other name can clash; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unused(name: str, columns: list[str], *others: str) -> str:
    """``name``, or the first of ``others``, or the last of these with a number, that no column has (in any case)."""
    taken = {c.lower() for c in columns}
    names = (name, *others)
    for candidate in (*names, *(f"{names[-1]}_{k}" for k in range(2, len(taken) + 3))):
        if candidate.lower() not in taken:
            return candidate
    raise ValueError("no name is left")


def fold(key: str | Column, parts: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``parts`` (null key: null)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % parts


def held_out(key: str | Column, parts: int, remainder: int) -> Column:
    """Whether a row is kept from learning; rows without a key are not."""
    return F.coalesce(fold(key, parts) == remainder, F.lit(False))


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], last: str | None = None) -> DataFrame:
    """``mapInArrow`` that keeps the schema, for columns of any names: batches name them by place.

    ``last`` is the type that the last column gets instead of its own.
    """
    plain = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    fields = list(plain.schema.fields)
    if last:
        fields[-1] = T.StructField(fields[-1].name, T.DataType.fromDDL(last))
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*rows.columns)


def blocks(batch: pa.RecordBatch, column: str | int, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each; a longer value stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def keep_rows(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], keep, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score meets ``keep``; null text is scored as empty.

    ``scorer`` makes, in a task, the function from texts to scores.
    """

    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            for part in blocks(batch, text_at):
                yield part.filter(pa.array(keep(score([t or "" for t in part.column(text_at).to_pylist()]))))

    return mapped(docs, run)
