"""Quality: the probability of a byte-level convolutional network over whole documents.

The network (see ``convolution``) is fitted on the driver on the whole texts of a bounded
sample of labelled documents: ``TRAINING_ROWS`` of them at most, and as many of these,
shortest first, as have ``TRAINING_BYTES`` in all; no text is cut. Scoring covers every
byte of every document. A label, the language, the source and the id are never inputs.

Defined results: null and empty texts are one chunk of padding and have that chunk's
score; repeated rows score alike; an empty table gives an empty result; with no labelled
rows, or one class only, every score is the shrunken rate of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks, id_and_text, keep_rows
from wardlake.llm.convolution import Network, chunks_of
from wardlake.llm.labelled import labelled_sample
from wardlake.session import written

#: Labelled documents that the network is fitted on, and their bytes, at most.
TRAINING_ROWS, TRAINING_BYTES = 3_000, 48_000_000


def fit(docs: DataFrame, labels: DataFrame, learn=None, rows: int = TRAINING_ROWS, most: int = TRAINING_BYTES) -> Network | float:
    """The fitted network, or one score for all where there is nothing to learn."""
    sample = written(labelled_sample(docs, labels, "quality", learn, rows), "quality-sample")
    sizes = sorted(r["n"] for r in sample.select(F.octet_length("text").alias("n")).collect())  # a number for each row of the sample
    fitting = [n for n, total in zip(sizes, accumulate(sizes), strict=True) if total <= most]
    if len(fitting) < len(sizes):  # those as long as the first that is too much are left out together
        sample = sample.where(F.octet_length("text") < sizes[len(fitting)])
    seen = sample.select("doc_id", "label", "text").collect()
    seen.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in seen], np.float32)
    if len(y) < 8 or y.min() == y.max():
        return float(y.sum() / (len(y) + 1)) if len(y) else 0.0
    return Network.fresh().fit(*chunks_of([r["text"].encode("utf-8", "replace") for r in seen]), y)


def score(docs: DataFrame, network: Network | float) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = [t.encode("utf-8", "replace") for t in part.column("text").to_pylist()]
                scores = np.full(len(texts), network) if isinstance(network, float) else network.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def with_quality(docs: DataFrame, network: Network | float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that score ``threshold`` or more; all of them where nothing could be learned."""
    if isinstance(network, float):
        return docs
    return keep_rows(docs, lambda: lambda texts: network.scores([t.encode("utf-8", "replace") for t in texts]), lambda scores: scores >= threshold, text_col)
