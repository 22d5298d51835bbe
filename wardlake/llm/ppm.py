"""Document probabilities by prediction by partial matching, with a word model as base.

The model is pretrained on the documents that are learned from; ``ppm_model`` has its
arithmetic. It lives in tables: nothing of it but what has a bound by its kind (the
grams of up to three bytes) is held in one place.

1. Documents are written once, in blocks of neighbouring rows.
2. Each block reports its distinct grams and words with their counts; summed over all
   blocks they are the trie's nodes of the highest order, and the vocabulary.
3. Grams are dealt by the last three bytes of their contexts. A task then has all nodes
   of the higher orders below such a context, at most 256 to the third power of each, and
   gives every gram its probability. Lower orders come from the broadcast table.
4. Each block gets back the values of its own grams and words, and scores its documents.

Words are known by 63-bit hashes. Defined results: null text is empty; an empty text is
its end alone; with nothing to learn from all symbols are equally likely, and the base
gives every token the probability 1; repeated rows count and score each; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks, id_and_text
from wardlake.llm.ppm_model import LOW, Level, grams, levels, log10_probability
from wardlake.session import shared_folder, written

ORDER = 5
#: Characters of a block, about.
BLOCK_CHARS = 30_000_000
#: Grams that a task resolves together, about.
RESOLVED = 400_000
_LOW_MASK = (1 << 8 * (LOW + 1)) - 1
_CONTEXT_MASK = (1 << 8 * (LOW + 1)) - 1


def word_keys(words: list[bytes]) -> np.ndarray:
    """Negative 64-bit integers from 63-bit hashes; grams are positive."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (hashes | np.uint64(1 << 63)).view(np.int64)


def _blocked(docs: DataFrame, limit: int) -> DataFrame:
    """The documents with ``block``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], [*part.schema.names, "block"])
                held += part.column("text").nbytes
                if held >= limit:
                    block, held = block + 1, 0

    spark = docs.sparkSession
    target = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, "doc_id long, text string, held_out boolean, block long")
    made.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(made.schema).parquet(target)


class _Tally:
    """Distinct grams and words of one block with their counts among the documents that are learned from.

    Grams are settled every few texts into one sorted list, so that a block's grams are never held whole.
    """

    def __init__(self, order: int):
        self.order = order
        self.words: Counter[bytes] = Counter()
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.size = 0

    def add(self, raw: bytes, learn: bool) -> None:
        words = raw.split()
        self.words.update(words if learn else dict.fromkeys(words, 0))
        self.waiting[learn].append(grams(raw, self.order))
        self.size += len(raw)
        if self.size >= 2_000_000:
            self.settle()

    def settle(self) -> None:
        for learn, waiting in self.waiting.items():
            if waiting:
                keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts * learn])
                order = np.argsort(keys, kind="stable")  # two sorted runs
                keys, counts = keys[order], counts[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        self.size = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        words = word_keys(list(self.words))
        counts = np.fromiter(self.words.values(), np.int64, len(self.words))
        return np.concatenate([self.keys, words]), np.concatenate([self.counts, counts])


def _tallied(blocked: DataFrame, order: int) -> DataFrame:
    """``block``, ``key`` and ``count`` of the distinct grams and words of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally = None, _Tally(order)

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.rows()
            for at in range(0, len(keys), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[part]), current)), pa.array(keys[part]), pa.array(counts[part])], ["block", "key", "count"]
                )

        for batch in batches:
            for part in blocks(batch, "text"):
                rows = zip(*(part.column(c).to_pylist() for c in ("block", "text", "held_out")), strict=True)
                for block, text, held_out in rows:
                    if block != current:
                        yield from out()
                        current, tally = block, _Tally(order)
                    tally.add(text.encode("utf-8", "surrogatepass").lower(), not held_out)
        yield from out()

    return blocked.select("block", "text", "held_out").mapInArrow(run, "block long, key long, count long")


def _low_levels(totals: DataFrame) -> list[Level]:
    """The levels up to order LOW: at most 256 ** (LOW + 1) grams come to the driver."""
    low = totals.where("key >= 0 and total > 0").groupBy(F.col("key").bitwiseAND(_LOW_MASK).alias("gram")).agg(F.sum("total").alias("total"))
    table = low.toPandas()
    keys, counts = table["gram"].to_numpy(np.int64), table["total"].to_numpy(np.int64)
    return levels(keys, counts, range(LOW + 1), [])


def _values(totals: DataFrame, low, order: int) -> DataFrame:
    """``key`` and ``value``: a gram's log10 probability, a word's count."""
    context = F.shiftright("key", 8).bitwiseAND(_CONTEXT_MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            seen = counts > 0
            ladder = levels(keys[seen], counts[seen], range(LOW + 1, order + 1), low.value)
            value = log10_probability(keys, ladder).astype(np.float32).astype(float)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(value)], ["key", "value"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("key", "total")))
            if sum(len(k) for k, _ in held) >= RESOLVED:
                keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
                own = (keys >> 8) & _CONTEXT_MASK
                last = int(np.searchsorted(own, own[-1]))  # the last context may go on in the next batch
                held = [(keys[last:], counts[last:])]
                if last:
                    yield out(keys[:last], counts[:last])
        if held:
            yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    own = totals.where("key >= 0").withColumn("context", context)
    resolved = own.repartition("context").sortWithinPartitions("context").select("key", "total").mapInArrow(run, "key long, value double")
    return resolved.unionByName(totals.where("key < 0 and total > 0").select("key", F.col("total").cast("double").alias("value")))


class Table:
    """Values of integer keys, found by hashing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = keys[order], values[order]
        size = 1 << (64 - int(self.bits))
        self.start = np.searchsorted(slots[order], np.arange(size)).astype(np.int32)
        self.longest = int(np.bincount(slots, minlength=1).max()) if len(keys) else 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def get(self, wanted: np.ndarray, absent: float) -> np.ndarray:
        out = np.full(len(wanted), absent)
        if not len(self.keys):
            return out
        at, todo = self.start[self._slot(wanted)].astype(np.int64), None
        for step in range(self.longest):
            place = np.minimum((at if todo is None else at[todo]) + step, len(self.keys) - 1)
            own = wanted if todo is None else wanted[todo]
            hit = self.keys[place] == own
            if todo is None:
                out[hit] = self.values[place[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = self.values[place[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
        return out


def _scored(blocked: DataFrame, mine: DataFrame, order: int) -> DataFrame:
    """Per document: words, known words, the sum of log10(c + 1) over words, and the model's log10 probability."""
    names = ["doc_id", "held_out", "words", "known", "logs", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        keys, numbers = values.column("key").to_numpy(), values.column("value").to_numpy()
        is_gram = keys >= 0
        chances, counts = Table(keys[is_gram], numbers[is_gram]), Table(keys[~is_gram], numbers[~is_gram])
        known_logs: dict[bytes, float] = {}
        rows: list[tuple] = []
        flags = docs.column("held_out").to_pylist()
        for doc_id, held_out, text in zip(docs.column("doc_id").to_pylist(), flags, docs.column("text"), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass").lower()
            words = raw.split()
            new = [w for w in set(words) if w not in known_logs]
            known_logs.update(zip(new, np.log10(counts.get(word_keys(new), 0.0) + 1).tolist(), strict=True))
            logs = np.fromiter(map(known_logs.__getitem__, words), float, len(words))
            own = grams(raw, order)
            score = sum(float(chances.get(own[at : at + 1_000_000], np.nan).sum()) for at in range(0, len(own), 1_000_000))
            rows.append((doc_id, held_out, len(words), int(np.count_nonzero(logs)), float(logs.sum()), score))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    together = blocked.groupBy("block").cogroup(mine.groupBy("block"))
    return together.applyInArrow(run, "doc_id long, held_out boolean, words long, known long, logs double, score double")


def score(
    docs: DataFrame,
    held_out: Column,
    order: int = ORDER,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``held_out`` is a condition on ``doc_id``; rows that meet it are not learned from.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out)
    blocked = _blocked(texts, block_chars)
    tallied = _tallied(blocked, order)
    totals = written(tallied.groupBy("key").agg(F.sum("count").alias("total")), "ppm-totals")
    low = docs.sparkSession.sparkContext.broadcast(_low_levels(totals))
    mine = tallied.select("block", "key").join(_values(totals, low, order), "key")
    scored = written(_scored(blocked, mine, order), "ppm-scores")

    # three numbers come back: documents and words learned from, and different words
    learned = scored.where("not held_out").agg(F.count("*").alias("docs"), F.sum("words").alias("words")).first()
    kinds = totals.where("key < 0 and total > 0").count()
    ends = learned["docs"]
    all_tokens = (learned["words"] or 0) + ends
    room = F.log10(F.lit(float(all_tokens + kinds + (ends > 0) + 1)))
    tokens = F.col("words") + 1
    return scored.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.log10(F.lit(float(ends + 1))) - tokens * room).alias("base_score"), "score",
    )
