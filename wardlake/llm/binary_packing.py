"""Packing by power-of-two decomposition: a document of n tokens becomes pieces of binary lengths.

The pieces of a document are as many of the largest length as it fills, then one for
each set bit of what is left, falling. Each piece is a sequence of its own, so that no
sequence crosses documents and none needs padding. Sequences of equal length share a
bucket: their ids carry the bucket in the upper bits, so a bucket's sequences are a range
of ids, and ``write_buckets`` stores one folder per length, from which batches of equal
sequences are read.

Token ids come from the ``tokenizers`` library. Its words are separated by white space,
so texts are cut there and each word is handed to the library once; a worker remembers
the ids of the words it has seen (at most ``REMEMBERED``, then the memory starts anew).
Words of plain letters go to the library's model directly, all others through its whole
chain of normaliser, splitter and model. Texts are taken in windows, so a very long text
is never split whole.

Nothing is shuffled. Ids of sequences are the input split and a running number in it,
which a repeated task gives again.

Defined results: null text is empty; an empty text is its end id alone, one sequence of
length 1; repeated rows are packed each, as sequences of their own; a null doc_id stays
null; names of the vocabulary's special tokens inside texts are read as the library does
by default, as those tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks, id_and_text

LARGEST = 2048
END = 1
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of a text that are split into words at once.
WINDOW = 4_000_000
#: Bits of a sequence id below the bucket: the split and the number in it.
NUMBER_BITS, SPLIT_BITS = 34, 24
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
# lower-case letters that no normalisation changes, and a run of marks that no letter joins
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """The ids of texts, word by word."""

    def __init__(self, vocabulary: str, end: int = END):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.end = end.to_bytes(4, "little")
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.seen: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _model(self, letters: str) -> bytes:
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(mapped)])

    def _known(self, letters: str) -> bytes:
        ids = self.plain.get(letters)
        if ids is None:
            ids = self.plain[letters] = self._model(letters)
        return ids

    def _chain(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(words, add_special_tokens=False)]

    def _learn(self, wanted: set[bytes]) -> None:
        if len(self.seen) + len(wanted) > REMEMBERED:
            self.seen.clear()
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        others, places = [], []
        for word in wanted.difference(self.seen):
            text = word.decode("utf-8", "replace")
            found = _PLAIN.fullmatch(text)
            if found:
                ids = self._known(found[1])
                self.seen[word] = ids + self._known(found[2]) if found[2] else ids
            else:
                others.append(text)
                places.append(word)
        self.seen.update(zip(places, self._chain(others), strict=True))

    def _windows(self, raw: bytes) -> Iterator[bytes]:
        at = 0
        while len(raw) - at > WINDOW:
            space = _SPACE.search(raw, at + WINDOW)
            stop = space.end() if space else len(raw)
            yield raw[at:stop]
            at = stop
        yield raw[at:]

    def _ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.seen.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        raws = [t.encode("utf-8", "replace") for t in texts]
        if len(raws) == 1 and len(raws[0]) > WINDOW and not self._named(raws[0]):
            parts = []
            for window in self._windows(raws[0]):
                words = window.lower().split()
                self._learn(set(words))
                parts.append(self._ids(words))
            return [b"".join([*parts, self.end])]
        found = [None if self._named(raw) else raw.lower().split() for raw in raws]
        self._learn(set().union(*(words for words in found if words)))
        # the name of a special token: the library finds it before anything else
        return [(self._chain([text])[0] if words is None else self._ids(words)) + self.end for text, words in zip(texts, found, strict=True)]

    def _named(self, raw: bytes) -> bool:
        return any(s in raw for s in self.special)


def lengths(tokens: int, largest: int = LARGEST) -> list[int]:
    """The binary lengths of a document's pieces, falling."""
    left = tokens % largest
    return [largest] * (tokens // largest) + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


_held: dict[tuple[int, int], Words] = {}


def _words(vocabulary, end: int) -> Words:
    key = (hash(vocabulary.value), end)
    if key not in _held:
        _held.clear()
        _held[key] = Words(vocabulary.value, end)
    return _held[key]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def decompose(
    docs: DataFrame, vocabulary_path: str, largest: int = LARGEST, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: its place in its document, its ids (binary) and its sequence.

    ``largest`` is a power of two. ``end`` closes every document.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError("the largest length must be a power of two")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary, end)
        split = TaskContext.get().partitionId()
        if split >> SPLIT_BITS:
            raise ValueError("too many input splits")
        number = 0
        for batch in batches:
            for part in blocks(batch, "text"):
                own = part.column("doc_id").to_pylist()
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for doc_id, ids in zip(own, words.encode(part.column("text").to_pylist()), strict=True):
                    at, count = 0, len(ids) // 4
                    for length in lengths(count, largest):
                        sequence = (length.bit_length() - 1) << (NUMBER_BITS + SPLIT_BITS) | split << NUMBER_BITS | number
                        row = (doc_id, at, length, ids[4 * at : 4 * (at + length)], count, sequence)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        at += length
                        number += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                offsets = pa.array(np.zeros(len(rows[0]), np.int64))
                yield pa.RecordBatch.from_arrays([*columns, offsets], [c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder ``length=2^k`` per bucket, each holding equal sequences only."""
    pieces.write.partitionBy("length").parquet(path)


def batches(pieces: DataFrame, batch_tokens: int, largest: int = LARGEST) -> DataFrame:
    """``pieces`` with ``bucket`` (their length) and ``batch``: sequences of one bucket and split, ``batch_tokens`` each.

    Batches are numbered within a bucket and split, so no count goes over splits; the last
    batch of each may be smaller.
    """
    nth = F.row_number().over(_within()) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    return pieces.withColumn("bucket", F.col("length")).withColumn("batch", F.floor(nth / per))


def _within():
    from pyspark.sql.window import Window

    return Window.partitionBy("length", F.shiftright("sequence_id", NUMBER_BITS)).orderBy("sequence_id")


def summary(pieces: DataFrame) -> DataFrame:
    """One row per piece without its ids: ``ids_crc32`` (unsigned, over 32-bit little-endian ids) stands for them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
