"""Exact removal of repeated lines and passages by hashing their units.

A text is cut into paragraphs (at blank lines), lines and sentences, and gives these units:

- line units: each sentence of a line opens one, itself and, while that has fewer than
  ``least_words`` words, the sentences after it in its line; the short rest of a line is
  taken together with what stands before it, counted from the line's end;
- paragraph units: a sentence that goes on over a line break, or lies in a line that falls
  short of ``least_words``, opens one with the sentences after it in its paragraph. Line
  breaks count as any other white space, so it is the same however the lines are wrapped;
- parts of long sentences (over ``LONG`` words, as in lists, verse or text without full
  stops): cuts lie where the hash of a word and the one before is the least among its
  ``NEAR`` neighbours on either side, so that they are the same wherever the words stand;
  each cut opens a unit that goes on over the next cuts to ``least_words``, and the rest
  at the sentence's end is taken with what stands before it.

Words are counted with their length: a letter of a script without spaces is half a word,
32 characters without white space are a further word. Units are normalised (lower case,
white space as one space, none between letters of a script without spaces), digested to
128 bits and grouped over all documents. Of equal units the earliest in rank (doc_id, then
place) stays; the others are cut out of their texts, but for what overlaps the one that
stays. Offsets always are code points of the original text. Paragraphs and lines that
fall short of ``least_words`` altogether, such as headings, stay. A line that loses all of
its text goes with its line break.

Only the first unit of each digest in a text takes part in the grouping; what the text has
again itself is noted where it is read. Digests are aggregated before they are
shuffled, so a unit that a third of all documents share costs each task one row; joining
the repeated ones back is left to a join whose skewed partitions are split. Only ids and
digests take part, not the texts.

Defined results: null text is empty; an empty text stays as it is; repeated rows (same id
and text) are one document and stay alike; a null id ranks first; an empty table gives
an empty result; columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import blocks, id_and_text, mapped, unused
from wardlake.session import written

LEAST_WORDS = 8
#: Units that a task holds as Python objects before it hands them on.
HELD = 100_000
#: Stands for the digest where none is looked for.
NO_DIGEST = bytes(16)
#: Words beyond which a sentence is also cut by its words, and the neighbours that decide on a cut.
LONG, NEAR = 32, 4
_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+\s*|$)")
_STOPS = ".!?。！？"
# scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana and Han
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LENGTHY = re.compile(r"(?<!\S)\S{32}")
_WORD = re.compile(r"\S+")


def _may_be_unspaced(text: str) -> bool:
    """Quickly no for texts of Latin letters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


class Units:
    """The units of one text; weights are in half words."""

    def __init__(self, text: str, least_words: int = LEAST_WORDS):
        self.text, self.least = text, 2 * least_words
        self.unspaced = _may_be_unspaced(text) and _UNSPACED.search(text) is not None
        self.lengthy = self.unspaced or _LENGTHY.search(text) is not None
        self.found: dict[tuple[int, int], bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.unspaced:
            text = _UNSPACED.sub(r" \g<0> ", text)
        return text.lower().split()

    def weight(self, words: list[str]) -> int:
        if not self.lengthy:
            return 2 * len(words)
        return sum(1 if self.unspaced and len(w) == 1 and _UNSPACED.match(w) else 2 + 2 * (len(w) >> 5) for w in words)

    def add(self, start: int, end: int, words: list[str]) -> None:
        if (start, end) not in self.found:
            self.found[start, end] = _digest(words)

    def all(self) -> list[tuple[int, int, bytes]]:
        """Start, end and digest of every unit, in order of their starts."""
        at, lines = 0, []
        for line in self.text.split("\n"):
            pieces = []
            for found in _SENTENCE.finditer(line):
                words = self.words(found.group())
                if words:
                    pieces.append((at + found.start(), at + found.end(), words, self.weight(words)))
            if pieces:
                self.line(pieces)
                lines.append((pieces, line.rstrip()[-1] in _STOPS))
            elif lines:
                self.paragraph(lines)
                lines = []
            at += len(line) + 1
        if lines:
            self.paragraph(lines)
        return sorted((start, end, digest) for (start, end), digest in self.found.items())

    def line(self, pieces: list[tuple[int, int, list[str], int]]) -> None:
        short = False
        for i, (start, end, words, weight) in enumerate(pieces):
            if weight < self.least:
                words = list(words)
                for _, end, more, further in pieces[i + 1 :]:
                    words += more
                    weight += further
                    if weight >= self.least:
                        break
                else:
                    short = True
                    break
            self.add(start, end, words)
        if short:
            self.rest(pieces)

    def rest(self, pieces: list[tuple[int, int, list[str], int]]) -> None:
        """The fewest last pieces that make a unit."""
        weight = 0
        for i in range(len(pieces) - 1, -1, -1):
            weight += pieces[i][3]
            if weight >= self.least:
                self.add(pieces[i][0], pieces[-1][1], [w for p in pieces[i:] for w in p[2]])
                return

    def paragraph(self, lines: list[tuple[list[tuple[int, int, list[str], int]], bool]]) -> None:
        # sentences over line breaks: start, end, words, weight, whether a line break lies inside, whether their line is short
        sentences: list[list] = []
        going = False
        for pieces, stopped in lines:
            short = sum(p[3] for p in pieces[:16]) < self.least and len(lines) > 1
            for start, end, words, weight in pieces:
                if going:
                    before = sentences[-1]
                    if not before[4]:
                        before[2], before[4] = list(before[2]), True
                    before[1] = end
                    before[2] += words
                    before[3] += weight
                    going = False
                else:
                    sentences.append([start, end, words, weight, False, short])
            going = not stopped
        for i, (start, end, words, weight, broken, short) in enumerate(sentences):
            if weight > 2 * LONG:
                self.long(start, end)
            if not broken and not (short and weight < self.least):
                continue
            if weight < self.least:
                words, k = list(words), i
                while weight < self.least and k + 1 < len(sentences):
                    k += 1
                    words += sentences[k][2]
                    weight += sentences[k][3]
                if weight < self.least:
                    self.rest([tuple(s[:4]) for s in sentences[-self.least :]])
                    break
                end = sentences[k][1]
            self.add(start, end, words)

    def long(self, start: int, end: int) -> None:
        text = self.text[start:end]
        if self.unspaced:
            spans = [(m.start() + a, m.start() + b) for m in _WORD.finditer(text) for a, b in self._letters(m.group())]
            words = [text[a:b].lower() for a, b in spans]
            starts = [a for a, _ in spans]
        else:
            words = text.lower().split()
            starts = [m.start() for m in _WORD.finditer(text)]
        if len(words) <= 2 * NEAR:
            return
        own = np.fromiter(map(crc32, " ".join(words).encode("utf-8", "surrogatepass").split(b" ")), np.uint64, len(words))
        value = own * np.uint64(0x9E3779B97F4A7C15)
        value[1:] ^= own[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(29)
        middle = value[NEAR : len(value) - NEAR]
        least = np.ones(len(middle), bool)
        for k in range(1, NEAR + 1):
            least &= middle < value[NEAR - k : len(value) - NEAR - k]
            least &= middle <= value[NEAR + k : len(value) - NEAR + k]
        cuts = [0, *(np.flatnonzero(least) + NEAR).tolist(), len(words)]
        places = [start, *(start + starts[c] for c in cuts[1:-1]), end]
        parts = [words[a:b] for a, b in zip(cuts, cuts[1:])]
        self.line([(a, b, part, self.weight(part)) for a, b, part in zip(places, places[1:], parts)])

    @staticmethod
    def _letters(word: str) -> list[tuple[int, int]]:
        out, at = [], 0
        for m in _UNSPACED.finditer(word):
            if m.start() > at:
                out.append((at, m.start()))
            out.append(m.span())
            at = m.end()
        return out if at == len(word) else [*out, (at, len(word))]


def units(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    return Units(text, least_words).all()


def first_and_again(text: str, least_words: int) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int, int]]]:
    """The units whose digest the text has for the first time; the spans of those that it has again, each with the first's span."""
    seen: dict[bytes, tuple[int, int]] = {}
    first, again = [], []
    for start, end, digest in units(text, least_words):
        if digest in seen:
            again.append((start, end, *seen[digest]))
        else:
            seen[digest] = (start, end)
            first.append((start, end, digest))
    return first, again


def settled(again: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same spans with those that go in any case, as they lie after the first, put together."""
    sure = merged([(start, end) for start, end, _, first_end in again if start >= first_end])
    return [(start, end, -1, 0) for start, end in sure] + [spans for spans in again if spans[0] < spans[3]]


def lost(again: list[tuple[int, int, int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All spans that go, when ``gone`` of the first ones go: a first one that stays keeps what overlaps it."""
    taken = set(gone)
    return gone + [(start, end) for start, end, *first in again if tuple(first) in taken or start >= first[1]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without ``spans``, and what was cut in the end: a line that is left blank goes with its break."""
    spans = merged(spans)
    widened = []
    for start, end in spans:
        line_start = text.rfind("\n", 0, start) + 1
        line_end = text.find("\n", end)
        line_end = len(text) if line_end < 0 else line_end
        if not text[line_start:start].strip() and not text[end:line_end].strip():
            start, end = line_start, min(line_end + 1, len(text))
        widened.append((start, end))
    widened = merged(widened)
    kept, at = [], 0
    for start, end in widened:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), widened


def _spans(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``spans``: what each document loses to earlier ones, and what it has again itself.

    A span with ``first_end`` is a unit that the text has had before, at ``first_start``.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "start", "end", "first_start", "first_end", "high", "low"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            *columns, digests = zip(*rows, strict=True)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((*columns, halves[:, 0], halves[:, 1]), kinds, strict=True)], names
            )

        rows: list[tuple] = []
        for batch in batches:
            for part in blocks(batch, "text"):
                own = zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True)
                for doc_id, text_hash, text in own:
                    first, again = first_and_again(text, least_words)
                    rows += [(doc_id, text_hash, start, end, None, None, digest) for start, end, digest in first]
                    rows += [(doc_id, text_hash, *spans, NO_DIGEST) for spans in settled(again)]
                    if len(rows) >= HELD:
                        yield out(rows)
                        rows.clear()
        if rows:
            yield out(rows)

    found = texts.mapInArrow(run, "doc_id long, text_hash long, start int, end int, first_start int, first_end int, high long, low long")
    place = F.struct("doc_id", "text_hash", "start")
    own = F.col("first_end").isNotNull()
    # a document states each digest once; where only the same row says it twice, nothing goes below
    first = found.where(~own).groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # kept in the shared folder, so that the join below has two plain sides and can split a hot digest
    repeated = written(first.where("n > 1").select("high", "low", "first"), "repeated-units")
    # what a text has again goes along without a partner, spread by its place, so that texts are read for units only twice
    spread = found.withColumn("high", F.when(own, F.xxhash64("doc_id", "text_hash", "start")).otherwise(F.col("high")))
    gone = spread.join(repeated, ["high", "low"], "left").where(own | (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end", "first_start", "first_end")).alias("spans"))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, the text as left over (null: empty), and one column more.

    ``removed`` (``removed_spans``, ``removed_spans_2`` and so on where the name is taken) has
    the spans of the original text that are gone.
    """
    named = unused("removed", docs.columns, "removed_spans")
    key, mark, gone = (unused(n, docs.columns) for n in ("gone_id", "gone_hash", "gone_spans"))
    spans = _spans(docs, least_words, id_col, text_col)
    spans = spans.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), F.col("spans").alias(gone))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(mark))
    joined = docs.join(spans, same, "left").select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(gone).alias(named))
    columns, text_at, kind = docs.columns, docs.columns.index(text_col), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_at):
                texts_left, removed = [], []
                for own, spans in zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if not spans:
                        texts_left.append(own)
                        removed.append([])
                        continue
                    first = [(s["start"], s["end"]) for s in spans if s["first_end"] is None]
                    again = [(s["start"], s["end"], s["first_start"], s["first_end"]) for s in spans if s["first_end"] is not None]
                    left, gone_spans = cut(own, lost(again, first))
                    texts_left.append(left)
                    removed.append([{"start": a, "end": b} for a, b in gone_spans])
                kept = [pa.array(texts_left, pa.string()) if k == text_at else c for k, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(removed, kind)], part.schema.names)

    return mapped(joined, apply, "array<struct<start: int, end: int>>").toDF(*columns, named)
