"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text. At every time step the character under
the pointer is written, and a coin that all texts share, drawn from the time and the
character, says whether the pointer moves on. Two texts whose walks have met keep step
while their characters agree, and after an edit they meet again soon, so that few edits
change few written characters: edit distance becomes Hamming distance.

The fingerprint samples ``SLOTS`` times of the walk, over the whole of it, and keeps a
byte of each written character. The times depend on the walk's length only through
running minima of a hash, so that texts of nearly equal length share nearly all of them.
The walks of a block advance together, one character of each text per numpy step; where
fewer than ``FEW`` texts of the block are that long, each goes on alone.

``linked`` finds like fingerprints: equal ones are one class; bands of sampled slots
propose pairs, each class with the first of its band's group; the share of agreeing
slots verifies them.

Defined results: null text is empty; the fingerprint of an empty text is all zeros, and
two such texts are alike (1.0); equal texts have equal fingerprints; rows are ordered by
doc_id (null first), equal ids by text; repeated rows follow each other; with one row
alone, it is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import id_and_text

SLOTS = 128
PERIOD = 1024  # the coins repeat after so many steps
CLASSES = 256
#: Characters whose walks advance together in one task.
BLOCK = 6_000_000
#: Walks that are worth a numpy step.
FEW = 64
#: Rows in a run of neighbours that one task walks through, on average, and runs at most.
RUN_ROWS, RUNS = 2_000, 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64, its published constants)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stays() -> np.ndarray:
    """For each class of characters and time (modulo PERIOD), the steps until the pointer moves on."""
    coins = (_mix(np.arange(CLASSES * PERIOD)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    coins[:, -1] = True
    place = np.arange(PERIOD)
    heads = np.where(coins, place, PERIOD - 1)
    return (np.minimum.accumulate(heads[:, ::-1], axis=1)[:, ::-1] - place + 1).astype(np.int32)


class Walks:
    """Embeds and samples; holds the tables that all texts share."""

    def __init__(self):
        self.stays = _stays().ravel()
        self.listed = self.stays.tolist()
        self.best = np.zeros((0, SLOTS), np.int64)

    def times(self, length: int) -> np.ndarray:
        """The sampled time of each slot in a walk of ``length`` steps; -1 where the walk is too short for it."""
        rounds = -(-length // SLOTS)
        if rounds > len(self.best):
            many = max(1024, 2 ** math.ceil(math.log2(rounds)))
            value = _mix(np.arange(many * SLOTS) + (1 << 40)).reshape(many, SLOTS)
            least = np.minimum.accumulate(value, axis=0)
            own = np.where(value == least, np.arange(many)[:, None], 0)
            self.best = np.maximum.accumulate(own, axis=0)
        slot = np.arange(SLOTS)
        counts = (length - slot + SLOTS - 1) // SLOTS
        return np.where(counts > 0, self.best[np.maximum(counts, 1) - 1, slot] * SLOTS + slot, -1)

    def _alone(self, classes: np.ndarray, ends: np.ndarray, at: int, stop: int, now: int) -> None:
        """Walks through the characters from ``at`` to ``stop`` of one text."""
        listed, last = self.listed, PERIOD - 1
        while at < stop:
            part = classes[at : min(stop, at + 100_000)].tolist()
            written = []
            for c in part:
                now += listed[c + (now & last)]
                written.append(now)
            ends[at : at + len(part)] = written
            at += len(part)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of SLOTS bytes for each text; 0 where a slot has no time."""
        out = np.zeros((len(texts), SLOTS), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = ((flat ^ (flat >> 8) * np.uint32(37)) & np.uint32(CLASSES - 1)).astype(np.int32) * np.int32(PERIOD)
        start = np.cumsum(sizes) - sizes
        ends = np.empty(len(flat), np.int64)
        time = np.zeros(len(texts), np.int64)
        # texts with more than i characters are the first active[i]
        active = len(texts) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        at = start.copy()
        together = int(np.searchsorted(-active, 1 - FEW))  # characters that at least FEW texts have
        for many in active[:together].tolist():
            now, place = time[:many], at[:many]
            now += self.stays[classes[place] + (now & (PERIOD - 1))]
            ends[place] = now
            place += 1
        for k in range(int(active[together]) if together < len(active) else 0):
            self._alone(classes, ends, int(start[k]) + together, int(start[k] + sizes[k]), int(time[k]))
        slot = np.arange(SLOTS, dtype=np.uint64)
        for k, i in enumerate(order.tolist()):
            size = int(sizes[k])
            if not size:
                break
            own = ends[start[k] : start[k] + size]
            times = self.times(int(own[-1]))
            written = flat[start[k] + np.minimum(np.searchsorted(own, times, side="right"), size - 1)].astype(np.uint64)
            kept = (_mix(written * np.uint64(SLOTS) + slot) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
            out[i] = np.where(times >= 0, kept, 0)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of agreeing slots among those that either has."""
    either = ((a > 0) | (b > 0)).sum(-1)
    return np.where(either > 0, ((a == b) & (a > 0)).sum(-1) / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the text's characters (rounded down) replaced by the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hex) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        for batch in batches:
            texts, start, held = batch.column("text").to_pylist(), 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or held >= BLOCK:
                    if i > start:
                        made = [row.tobytes().hex() for row in walks.fingerprints(texts[start:i])]
                        ids = batch.column("doc_id").slice(start, i - start)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.string())], ["doc_id", "fingerprint"])
                    start, held = i, 0
                held += len(texts[i]) if i < len(texts) else 0

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with likeness to its edited text and to the next row by id (the columns of SCHEMA).

    Rows are dealt into runs of neighbouring ids; the first row of a run also goes to the
    end of the run before, so each text is shuffled once. What comes to the driver are the
    ids between runs, at most RUNS.
    """
    texts = id_and_text(docs, id_col, text_col)
    seen = texts.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("first")).first()
    runs = min(RUNS, max(1, math.ceil(seen["ids"] / RUN_ROWS)))
    parts = [k / runs for k in range(1, runs)]
    found = texts.agg(F.percentile_approx("doc_id", parts, 20 * runs).alias("at")).first()["at"] if parts else []
    bounds = np.unique(np.array([b for b in found or [] if b > seen["first"]], np.int64))
    nameless, first = seen["n"] > seen["ids"], seen["first"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            run = np.where(missing, 0, np.searchsorted(bounds, known, side="right"))
            is_first = missing if nameless else ~missing & (known == (first if first is not None else 0))
            opens = ~missing & (run > 0) & (known == bounds[np.maximum(run, 1) - 1]) if len(bounds) else np.zeros(len(run), bool)
            for rows, to, late in ((np.arange(len(run)), run, False), (np.flatnonzero(opens), run - 1, True), (np.flatnonzero(is_first), np.full(len(run), len(bounds)), True)):
                if len(rows):
                    part = batch if not late else batch.take(pa.array(rows))
                    columns = [pa.array(to[rows], pa.int64()), pa.array(np.full(len(rows), late)), part.column("doc_id"), part.column("text")]
                    yield pa.RecordBatch.from_arrays(columns, ["run", "late", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()

        def out(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            own = walks.fingerprints([t for _, t in rows])
            changed = [edited(rows[k][1], rows[k + 1][1]) for k in range(len(rows) - 1)]
            theirs = walks.fingerprints(changed)
            columns = (
                [i for i, _ in rows[:-1]], [len(t) for _, t in rows[:-1]],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                [f.tobytes().hex() for f in own[:-1]], [f.tobytes().hex() for f in theirs],
                likeness(own[:-1], theirs), likeness(own[:-1], own[1:]),
            )
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, COLUMNS.values(), strict=True)], list(COLUMNS))

        rows: list[tuple[int | None, str]] = []
        held, current, closed = 0, None, False
        for batch in batches:
            for run, late, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if run != current:
                    if len(rows) > 1:
                        yield out(rows)
                    rows, held, current, closed = [], 0, run, False
                if closed:
                    continue
                closed = late
                rows.append((doc_id, text))
                held += len(text)
                if held >= BLOCK and len(rows) > 1:
                    yield out(rows)
                    rows, held = rows[-1:], len(text)
        if len(rows) > 1:
            yield out(rows)

    dealt = texts.mapInArrow(deal, "run long, late boolean, doc_id long, text string")
    ordered = dealt.repartition("run").sortWithinPartitions("run", "late", F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(compare, SCHEMA)


def linked(fingerprints: DataFrame, least: float = 0.8, bands: int = 32, slots: int = 4) -> DataFrame:
    """Verified pairs of unlike fingerprints: ``fingerprint``, ``near`` (the first of a band's group) and ``likeness``.

    Rows of equal fingerprints are one class. Each band takes ``slots`` of the slots, chosen by
    a hash; a class meets only the first class of each of its groups, so no group is expanded
    into its pairs.
    """
    chosen = np.argsort(_mix(np.arange(bands * SLOTS).reshape(bands, SLOTS)), axis=1)[:, :slots]
    keys = [F.concat(F.lit(f"{b}:"), *(F.substring("fingerprint", int(2 * s + 1), 2) for s in row)) for b, row in enumerate(chosen)]
    classes = fingerprints.select("fingerprint").where(~F.col("fingerprint").rlike("^0*$")).distinct()
    banded = classes.select("fingerprint", F.explode(F.array(*keys)).alias("band"))
    firsts = banded.groupBy("band").agg(F.min("fingerprint").alias("near"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(firsts, "band").where("fingerprint != near").select("fingerprint", "near").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(bytes.fromhex("".join(batch.column(k).to_pylist())), np.uint8).reshape(-1, SLOTS) for k in (0, 1)]
                values = pa.array(likeness(*sides), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["fingerprint", "near", "likeness"])

    return pairs.mapInArrow(run, "fingerprint string, near string, likeness double").where(F.col("likeness") >= least)
