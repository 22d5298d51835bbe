"""Toxicity: boosted trees over dense text features, with isotonic calibration.

The features are densities of two lexicons (the fixed words below, and stems of words
learned from the labelled sample), their nearness to second-person words, and rates of capitals,
punctuation and obfuscated words. A document's whole text is read; a label, the
language, the source and the id are never features.

For the trees, the stems of each half of the sample come from the other half, so that
the trees see them as they will act on new texts; new texts get the stems of both.

Defined results: null and empty texts have zero features and the score that the model
gives those; repeated rows score alike; an empty table gives an empty result; without
labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.boosting import Calibrated
from wardlake.llm.common import blocks, id_and_text, keep_rows
from wardlake.llm.labelled import labelled_sample
from wardlake.session import written

#: Rows of the labelled sample that the model is fitted on, at most.
TRAINING_ROWS = 12_000
#: Stems of the learned lexicon, at most; each must begin words in so many toxic documents of its half.
LEARNED_STEMS, LEARNED_LEAST = 600, 4
#: Lengths of stems, in bytes of the word as UTF-8; a shorter word is its own stem.
STEMS = range(3, 9)
NEAR = 5

# Common insults, and words that address the reader.
INSULTS = frozenset(
    """
    arrogant bastard brainless clown coward creep cretin degenerate despicable dimwit dirtbag disgusting dumb
    dumbass failure filth filthy fool foul fraud freak garbage horrible hate hateful hideous idiot idiotic idiots
    ignorant imbecile incompetent jerk liar loathsome loser losers lunatic lowlife moron moronic morons nasty
    nobody numbskull parasite pathetic pig pigs psycho repulsive revolting rotten scum shameful sick simpleton
    slimy sociopath stupid stupidity sucker swine terrible trash traitor twit ugly useless vermin vile weak weasel
    whiner worm worthless wretched
    abschaum arschloch blödmann dreckig dummkopf ekelhaft idioten schwachkopf versager wertlos widerlich
    abruti connard crétin dégoûtant imbécile minable ordure pathétique raté salaud stupide
    asqueroso basura cretino despreciable escoria estúpido idiota imbécil inútil patético perdedor payaso
    """.split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes".split()
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LEET = bytearray(b + 32 if 65 <= b <= 90 else b for b in range(256))
for _written, _meant in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_written] = _meant
_LEET = bytes(_LEET)
_BETWEEN = b"*.-_,;:~+'\"()[]<>/\\|#%&="
_ODD = re.compile(rb"(?<![^\s])(?=[^\s]*[a-zA-Z][^\s]*[0-9@$*_.][^\s]*[a-zA-Z])[^\s]+")

FEATURES = (
    "fixed_density", "fixed_distinct", "learned_density", "learned_distinct", "learned_weight", "hidden_hits",
    "second_person", "near_second_person", "capitals", "capital_words", "punctuation", "exclamations", "odd_words",
    "log_words", "mean_word",
)


def words(text: bytes) -> list[bytes]:
    """ASCII letters lower-cased, other bytes kept, everything else a separator."""
    return text.translate(_FOLD).split()


def stems(word: bytes) -> list[bytes]:
    return [word[:n] for n in STEMS if n < len(word)] + [word] * (len(word) <= STEMS[-1])


def features(text: str, fixed: frozenset[bytes], learned: dict[bytes, float], you: frozenset[bytes]) -> list[float]:
    raw = text.encode("utf-8", "replace")
    found = words(raw)
    distinct = set(found)
    count = max(1, len(found))
    bad = distinct & fixed
    told: dict[bytes, float] = {}
    if learned:
        for n in STEMS:
            for word in [w for w in distinct if w[:n] in learned]:
                told[word] = max(told.get(word, 0.0), learned[word[:n]])
    hidden = (set(raw.translate(_LEET, _BETWEEN).split()) - distinct) & fixed
    fixed_hits = learned_hits = near = 0
    weight = 0.0
    person = distinct & you
    persons = 0
    if bad or told or person:
        marked = bad | told.keys() | person
        last_you, waiting = -NEAR - 1, []
        for at, word in enumerate(found):
            if word not in marked:
                continue
            if word in you:
                persons += 1
                near += sum(at - w <= NEAR for w in waiting)
                waiting, last_you = [], at
            if word in fixed:
                fixed_hits += 1
            if word in told:
                learned_hits += 1
                weight += told[word]
            if word in fixed or word in told:
                if at - last_you <= NEAR:
                    near += 1
                else:
                    waiting.append(at)
    codes = np.frombuffer(raw, np.uint8)
    by = np.bincount(codes, minlength=128)
    letters = max(1, int(by[65:91].sum() + by[97:123].sum()))
    spaces = int(by[32] + by[9:14].sum())
    visible = max(1, len(raw) - spaces)
    alnum = int(by[48:58].sum()) + int(by[65:91].sum()) + int(by[97:123].sum()) + int(by[128:].sum())
    capitals = int(by[65:91].sum())
    return [
        100 * fixed_hits / count, len(bad), 100 * learned_hits / count, len(told), weight / count, len(hidden),
        100 * persons / count, 100 * near / count, capitals / letters, max(0.0, capitals - count) / letters,
        (visible - alnum) / visible, 100 * int(by[33] + by[63]) / count, 100 * sum(1 for _ in _ODD.finditer(raw)) / count,
        math.log1p(len(found)), visible / count,
    ]


class Features:
    """Turns texts into rows of :data:`FEATURES`."""

    def __init__(self, learned: dict[bytes, float]):
        self.fixed = frozenset(w.encode() for w in INSULTS)
        self.you = frozenset(w.encode() for w in SECOND_PERSON)
        self.learned = learned

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows = [features(t, self.fixed, self.learned, self.you) for t in texts]
        return np.array(rows, float).reshape(len(rows), len(FEATURES))


def learned_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Stems that are far likelier in toxic documents of the sample, with their log odds (at most LEARNED_STEMS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                out, labels = [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    own = {s for w in set(words(text.encode("utf-8", "replace"))) if 2 < len(w) <= 40 for s in stems(w)}
                    out += own
                    labels += [label] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.int32())], ["stem", "label"])

    distinct = sample.select("text", "label").dropDuplicates(["text"])
    sizes = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    counted = distinct.mapInArrow(run, "stem binary, label int").groupBy("stem")
    counted = counted.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    strong = counted.where(F.col("toxic") >= LEARNED_LEAST).withColumn("odds", odds)
    strong = strong.where(F.col("odds") >= 3).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "stem")
    return {bytes(r["stem"]): r["odds"] for r in strong.limit(LEARNED_STEMS).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn=None, rows: int = TRAINING_ROWS) -> tuple[dict[bytes, float], Calibrated]:
    """The stems and the calibrated trees; only features of the bounded sample come to the driver."""
    half = F.pmod(F.xxhash64(F.crc32(F.col("text").cast("binary"))), F.lit(2))  # equal texts share a half
    sample = written(labelled_sample(docs, labels, "toxic", learn, rows).withColumn("half", half), "toxicity-sample")
    others = {k: learned_lexicon(sample.where(F.col("half") != k)) for k in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: Features(stems) for k, stems in others.items()}
        for batch in batches:
            for part in blocks(batch, "text"):
                pairs = zip(part.column("half").to_pylist(), part.column("text").to_pylist(), strict=True)
                values = pa.array([made[k]([text])[0] for k, text in pairs], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), values], ["doc_id", "label", "x"])

    rows_seen = sample.mapInArrow(run, "doc_id long, label int, x array<double>").collect()
    rows_seen.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows_seen], float).reshape(len(rows_seen), len(FEATURES))
    return learned_lexicon(sample), Calibrated.fit(x, np.array([r["label"] for r in rows_seen], float))


def score(docs: DataFrame, model: tuple[dict[bytes, float], Calibrated]) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    lexicon, trees = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(lexicon)
        for batch in batches:
            for part in blocks(batch, "text"):
                scores = trees.scores(made(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[dict[bytes, float], Calibrated], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that score below ``threshold``."""
    lexicon, trees = model

    def scorer():
        made = Features(lexicon)
        return lambda texts: trees.scores(made(texts))

    return keep_rows(docs, scorer, lambda scores: scores < threshold, text_col)
