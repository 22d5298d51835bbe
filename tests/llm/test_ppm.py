import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import ppm
from wardlake.llm.ppm_model import BEFORE, END, SYMBOLS, levels, log10_probability
from wardlake.llm.queries import QUERIES

ORDER = 3


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Plain:
    """A trie of nested dictionaries, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        self.words, self.total = Counter(), 0
        for text in texts:
            data = bytes([BEFORE]) * order + lowered(text).encode() + bytes([END])
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[i - k : i]][data[i]] += 1
            self.words.update([*re.findall("[^\x20\x09-\x0d]+", lowered(text)), None])

    def symbol(self, context, symbol):
        chance, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = {s: c for s, c in self.seen.get(context[self.order - k :], {}).items() if s not in excluded}
            if not counts:
                continue
            total = sum(counts.values())
            if symbol in counts:
                return chance * (2 * counts[symbol] - 1) / (2 * total)
            chance *= len(counts) / (2 * total)
            excluded |= counts.keys()
        return chance / (SYMBOLS - len(excluded))

    def score(self, text):
        data = bytes([BEFORE]) * self.order + lowered(text).encode() + bytes([END])
        return sum(math.log10(self.symbol(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))

    def row(self, text):
        total, kinds = sum(self.words.values()), len(self.words)
        tokens = [*re.findall("[^\x20\x09-\x0d]+", lowered(text)), None]
        base = sum(math.log10((self.words[t] + 1) / (total + kinds + 1)) for t in tokens)
        return len(tokens), sum(self.words[t] > 0 for t in tokens), total, base, self.score(text)


def check(rows, docs, held, order):
    model = Plain([t for i, t in docs if not held(i)], order)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=str)
    wanted = sorted(((i, held(i), *model.row(t)) for i, t in docs), key=str)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def texts(rng):
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    yield from [None, "", " ", "A b\tÉ é\n", "zzz", "漢字 🙂", "abc " * 2000]
    for _ in range(25):
        yield rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))


@pytest.mark.parametrize("block_chars", [30_000_000, 300])
def test_against_a_plain_trie(spark, block_chars):
    docs = list(enumerate(texts(random.Random(3)))) + [(2, "again"), (None, "no id")]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, block string, held_out string")
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    rows = ppm.score(frame, held, ORDER, block_chars).collect()
    check(rows, docs, lambda i: i is not None and i % 3 == 1, ORDER)


def test_nothing_to_learn_from_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.score(frame, F.lit(True), ORDER).collect()}
    assert rows[1].score == pytest.approx(-3 * math.log10(256), rel=1e-6) and rows[1].base_score == 0
    assert (rows[2].n_tokens, rows[2].n_known, rows[2].train_tokens) == (1, 0, 0)
    assert ppm.score(frame.limit(0), F.lit(False), ORDER).count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    texts_ = [bytes(rng.integers(97, 101, 40).astype(np.uint8)) for _ in range(20)]
    keys, counts = np.unique(np.concatenate([ppm.grams(t, ORDER) for t in texts_]), return_counts=True)
    ladder = levels(keys, counts, range(ORDER + 1), [])
    for context in [int(keys[0]) >> 8, int(keys[40]) >> 8, 0x616263, 0x7A6161, 0x7A7A7A]:
        every = np.array([(context << 8) | s for s in range(256)])
        assert (10 ** log10_probability(every, ladder)).sum() == pytest.approx(1)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op4_ppm"](spark, sf_dir).collect()
    check(rows, docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, ppm.ORDER)


def test_it_learns(spark, sf_dir):
    """Held-out documents are far likelier than with equal symbols, and those learned from likelier still."""
    rows = QUERIES["op4_ppm"](spark, sf_dir).collect()
    sizes = {r.doc_id: len(r.text.encode()) + 1 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    per_byte = {h: sum(r.score for r in rows if r.held_out == h) / sum(sizes[r.doc_id] for r in rows if r.held_out == h) for h in (True, False)}
    assert -0.35 * math.log10(256) < per_byte[True] < per_byte[False]
