"""Features, trees and the network, each against a version that goes step by step."""

import math
import re

import numpy as np
import pytest

from wardlake.llm import quality, toxicity
from wardlake.llm.boosting import Boosted, isotonic
from wardlake.llm.common import held_out
from wardlake.llm.convolution import CHUNK, EMBED, FILTERS, LAGS, OVERLAP, STRIDE, WIDTH, Network, chunks_of
from wardlake.llm.queries import QUERIES

TEXTS = ["", "a", "You IDIOT! you m0r0n, st*u*p*i*d...", "plain words " * 90, "é ü 漢字 you are trash and a liar, your liar", "ABC def! " * 130, "x" * 2000]


def plain_network(network, text):
    raw = text.encode("utf-8", "replace")
    starts = [0]
    while starts[-1] + CHUNK < len(raw):
        starts.append(starts[-1] + CHUNK - OVERLAP)
    best = []
    for start in starts:
        own = raw[start : start + CHUNK].ljust(CHUNK, b"\0")
        rows = []
        for i, byte in enumerate(own):
            same = [float(i >= lag and byte > 0 and own[i - lag] == byte) for lag in LAGS]
            rows.append([*network.table[byte].tolist(), *same])
        answers = []
        for at in range(0, CHUNK - WIDTH + 1, STRIDE):
            window = np.array([v for row in rows[at : at + WIDTH] for v in row])
            answers.append(window @ network.filters + network.bias)
        best.append([max(0.0, max(a[f] for a in answers)) for f in range(FILTERS)])
    features = [max(b[f] for b in best) for f in range(FILTERS)] + [sum(b[f] for b in best) / len(best) for f in range(FILTERS)]
    return 1 / (1 + math.exp(-(sum(x * w for x, w in zip(features, network.top.tolist())) + float(network.shift[0]))))


def test_network_scores():
    network = Network.fresh()
    assert np.allclose(network.scores([t.encode() for t in TEXTS], step=3), [plain_network(network, t) for t in TEXTS], atol=1e-5)


def test_network_slopes():
    network = Network.fresh()
    for key in ("table", "filters", "bias", "top", "shift"):
        setattr(network, key, getattr(network, key).astype(np.float64))
    random = np.random.default_rng(2)  # texts whose largest answers don't lie where chunks overlap: there either chunk has them
    texts = [bytes(random.choice(list(b"abcdef wordsYou!"), n).tolist()) for n in (20, 300, 700, 1500, 3000)]
    chunks, counts = chunks_of(texts)
    y = np.array([0, 1, 0, 1, 1], np.float64)
    index = np.arange(len(chunks))
    slopes = network.slopes(chunks, index, counts, y)
    for step in (1, 3):
        assert all(np.allclose(slopes[k], v, atol=1e-6) for k, v in network.slopes(chunks, index, counts, y, step).items())

    def loss():
        chances = network.scores(texts)
        return -np.mean(y * np.log(chances) + (1 - y) * np.log(1 - chances)) + 0.5e-4 * (network.top**2).sum()

    for key, places in {"filters": 12, "bias": 6, "top": 12, "shift": 1, "table": 12}.items():
        values = getattr(network, key)
        for _ in range(places):
            at = (int(random.choice(list(b"ade wordsYou"))), random.integers(EMBED)) if key == "table" else tuple(random.integers(n) for n in values.shape)
            kept, ends = values[at], []
            for move in (1e-4, -1e-4):
                values[at] = kept + move
                ends.append(loss())
            values[at] = kept
            assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(slopes[key][at], abs=2e-3)


def test_the_whole_of_long_texts_is_learned_from(spark):
    """What tells the classes apart stands at one place of a long text only."""
    filler = "some words that say nothing at all " * 200
    rows = [(i, filler[: 900 * (i % 7)] + ("##%%##%% " * 12 if i % 2 else "") + filler[900 * (i % 7) :]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    network = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, network).collect()}
    assert max(scores[i] for i in range(81, 120, 2)) < min(scores[i] for i in range(80, 120, 2))
    bounded = quality.fit(docs, labels, most=len(filler) * 10)
    assert isinstance(bounded, float | Network)


def plain_features(text, fixed, learned, you):
    raw = text.encode()
    found, word = [], b""
    for byte in [*raw, 32]:
        c = bytes([byte])
        if c.isalpha() or byte >= 128:
            word += c.lower()
        elif word:
            found.append(word)
            word = b""
    told = {w: max((learned[w[:n]] for n in range(3, 9) if w[:n] in learned), default=None) for w in set(found)}
    told = {w: v for w, v in told.items() if v is not None}
    count = max(1, len(found))
    hits = [i for i, w in enumerate(found) if w in fixed or w in told]
    persons = [i for i, w in enumerate(found) if w in you]
    near = 0
    for i in hits:
        before = max((p for p in persons if p <= i), default=-100)
        after = min((p for p in persons if p > i), default=10**9)
        near += i - before <= 5 or (after - i <= 5 and not any(i < p < after for p in persons))
    plain = bytes(dict(zip(b"013457@$!", b"oieastasi")).get(b, b) for b in raw.lower() if b not in b"*.-_,;:~+'\"()[]<>/\\|#%&=")
    hidden = {w for w in plain.split() if w in fixed and w not in found}
    letters = sum(chr(b).isalpha() for b in raw if b < 128)
    capitals = sum(65 <= b <= 90 for b in raw)
    visible = max(1, sum(not (b == 32 or 9 <= b <= 13) for b in raw))
    alnum = sum(b >= 128 or chr(b).isalnum() for b in raw)
    odd = sum(re.search(rb"[a-zA-Z][^\s]*[0-9@$*_.][^\s]*[a-zA-Z]", w) is not None for w in raw.split())
    return [
        100 * sum(w in fixed for w in found) / count, len({w for w in found if w in fixed}), 100 * sum(w in told for w in found) / count, len(told),
        sum(told.get(w, 0.0) for w in found) / count, len(hidden), 100 * len(persons) / count, 100 * near / count, capitals / max(1, letters),
        max(0.0, capitals - count) / max(1, letters), (visible - alnum) / visible, 100 * sum(b in b"!?" for b in raw) / count, 100 * odd / count,
        math.log1p(len(found)), visible / count,
    ]


def test_toxicity_features(spark, sf_dir):
    learned = {b"wor": 3.0, b"word": 4.5, b"the": 3.5, b"qu": 9.0}
    made = toxicity.Features(learned)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    got = made(texts)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_features(text, made.fixed, learned, made.you)), text[:60]


def walked(trees, row):
    total = trees.base
    for features, cuts, values in trees.trees:
        node = 0
        for _ in range(trees.depth):
            place = sum(row[features[node]] >= e for e in trees.edges[features[node]])
            node = 2 * node + (2 if place > cuts[node] else 1)
        total += values[node - (2**trees.depth - 1)]
    return total


def test_trees():
    random = np.random.default_rng(5)
    x = random.random((400, 3))
    y = (x[:, 0] + 0.2 * random.normal(size=400) > 0.6).astype(float)
    trees = Boosted(rounds=8).fit(x, y)
    assert np.allclose(trees.margins(x), [walked(trees, row) for row in x])
    # the first cut is the best of all, and each leaf has its rows' Newton step
    rate = y.mean()
    gradient, weight = y - rate, np.full(400, rate * (1 - rate))

    def gain(left):
        part = lambda m: gradient[m].sum() ** 2 / (weight[m].sum() + trees.smooth)
        return part(left) + part(~left) - part(np.ones(400, bool)) if min(weight[left].sum(), weight[~left].sum()) >= 1 else 0.0

    gains = {(j, k): gain(x[:, j] < e) for j in range(3) for k, e in enumerate(trees.edges[j])}
    features, cuts, values = trees.trees[0]
    assert gains[features[0], cuts[0]] == pytest.approx(max(gains.values()))
    one = Boosted(rounds=1, base=trees.base, edges=trees.edges, trees=trees.trees[:1])
    leaves = np.round(one.margins(x) - trees.base, 12)
    for value in set(leaves):
        own = leaves == value
        assert value == pytest.approx(trees.rate * gradient[own].sum() / (weight[own].sum() + trees.smooth)) or len(set(leaves)) < len(set(values))


def test_isotonic_against_all_partitions():
    random = np.random.default_rng(6)
    for _ in range(50):
        x, y = random.integers(0, 6, 9).astype(float), random.integers(0, 2, 9).astype(float)
        points = isotonic(x, y)
        # the fit at a value is the largest, over starts, of the least mean, over ends
        levels = np.unique(x)
        for v in levels:
            fit = max(min(y[(x >= a) & (x <= b)].mean() for b in levels if b >= v) for a in levels if a <= v)
            own = [k for k in range(len(levels)) if max(min(y[(x >= a) & (x <= b)].mean() for b in levels if b >= levels[k]) for a in levels if a <= levels[k]) == pytest.approx(fit)]
            pool = np.isin(x, levels[own])
            assert np.interp(x[pool].mean(), *points) == pytest.approx((y[pool].sum() + y.mean()) / (pool.sum() + 1))


def test_queries_against_step_by_step_scores(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    network = quality.fit(docs, labels, ~held_out("doc_id", 4, 2))
    short = sorted(texts, key=lambda i: len(texts[i]))[:60]
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    assert np.allclose([got[i] for i in short], [plain_network(network, texts[i]) for i in short], atol=1e-4)
    lexicon, model = toxicity.fit(docs, labels, ~held_out("doc_id", 3, 1))
    made = toxicity.Features(lexicon)
    got = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        margin = walked(model.trees, plain_features(text, made.fixed, lexicon, made.you))
        expected = np.interp(margin, *model.points) + 1e-6 * (1 / (1 + math.exp(-margin)) - 0.5)
        assert got[i] == pytest.approx(min(1, max(0, expected)), abs=1e-6)
