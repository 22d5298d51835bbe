import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import quality, toxicity
from wardlake.llm.boosting import Boosted, Calibrated, isotonic
from wardlake.llm.common import held_out
from wardlake.llm.convolution import CHUNK, OVERLAP, chunks_of
from wardlake.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, label string"


def auc(y, score):
    higher = (score[y == 1][:, None] > score[y == 0]).mean()
    return higher + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()


@pytest.mark.parametrize(
    ("name", "label", "parts", "rest", "least"), [("op3_toxicity", "toxic", 3, 1, 0.75), ("op9_quality", "quality", 4, 2, 0.9)]
)
def test_held_out_accuracy(spark, sf_dir, name, label, parts, rest, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(rows)))
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)
    seen = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    y, scores = (np.array(v) for v in zip(*seen, strict=True))
    assert auc(y, scores) > least


def planted(spark, word):
    rows = [(i, ("plain words here and there " * 4) + (word if i % 4 == 0 else "nice"), "clash", "clash") for i in range(80)]
    rows += [(90, None, None, None), (91, "", None, None), (92, "x " * 40_000 + word, None, None), (None, word, None, None), (0, word, "", "")]
    labels = [(i, i % 4 == 0) for i in range(80)] + [(1, False), (None, True), (5000, True)]
    kind = "doc_id long, toxic boolean"
    table = spark.createDataFrame(labels, kind).withColumn("toxic", F.col("toxic").cast("int")).withColumn("quality", 1 - F.col("toxic"))
    return spark.createDataFrame(rows, DOCS), table.unionByName(spark.createDataFrame([(3, None, None)], "doc_id long, toxic int, quality int"))


def test_toxicity_on_odd_rows(spark):
    docs, labels = planted(spark, "you idiot you moron")
    scores = {}
    for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(scores) == 84 and len(scores[0]) == 2
    assert scores[90] == scores[91]
    assert min(scores[4]) > 0.5 > max(scores[1])


def test_quality_on_odd_rows(spark):
    docs, labels = planted(spark, "### %%% " * 30)
    rows = [(r.doc_id, r.score) for r in quality.score(docs, quality.fit(docs, labels)).collect()]
    scores = dict(rows)
    assert len(rows) == 85 and scores[90] == scores[91]
    assert scores[4] < scores[1] and scores[92] < scores[1]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_nothing_to_learn_or_score(spark, operator):
    docs = spark.createDataFrame([(1, "a", "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.score for r in operator.score(docs, operator.fit(docs, none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    assert [r.score for r in operator.score(docs, operator.fit(docs, one)).collect()] == [0.5]
    assert operator.score(docs.limit(0), operator.fit(docs, one)).count() == 0


def test_the_held_out_fold_is_not_learned_from(spark):
    docs, labels = planted(spark, "idiot")
    wrong = labels.withColumn("toxic", F.when(held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    condition = ~held_out("doc_id", 3, 1)
    first, second = (toxicity.score(docs, toxicity.fit(docs, t, condition)).collect() for t in (labels, wrong))
    assert sorted(map(str, first)) == sorted(map(str, second))


def test_isotonic_is_monotone_and_pools():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert len(x) == 3 and (np.diff(y) > 0).all()


def test_trees_learn_an_interaction():
    random = np.random.default_rng(0)
    x = random.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert auc(y, Boosted().fit(x, y).margins(x)) > 0.98
    assert Calibrated.fit(x[:4], y[:4]).trees is None


def test_chunks_cover_every_byte():
    for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK - OVERLAP, 2 * CHUNK - OVERLAP + 1, 5000):
        text = bytes(1 + i % 255 for i in range(n))
        chunks, counts = chunks_of([b"abc", text, b""])
        own = chunks[counts[0] : counts[0] + counts[1]]
        step = CHUNK - OVERLAP
        assert b"".join(c.tobytes()[:step] for c in own[:-1]) + own[-1].tobytes().rstrip(b"\0") == text
