import corpus_pipeline as pipeline
import pytest

from wardlake.llm import packing, quality, toxicity
from wardlake.llm.common import held_out
from wardlake.session import written

from . import test_jaccard_join, test_packing, test_repeated_units

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def scored(operator, spark, docs, sf_dir, fold):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return {r.doc_id: r.score for r in operator.score(docs, operator.fit(docs, labels, ~held_out("doc_id", *fold))).collect()}


def test_every_stage_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in pipeline.STAGES]

    scores = scored(toxicity, spark, docs, sf_dir, (3, 1))
    kept = written(stages[0](spark, docs, sf_dir), "t")
    assert rows_of(kept) == [r for r in rows_of(docs) if scores[r[0]] < 0.7]
    assert 0 <= docs.count() - kept.count() < 0.2 * docs.count()

    scores = scored(quality, spark, kept, sf_dir, (4, 2))
    good = written(stages[1](spark, kept, sf_dir), "t")
    assert rows_of(good) == [r for r in rows_of(kept) if scores[r[0]] >= 0.7]
    assert 0 <= kept.count() - good.count() < 0.3 * kept.count()

    components = test_jaccard_join.plain([(r[0], r[1]) for r in rows_of(good)])
    single = written(stages[2](spark, good, sf_dir), "t")
    first = {d for d, n, c in components if d == c}
    assert rows_of(single) == [r for r in rows_of(good) if r[0] in first]

    texts = test_repeated_units.plain({r[0]: r[1] for r in rows_of(single)})
    cut = written(stages[3](spark, single, sf_dir), "t")
    assert rows_of(cut) == sorted(((i, texts[i], *more[:2], len(texts[i])) for i, _, *more in rows_of(single)), key=str)

    test_packing.check(stages[4](spark, cut, sf_dir).collect(), texts, packing.CAPACITIES)


def test_odd_documents_go_through(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long, removed string, score string"
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "no id", "", "", 5), (3, "a b c d e f g h", "", "", 1), (3, "a b c d e f g h", "", "", 1), (4, "x" * 50_000, "", "", 1)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], kind)
    for empty in (False, True):
        frame = docs.limit(0) if empty else docs
        for _, stage in pipeline.STAGES[:-1]:
            frame = written(stage(spark, frame, sf_dir), "t")
            assert frame.columns == docs.columns
        assert (frame.count() == 0) == empty
        packed = pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
        assert sum(r.length for r in packed) == sum(len(r.text or "") for r in frame.collect())


def test_one_of_repeated_rows_stays(spark, sf_dir):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(3, text), (3, text), (5, text), (None, text), (7, ""), (7, "")], "doc_id long, text string")
    kept = pipeline.one_of_near_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, text), (7, ""), (7, "")]


@pytest.mark.parametrize("key", ["pipeline"])
def test_registered(spark, sf_dir, key):
    import __spark_entry__ as contract

    rows = contract.queries()[key](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} <= set(range(200)) and len({r.bin_id for r in rows}) > 10
