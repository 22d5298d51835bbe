import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardlake.llm import vector_graph as V
from wardlake.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, vector string, score string"


def plain(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = min(v, fine.get(i, v))
    sizes = Counter(map(len, fine.values()))
    common = min(sizes, key=lambda d: (-sizes[d], d)) if sizes else 0
    fine = {i: np.array(v) for i, v in fine.items() if len(v) == common}
    out = {}
    for q in fine:
        if q % 20 == 0:
            scored = sorted(((-float(fine[q] @ v), i) for i, v in fine.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, true):
    assert set(got) <= set(true)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / max(1, len(true[q])) for q in true]
    return sum(hits) / len(hits)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.cos(i), math.sin(i), 0.1 * (i % 3)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(60)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [nan, 1.0, 1.0]), (280, [inf, 1.0, 1.0]), (300, [1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (20, [0.5, 0.5, 0.5]), (320, [])]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    true = plain(rows, 20)
    for shards in (8192, 30):
        got = results(V.nearest(frame, shard_rows=shards, block_rows=3))
        assert set(got) == set(true)
        for q in true:
            assert [i for i, _ in got[q]] == [i for i, _ in true[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in true[q]])
    assert V.nearest(frame.limit(0)).count() == 0
    assert all(len(v) == 1 for v in results(V.nearest(spark.createDataFrame([(*r, "", "") for r in rows[:2]], KIND))).values())


def test_recall_of_the_query(spark):
    path = "/root/testdata/sf0.1"
    try:
        rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    except Exception:
        pytest.skip("no test data")
    true = plain(rows, 20)
    got = results(QUERIES["op5_vector_graph"](spark, path))
    assert all(len(v) == 20 for v in got.values())
    assert recall(got, true) >= 0.95


def test_recall_over_shards_and_norms(spark):
    random = np.random.default_rng(3)
    points = random.normal(size=(1500, 16)) * random.lognormal(0, 0.4, (1500, 1))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], KIND)
    assert recall(results(V.nearest(frame, shard_rows=400, block_rows=20)), plain(rows, 20)) >= 0.95
