import math

import numpy as np
import pytest

from wardlake.llm import whitening as W
from wardlake.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, x string, n string, component string, deviation string"


def plain(rows, components=4):
    """The contract with exact integers for sums and numpy's own eigenvectors."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in fine), default=0)
    whole = [(i, tuple([math.floor(256 * c) for c in v] + [0] * (size - len(v)))) for i, v in fine]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(size)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit]).reshape(n, size)
    covariance = centred.T @ centred / max(1, n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        c = np.array([float(n * c - s) / n for c, s in zip(x, sums)])
        for k, o in enumerate(order):
            if values[o] > 1e-14 * np.trace(covariance):
                out[i, k + 1] = (n, deviation if deviation < 1 << 63 else None, c @ vectors[:, o] / math.sqrt(values[o]), values[o] / np.trace(covariance))
    return out


def same(got, true, precise=1e-8):
    rows = {(r.vec_id, r.component): r for r in got}
    assert set(rows) == set(true) and len(rows) == len(got)
    signs = {}
    for key in sorted(true, key=lambda k: -abs(true[k][2])):
        r, (n, deviation, value, explained) = rows[key], true[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-6)
        sign = signs.setdefault(key[1], math.copysign(1, r.whitened * value))
        assert r.whitened * sign == pytest.approx(value, abs=precise)
        assert r.identity_error < 1e-6


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "c", "c", "c") for i, v in rows], KIND)


def test_odd_rows(spark):
    random = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(80, 6)) * [5, 4, 3, 2, 1, 0.5])]
    rows += [(100 + i, rows[3][1]) for i in range(50)]  # copies count once in the fit
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [1.0, -0.0]), (205, [])]
    same(W.whitened(frame(spark, rows)).collect(), plain(rows))


def test_few_rows(spark):
    assert W.whitened(frame(spark, [])).count() == 0
    assert W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert W.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    same(W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (None, [0.0, 0.0])])).collect(), plain([(1, [1.0, 2.0]), (2, [3.0, 2.5]), (None, [0.0, 0.0])]))


def test_far_from_zero_and_beyond_a_long(spark):
    random = np.random.default_rng(2)
    far = [(i, (1e9 + v).tolist()) for i, v in enumerate(random.normal(size=(60, 5)) * [5, 4, 3, 2, 1])]
    same(W.whitened(frame(spark, far)).collect(), plain(far))
    huge = [(i, (v * 1e8).tolist()) for i, v in enumerate(random.normal(size=(60, 3)) * [3, 2, 1])]
    same(W.whitened(frame(spark, huge)).collect(), plain(huge))
    assert any(r.deviation is None for r in W.whitened(frame(spark, huge)).collect())


@pytest.mark.parametrize("spread", [[9, 9, 9, 9, 9, 1, 1], [5, 5, 4, 3, 0, 0, 0], [1e6, 1e3, 1, 1e-3, 1e-6, 0, 0], [3], [2, 1], [0, 0, 7]])
def test_eigenvectors(spread):
    random = np.random.default_rng(3)
    basis, _ = np.linalg.qr(random.normal(size=(len(spread), len(spread))))
    matrix = basis @ np.diag(np.array(spread, float)) @ basis.T
    matrix = (matrix + matrix.T) / 2
    for m in (matrix, np.diag(np.array(spread, float))):
        values, vectors = W.leading_components(m, 4)
        many = min(4, len(spread))
        assert np.allclose(values, sorted(spread, reverse=True)[:many], atol=1e-13 * max(spread))
        assert np.allclose(vectors @ vectors.T, np.eye(many), atol=1e-12)
        assert np.allclose(m @ vectors.T, vectors.T * values, atol=1e-12 * max(spread))


def test_sturm_counts():
    random = np.random.default_rng(4)
    diagonal, off = random.normal(size=30), random.normal(size=29)
    true = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    for value in random.normal(size=50) * 3:
        assert W.below(diagonal, off, value) == (true < value).sum()


def test_the_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(QUERIES["op11_whitening"](spark, sf_dir).collect(), plain(rows))
