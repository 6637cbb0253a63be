import math

import numpy as np
import pytest

from maskwright.llm import whitening as op

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, dims int"


def plain(rows, k=4):
    """{(vec_id, place): (n, deviation, whitened, explained)} by a full eigendecomposition."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    n, mean, sums = len(fit), fit.mean(axis=0), [int(s) for s in fit.sum(axis=0)]
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-values)[:k]
    out = []
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for place, c in enumerate(order):
            out.append((i, place + 1, n, deviation, abs((np.array(v) - mean) @ vectors[:, c]) / math.sqrt(values[c]), values[c] / values.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def check(got, want):
    got = sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, abs(r.whitened)))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    assert np.allclose([abs(r.whitened) for r in got], [w[4] for w in want], rtol=1e-7, atol=1e-9)
    assert np.allclose([r.explained for r in got], [w[5] for w in want], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_whole_table_matches_a_full_decomposition(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    check(op.op13_whitening(spark, f"/root/testdata/sf{sf}").collect(), plain(rows))


def test_awkward_vectors(spark):
    draw = np.random.default_rng(3)
    good = [(k, [float(c) for c in draw.standard_normal(6) * (5, 4, 3, 2, 1, 1)]) for k in range(60)]
    good += [good[5], (70, good[5][1]), (None, good[7][1]), (71, [0.0, -0.0, 0.001, -0.001, 1.0, 1.0])] + [(80 + k, good[9][1]) for k in range(40)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in good + bad], SCHEMA)
    check(op.whitened(df).collect(), plain(good))
    assert op.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op.whitened(spark.createDataFrame([(i, [1.0, 2.0], 0, 0, 0) for i in range(5)], SCHEMA)).count() == 0
    flat = [(k, [float(k), 2.0 * k, 0.0, 1.0, 5.0]) for k in range(20)]  # one direction only
    assert {r.component for r in op.whitened(spark.createDataFrame([(i, v, 0, 0, 0) for i, v in flat], SCHEMA)).collect()} == {1}
    huge = op.whitened(spark.createDataFrame([(i, [float(3e9 * i), float(i % 3)], 0, 0, 0) for i in range(9)], SCHEMA)).collect()
    exact = {r.vec_id: r.deviation for r in huge}
    assert exact[4] is not None and exact[0] is None  # over 2^63 - 1


def test_no_eigenvalue_is_missed(spark):
    draw = np.random.default_rng(4)
    for values in ([9.0, 9, 9, 9, 9, 9, 1, 0.5], [8.0, 4, 2, 1, 1 - 1e-9, 1 - 2e-9, 0.5, 0], [1.0] * 7, [1e6, 1e-3, 1e-4, 1e-5, 1e-6, 0, 0], list(range(40, 0, -1))):
        q = np.linalg.qr(draw.standard_normal((len(values), len(values))))[0]
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        found, vectors = op.feast(spark, matrix)
        assert np.allclose(found, sorted(values, reverse=True)[: len(found)], rtol=1e-9, atol=1e-13 * sum(values)) and len(found) == min(4, sum(v > 1e-12 * sum(values) for v in values))
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * sum(values)
        for shift in (0.4, 1.7, 8.5):
            assert op.above(matrix, shift) == sum(v > shift for v in values)
