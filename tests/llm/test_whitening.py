import math
from fractions import Fraction

import numpy as np
import pytest

from riskweave.llm import common, whitening

BAD = [None, [], [None, 1.0, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [1e12, 0.0, 0.0], [1.0, 2.0]]


def plain(vectors, k=8):
    """In exact fractions up to the covariance: n, deviations, covariance, and numpy's eigenvectors of it."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(dims)]
    y = [[n * v[j] - sums[j] for j in range(dims)] for v in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    values, vec = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    white = np.array([[float(Fraction(c, n)) for c in r] for r in y]) @ vec[:, order] / np.sqrt(values[order])
    return n, [sum(c * c for c in r) for r in y], white, values[order] / np.trace(cov)


def compare(got, ids, vectors, k=8):
    n, deviation, white, explained = plain(vectors, k)
    k = white.shape[1]
    assert len(got) == n * k and {r.n for r in got} == {n}
    place = {v: i for i, v in enumerate(ids)}
    own = np.zeros((n, k))
    for r in got:
        assert r.deviation == deviation[place[r.vec_id]] == int(r.deviation_exact)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        own[place[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((own * white).sum(0))
    assert np.allclose(own * sign, white, rtol=1e-7, atol=1e-7)
    error = np.abs(np.cov(own.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - error) < 1e-9 and error < 1e-6


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_equals_exact_arithmetic(spark, parts):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(0, 1, (120, 11)) @ rng.normal(0, 0.2, (11, 11)) + 3).astype(np.float32).tolist()
    rows = spark.createDataFrame([(i, v, 9) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int").repartition(parts, "vec_id")
    compare(whitening.whiten(rows).collect(), range(120), vectors)


def test_large_offset_loses_nothing(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 0.01, (80, 5)) + 1e6).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(6)
    compare(whitening.whiten(rows).collect(), range(80), vectors)


def test_rows_that_do_not_remain_and_repeated_ones(spark):
    good = [[0.1, 0.5, -0.2], [0.3, -0.4, 0.25], [0.9, 0.1, 0.0], [-0.5, 0.2, 0.7], [0.1, 0.5, -0.2]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(BAD)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    compare(got, range(5), good)
    assert {r.component for r in got} == {1, 2, 3}


def test_deviation_beyond_a_long(spark):
    vectors = [[1e9, -1e9], [-1e9, 1e9], [1e9, 1e9], [0.5, 0.25]] * 3
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    deviation = plain(vectors)[1]
    assert all(r.deviation is None and int(r.deviation_exact) == deviation[r.vec_id] for r in got if deviation[r.vec_id] >= 2**63) and any(d >= 2**63 for d in deviation)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(i, v) for i, v in enumerate(BAD[:4])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_flat_components_are_left_out(spark):
    vectors = [[a, 2 * a, 0.25] for a in (0.5, 0.25, -0.75, 1.0)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_query(spark):
    at = "/root/testdata/sf0.001"
    rows = common.table(spark, at, "embeddings").collect()
    compare(whitening.op12_embedding_whitening(spark, at).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
