"""Whitening against the linear algebra of numpy."""

import math

import numpy as np
import pytest

from tablelens.llm.queries import QUERIES
from tablelens.llm.whiten import leading_components, whiten


def wilkinson(n=21):
    return np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)


def clustered(n=40):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((n, n)))[0]
    a = q @ np.diag(np.r_[np.full(15, 3.0), 3 + 1e-13 * np.arange(10), np.linspace(0, 1, n - 25)]) @ q.T
    return (a + a.T) / 2


def gram(n, k):
    a = np.random.default_rng(n).standard_normal((n, k))
    return a @ a.T


@pytest.mark.parametrize(
    "a",
    [gram(64, 200), gram(64, 10), gram(1, 1), gram(2, 5), np.eye(6), np.zeros((4, 4)), wilkinson(), clustered(), 1e200 * gram(5, 9), 1e-200 * gram(5, 9)],
    ids=["full", "low rank", "one", "two", "equal", "zero", "close pairs", "clusters", "huge", "tiny"],
)
def test_components(a):
    k = min(32, len(a))
    values, vectors = leading_components(a, k)
    scale = np.abs(a).max() or 1.0
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale * len(a)


def table(spark, rows):
    return spark.createDataFrame([(*r, "e", "w") for r in rows], "vec_id long, embedding array<double>, explained string, whitened string")


def brute(x, k=32):
    """n, exact deviations, whitened up to sign, shares."""
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    c = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return deviation, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(got, x, ids, tolerance=1e-9):
    deviation, white, shares = brute(x)
    k = white.shape[1]
    assert len(got) == len(x) * k
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(k):
        mine = np.array([by[i, j + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(mine * sign - white[:, j]).max() < tolerance
        assert by[ids[0], j + 1].explained == pytest.approx(shares[j], rel=1e-9)
    for i, d in zip(ids, deviation, strict=True):
        assert by[i, 1].deviation == d and by[i, 1].n == len(x)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = QUERIES["op13_whitening"](spark, folder).collect()
    check(got, [whole(r.embedding) for r in rows], [r.vec_id for r in rows])


def test_vectors_that_take_no_part(spark):
    random = np.random.default_rng(7)
    good = [(i, (10 * random.standard_normal(5)).tolist()) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [nan] * 5), (103, [inf, 0.0, 0.0, 0.0, 0.0])]
    short = [(200, [1.0, 2.0]), (201, [])]
    got = whiten(table(spark, good + bad + short).repartition(5)).collect()
    filled = [v + [0.0] * (5 - len(v)) for _, v in good + short]
    check(got, [whole(v) for v in filled], [i for i, _ in good + short])


def test_large_entries_stay_exact(spark):
    random = np.random.default_rng(8)
    rows = [(i, (1e15 * random.standard_normal(3)).tolist()) for i in range(30)]
    got = whiten(table(spark, rows)).collect()
    _, white, _ = brute([whole(v) for _, v in rows])
    assert all(r.deviation is None for r in got) and len(got) == 90
    first = np.array([next(r.whitened for r in got if (r.vec_id, r.component) == (i, 1)) for i, _ in rows])
    assert min(np.abs(first - white[:, 0]).max(), np.abs(first + white[:, 0]).max()) < 1e-9
    assert whiten(table(spark, [(1, [1e308, 0.0]), (2, [-1e308, 1.0])])).count() == 4


def test_components_without_variance(spark):
    got = whiten(table(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0])])).collect()
    assert len(got) == 6 and {r.component for r in got if r.whitened is None} == {2}
    assert {(r.component, r.explained) for r in got} == {(1, 1.0), (2, 0.0)}
    same = whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in same] == [(None, 0.0, 0, 0.0)] * 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whiten(table(spark, rows))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
