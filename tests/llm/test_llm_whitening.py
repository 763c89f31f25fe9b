"""Whitening against dense linear algebra and exact sums."""

import numpy as np
import pytest
from conftest import SMALLEST

from siltstone.llm import queries, whitening
from siltstone.plans.fixture import table

SCHEMA = "vec_id bigint, embedding array<float>, n int, component int, x int"


def dense(vectors, k=8):
    x = np.floor(1024.0 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    centred = x - x.sum(axis=0) / len(x)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    spread = (len(x) * x.astype(object) - x.sum(axis=0).astype(object)) ** 2
    return values, centred @ directions / np.sqrt(values), spread.sum(axis=1), (centred**2).sum() / len(x)


def compare(rows, ids, vectors, k=8):
    values, white, deviation, trace = dense(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * len(values)
    for c in range(len(values)):
        own = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(own @ white[:, c])
        assert np.abs(own * sign - white[:, c]).max() < 1e-8
        first = got[ids[0], c + 1]
        assert abs(first.explained - values[c] / trace) < 1e-10 * first.explained + 1e-15
    assert all(got[i, 1].deviation == d and got[i, 1].n == len(ids) for i, d in zip(ids, deviation, strict=True))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_given_table(spark):
    given = table(spark, SMALLEST, "embeddings").orderBy("vec_id").collect()
    rows = queries.op13_whitening(spark, SMALLEST).collect()
    compare(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_odd_rows_take_no_part(spark):
    made = np.random.default_rng(2).normal(size=(200, 12)).astype(np.float32)
    made[50:60] = made[3]
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(made)]
    odd = [None, [], [1.0] * 5, [None] * 12, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [1.0] * 11 + [None]]
    frame = spark.createDataFrame(rows + [(1000 + i, v, 0, 0, 0) for i, v in enumerate(odd)], SCHEMA).repartition(3)
    found = whitening.whiten(frame)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), list(range(200)), made)
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.where("vec_id = 3")).collect() == []  # no variance, no component
    flat = spark.createDataFrame([(None, [float(i), 1.0, 2.0 * i], 0, 0, 0) for i in range(9)] * 2, SCHEMA)
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 18 and {(r.vec_id, r.component) for r in rows} == {(None, 1)} and abs(rows[0].explained - 1) < 1e-12


@pytest.mark.parametrize(
    "made",
    [
        lambda r: r.normal(size=(2000, 64)),  # eigenvalues close together
        lambda r: r.normal(size=(900, 150)) * np.exp(-np.arange(150) / 9),
        lambda r: r.normal(size=(60, 13)),
        lambda r: r.normal(size=(9, 64)),  # of lower rank
        lambda r: np.vstack([np.eye(20), -np.eye(20)]),  # all alike
        lambda r: np.repeat(r.normal(size=(12, 40)), 9, axis=0) + 1e-4 * r.normal(size=(108, 40)),
    ],
)
def test_pairs_reach_double_precision(made):
    x = made(np.random.default_rng(8))
    x = x - x.mean(axis=0)
    matrix = x.T @ x / len(x)
    values, vectors = whitening.leading_pairs(lambda v: x.T @ (x @ v) / len(x), matrix.shape[0], 8)
    wanted = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert len(values) == 8 and np.abs(values - wanted).max() < 1e-13 * wanted[0]
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * wanted[0]
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13


def test_minres_solves_side_by_side():
    random = np.random.default_rng(1)
    turn, _ = np.linalg.qr(random.normal(size=(30, 30)))
    matrix = turn * np.r_[np.linspace(-3, -1, 15), np.linspace(1, 4, 15)] @ turn.T  # indefinite
    right = random.normal(size=(30, 3))
    right[:, 2] = 0
    solved = whitening.minres(lambda v: matrix @ v, right, 40)
    assert np.abs(solved - np.linalg.solve(matrix, right)).max() < 1e-8
    residuals = [np.linalg.norm(matrix @ whitening.minres(lambda v: matrix @ v, right, k) - right) for k in range(1, 12)]
    assert all(b <= a + 1e-12 for a, b in zip(residuals, residuals[1:]))
