"""Search over an index of buckets, against brute force."""

import numpy as np
import pytest

from siltstone.operators import buckets

SCHEMA = "id bigint, vector array<double>, bucket int, slice int"


def made(kind):
    random = np.random.default_rng(3)
    if kind == "even":
        x = random.normal(size=(1500, 32))
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = random.normal(size=(40, 32)) * 4
    x = centres[random.integers(0, 40, 1500)] + 0.1 * random.normal(size=(1500, 32))
    x[100:700] = x[5]  # a bucket with more than a third of all rows, all alike
    return x


def brute(x, queries, k, metric):
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1) * (0.5 if metric == "cosine" else 1)
        first = np.lexsort((np.arange(len(x)), d.round(12)))[:k]
        out[q] = [(int(i), d[i]) for i in first]
    return out


def hits(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.mark.parametrize("kind", ["even", "grouped"])
@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_exact_search_equals_brute_force(spark, monkeypatch, kind, metric):
    monkeypatch.setattr(buckets, "SLICE_ROWS", 100)  # hot buckets are dealt into slices
    x = made(kind)
    odd = [(9000, None), (9001, []), (9002, [1.0] * 5), (9003, [float("nan")] * 32), (9004, [None] * 32)]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)] + [(i, v, 1, 1) for i, v in odd]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = corpus.where("id % 30 = 0").selectExpr("id AS query_id", "vector", "id")
    index = buckets.build_index(corpus, metric=metric, bits=6)
    found = hits(buckets.search(index, queries, 7))
    wanted = brute(x, [i for i in range(1500) if i % 30 == 0], 7, metric)
    assert found.keys() == wanted.keys()
    for q, own in wanted.items():
        assert np.allclose([d for _, d in found[q]], [d for _, d in own], atol=1e-9)
        if metric == "l2sq":
            assert [i for i, _ in found[q]] == [i for i, _ in own]


def test_few_rows_and_none(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0)], SCHEMA)
    queries = corpus.selectExpr("id AS query_id", "vector")
    assert {q: [i for i, _ in own] for q, own in hits(buckets.search(buckets.build_index(corpus), queries, 5)).items()} == {1: [1, 2], 2: [1, 2]}
    empty = buckets.build_index(corpus.limit(0))
    assert buckets.search(empty, queries, 5).collect() == [] and buckets.search(empty, queries, 5, share=0.5).collect() == []


def test_grouped_vectors_need_a_small_share(spark):
    x = made("grouped")
    corpus = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)
    queries = corpus.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    index = buckets.build_index(corpus)
    found = hits(buckets.search(index, queries, 10, share=0.1))
    wanted = brute(x, list(found), 10, "l2sq")
    near = sum(sum(d <= wanted[q][-1][1] + 1e-9 for _, d in own) for q, own in found.items())
    assert near / (10 * len(wanted)) >= 0.9
    assert {r.approximate for r in buckets.search(index, queries, 3, share=0.1).collect()} == {True}
