"""Neighbour search against brute force, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import neighbours, queries
from siltstone.plans.fixture import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, pos bigint"


def brute(vectors, ids, query, k):
    scores = vectors @ vectors[query]
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), float(scores[i])) for i in order if i != query][:k]


def rows_of(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def made():
    random = np.random.default_rng(4)
    vectors = random.normal(size=(1500, 16)).astype(np.float32)
    vectors *= random.uniform(0.5, 1.5, size=(1500, 1)).astype(np.float32)
    vectors[100:400] = vectors[7]  # copies
    return vectors.astype(np.float64)


def test_recall_scores_and_ties(spark, made):
    ids = np.arange(len(made)) * 7 % len(made) + 10
    rows = [(int(i), v.tolist(), 0, 1, 2) for i, v in zip(ids, made, strict=True)]
    odd = [(None, [1.0] * 16), (90_000, None), (90_001, [0.0] * 16), (90_002, [float("nan")] * 16), (90_003, [1.0]),
           (90_004, [None] * 16), (90_005, []), (90_006, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + [(*o, 0, 0, 0) for o in odd], SCHEMA).repartition(5)
    found = rows_of(neighbours.nearest_rows(frame.unionByName(frame.limit(50)), F.col("vec_id") % 20 == 0))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    at = {int(i): k for k, i in enumerate(ids)}
    hits = total = 0
    for query, got in found.items():
        wanted = brute(made, ids, at[query], 20)
        assert [r for r, _, _ in got] == list(range(1, 21)) and query not in {v for _, v, _ in got}
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        for _, vec, score in got:
            assert abs(score - float(made[at[vec]] @ made[at[query]])) < 1e-9
        hits += len({v for _, v, _ in got} & {v for v, _ in wanted})
        total += 20
    assert hits / total >= 0.9  # what the search promises


def test_one_long_vector_costs_the_others_nothing(spark):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(1500, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[3] *= 100
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(len(vectors))
    frame = spark.createDataFrame([(int(i), v.tolist(), 0, 0, 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    found = rows_of(neighbours.nearest_rows(frame, F.col("vec_id") % 20 == 0))
    hits = [len({v for _, v, _ in got} & {v for v, _ in brute(vectors, ids, q, 20)}) for q, got in found.items()]
    assert len(hits) == 75 and np.mean(hits) / 20 >= 0.95


def test_lists_and_searches_go_on_until_they_settle(spark, monkeypatch):
    shares = iter([0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.0])
    seen = []
    monkeypatch.setattr(neighbours, "first_lists", lambda nodes: spark.range(1))
    monkeypatch.setattr(neighbours, "improve", lambda nodes, graph, number: (seen.append(number), (graph, next(shares)))[1])
    neighbours.neighbour_graph(None)
    assert seen == list(range(7))


@pytest.mark.parametrize("answered", [64, 1])
def test_blocks_get_each_vector_once_in_a_row_for_each_pair_of_blocks(spark, monkeypatch, answered):
    monkeypatch.setattr(neighbours, "ANSWERED", answered)
    n, random = 3000, np.random.default_rng(3)
    near = [random.integers(0, n, 60).tolist() for _ in range(n)]
    near[5] = None
    near[7] = []
    asked = spark.createDataFrame([(i // 1024, lists) for i, lists in enumerate(near)], "block int, near array<bigint>")
    known = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").cast("binary").alias("bytes"), (F.col("id") * 2).cast("float").alias("scale"))
    sent = neighbours.delivered(asked.repartition(4), known.repartition(3), n).collect()
    assert len(sent) == 9  # one for each pair of blocks, not one for each vector of each block
    for block in range(3):
        got = [e for r in sent if r.to_block == block for e in zip(r.pos, r.bytes, r.scale, strict=True)]
        wanted = {v for lists in near[block * 1024 : (block + 1) * 1024] for v in lists or ()}
        assert sorted(got) == [(v, str(v).encode(), 2.0 * v) for v in sorted(wanted)]


def test_few_rows_give_all_candidates(spark):
    rows = [(i, [float(i), 1.0], 0, 0, 0) for i in range(5)] + [(20, [1.0, 1.0], 0, 0, 0)]
    found = rows_of(neighbours.nearest_rows(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert [v for _, v, _ in found[0]] == [1, 2, 3, 4, 20] and [v for _, v, _ in found[20]] == [4, 3, 2, 1, 0]
    for few in (0, 1):
        empty = spark.createDataFrame(rows, SCHEMA).limit(few)
        assert neighbours.nearest_rows(empty, F.col("vec_id") % 20 == 0).collect() == []


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding"]
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns, name
        if name == "n-gram Jaccard join":
            groups = queries.ngram_join.similar_components(docs)
            assert after.count() == groups.select("component_id").distinct().count()
        docs = after
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and coded.count() == docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, coded.collect()))


def test_pipeline_of_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    given = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None), (10**6, ""), (10**6 + 1, None), (10**6 + 2, "one two three four five " * 30), (None, "x " * 60)], "doc_id bigint, text string")
    docs = given.unionByName(odd.unionByName(odd), allowMissingColumns=True)
    docs = docs.withColumns({"score": F.lit("a"), "n_lines": F.lit(1), "size": F.lit(2), "component_id": F.lit(3), "_kept_0": F.lit(4)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
    assert docs.where("score = 'a'").count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), sf).collect() == [], name
