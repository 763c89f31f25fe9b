import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import answers, ordering, vectors
from siltstone.operators.ordering import with_position
from siltstone.operators.vectors import nearest, nearest_batch, where_equal
from siltstone.sources.tables import Collections


def frame(spark, matrix, name, ids=None, **more):
    rows = [(ids[i] if ids else i, [float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(matrix)]
    kind = "string" if ids else "bigint"
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<float>" + "".join(f", {c} string" for c in more)).repartition(3)


def brute(queries, rows, k, ids, allowed=None):
    out = set()
    for q, v in enumerate(queries):
        d = ((rows - v) ** 2).sum(axis=1)
        keep = [i for i in range(len(rows)) if allowed is None or allowed(q, i)]
        for rank, i in enumerate(sorted(keep, key=lambda i: (d[i], ids[i]))[:k], 1):
            out.add((q, rank, ids[i], round(float(d[i]), 6)))
    return out


def collected(hits):
    return {(r.query_id, r["rank"], r.id, round(r.distance, 6)) for r in hits.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    rows[50:120] = rows[0]  # many equal vectors
    return rows[:40] + np.float32(0), rows


@pytest.mark.parametrize("shipped", [8192, 5])  # the second goes through the grid
def test_nearest_is_exact(spark, data, monkeypatch, shipped):
    monkeypatch.setattr(vectors, "GRID_QUERIES", 16)
    monkeypatch.setattr(vectors, "GRID_BYTES", 8 * 8 * 70)
    queries, rows = data
    names = [f"r{i * 7 % 300:03d}" for i in range(300)]
    hits = nearest(frame(spark, queries, "query_id"), frame(spark, rows, "id", names), 4, shipped_queries=shipped)
    assert collected(hits) == brute(queries, rows, 4, names)


def test_scope_and_small_corpus(spark, data):
    queries, rows = data
    asked = frame(spark, queries[:4], "query_id", scope=["a", "b", None, "none"])
    scopes = ["ab"[i % 2] for i in range(5)]
    corpus = frame(spark, rows[:5], "id", scope=scopes)
    allowed = lambda q, i: [True, True, True, False][q] and (q == 2 or scopes[i] == "ab"[q])
    assert collected(nearest(asked, corpus, 9)) == brute(queries[:4], rows[:5], 9, list(range(5)), allowed)


def test_cosine(spark, data):
    queries, rows = data
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = {(q, r, i, round(d / 2, 6)) for q, r, i, d in brute(unit(queries), unit(rows), 1, list(range(300)))}
    hits = collected(nearest(frame(spark, queries, "query_id"), frame(spark, rows * 3, "id"), 1, metric="cosine"))
    assert {(q, i) for q, _, i, _ in hits} == {(q, i) for q, _, i, _ in expected}
    assert max(abs(d) for *_, d in hits) < 1e-6
    with pytest.raises(ValueError):
        nearest(frame(spark, queries, "query_id"), frame(spark, rows, "id"), 1, metric="l1")


def test_empty_sides_and_missing_vectors(spark, data):
    queries, rows = data
    asked, corpus = frame(spark, queries, "query_id"), frame(spark, rows, "id")
    assert nearest(asked.limit(0), corpus, 3).count() == 0
    assert nearest(asked, corpus.limit(0), 3).count() == 0
    gaps = corpus.withColumn("vector", F.when(F.col("id") > 9, F.col("vector")))
    assert nearest(asked, gaps, 1).where("id <= 9").count() == 0


def test_batch_keeps_repeats(spark, data):
    queries, rows = data
    asked = frame(spark, queries[:3], "query_id").withColumn("sub", F.explode(F.array(F.lit(1), F.lit(2))))
    hits = nearest_batch(asked, frame(spark, rows, "id"), 2)
    assert hits.count() == 12
    assert hits.groupBy("query_id", "id").count().where("count <> 2").count() == 0


def test_collections(spark, functions, tmp_path):
    rows = functions((5, "a.py", "C", "f", "x", ["g"], ()), (2, "b.py", None, "g", "y", (), ()))
    store = Collections(spark, str(tmp_path))
    code = vectors.code_rows(rows)
    assert {r.id for r in code.collect()} == {"a.py::C::f::1", "b.py::None::g::0"}
    store.reset_code(code)
    store.add_code(code.limit(0))
    store.add_code(vectors.code_rows(rows.where("func_id = 2")))
    assert store.code().count() == 3
    assert {r.calls for r in vectors.metadata_json(code).collect()} == {'["g"]', "[]"}
    issues = spark.createDataFrame(
        [(0, 1, 1, 1, "a.py", None, "f", [1, 2], "security", "i", "High", "why", "how"), (0, 2, 2, 3, "a.py", "C", "f", [1, 2], "complexity", "j", "Low", "w", "h")],
        "phase int, lead_id bigint, func_id bigint, rule_pos int, file string, class_name string, function string, lines array<int>, "
        "category string, issue string, severity string, explanation string, suggestion string",
    )
    store.reset_issues(vectors.issue_rows(issues))
    assert {(r.id, r.document) for r in store.issues().collect()} == {("a.py::::f::issue0", "why how"), ("a.py::C::f::issue1", "w h")}
    chosen = where_equal(store.issues(), category="security", file=None)
    assert chosen.count() == 1
    assert "PartitionFilters: [isnotnull(category" in chosen._jdf.queryExecution().executedPlan().toString()
    found = vectors.by_id(store.code(), spark.createDataFrame([("b.py::None::g::0",)], "id string")).collect()
    assert {r.document for r in found} == {"y"}


def test_search_returns_documents(spark, functions):
    rows = functions((1, "a.py", "C", "open_file", "open file handle", (), ()), (2, "b.py", None, "add", "sum numbers", (), ()))
    code = vectors.hashing_embed(vectors.code_rows(rows))
    asked = spark.createDataFrame([(7, "open the file")], "query_id bigint, document string")
    asked = vectors.hashing_embed(asked).withColumnRenamed("embedding", "vector")
    (hit,) = vectors.search_code(asked, code, 1).collect()
    assert (hit.query_id, hit.document, hit.metadata.function) == (7, "open file handle", "open_file")
    assert vectors.search_code(asked, code, 3, file="b.py").first().id == "b.py::None::add::1"


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    numbered = with_position(rows, "g", "k", first=1).collect()
    assert [r.position for r in sorted(numbered, key=lambda r: (r.g, r.k))] == list(range(1, 1001))


def test_hit_context(spark, functions):
    rows = functions((1, "a.py", None, "f", "x", ["h"], ["from b import q"]), (2, "a.py", None, "g", "x", (), ()), (3, "b.py", None, "h", "x", (), ()))
    from siltstone.operators.graph import build_graph

    hits = spark.createDataFrame([(9, 1, 1, 0.0), (9, 2, 3, 0.5)], "query_id bigint, rank int, id bigint, distance double")
    collection = rows.select(F.col("func_id").alias("id"), "file")
    found = {r.id: tuple(r)[4:] for r in answers.code_with_context(hits, collection, build_graph(rows)).collect()}
    assert found == {1: (0, 3, 1), 3: (1, 1, 0)}


def test_answers(spark, data):
    _, rows = data
    code = frame(spark, rows[:7], "id")
    issues = frame(spark, rows[:30], "id", category=["security" if i < 12 else "documentation" for i in range(30)])
    asked = spark.createDataFrame(
        [(i, q, [0.0] * 8) for i, q in enumerate(["Any SECRET here?", "slow loop", "copy of docstring", "comment", "nested", "hello", "secret"])],
        "question_id bigint, question string, vector array<float>",
    )
    found = {r.question_id: r for r in answers.answer_questions(asked, code, issues).collect()}
    assert {i: (r.type, r.issues_found, r.code_found) for i, r in found.items()} == {
        0: ("security", 10, 5), 1: ("performance", 0, 5), 2: ("duplication", 0, 0), 3: ("documentation", 10, 0),
        4: ("complexity", 0, 0), 5: ("general", 5, 5), 6: ("security", 10, 5)}
    assert found[0].summary == "Found 10 security issues and 5 related code functions."
    assert found[5].summary == "Found 5 relevant code functions and 5 related issues."


@pytest.mark.parametrize("shipped", [8192, 0])
def test_odd_components_lose_no_hits(spark, shipped):
    rows = [[0.0, 1.0], [float("nan"), 1.0], [1e20, 1.0], [float("inf"), 0.0], [0.0, 1.5], [None, 1.0]]
    corpus = spark.createDataFrame(list(enumerate(rows)), "id bigint, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1e20, 1.0])], "query_id bigint, vector array<float>")
    found = {(r.query_id, r["rank"]): r.id for r in nearest(asked, corpus, 2, shipped_queries=shipped).collect()}
    assert found[0, 1] == 0 and found[0, 2] == 4 and found[1, 1] == 2 and len(found) == 4


def test_many_equal_vectors(spark):
    corpus = spark.range(10_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    found = nearest(asked, corpus, 3).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert len(found) == 300 and all(r.ids == [0, 1, 2] for r in found)


def test_rows_that_share_vectors_are_compared_once(spark, monkeypatch):
    """Each vector meets a query once, however many rows hold it, with the hits of all rows."""
    held = spark.createDataFrame([(v, [float(v), 0.0]) for v in range(4)] + [(4, None)], "vec_id bigint, vector array<float>")
    rows = spark.range(400).selectExpr("id", "id % 5 AS vec_id", "if(id % 2 = 0, 'a', 'b') AS scope")
    asked = spark.range(30).selectExpr("id AS query_id", "id % 6 AS vec_id")
    plain = vectors.nearest(asked.join(held, "vec_id"), rows.drop("scope").join(held, "vec_id"), 3).collect()
    seen = []
    kept = vectors._searched
    monkeypatch.setattr(vectors, "_searched", lambda q, c, *rest: seen.append((q.count(), c.count())) or kept(q, c, *rest))
    for shipped in (100, 2):
        shared = vectors.nearest(asked, rows.drop("scope"), 3, vectors=held, shipped_queries=shipped).collect()
        assert sorted(shared) == sorted(plain)
    assert seen == [(4, 4), (4, 4)]
    scoped = asked.withColumn("scope", F.lit("b"))
    plain = vectors.nearest(scoped.join(held, "vec_id"), rows.join(held, "vec_id"), 3).collect()
    assert sorted(vectors.nearest(scoped, rows, 3, vectors=held).collect()) == sorted(plain)


def test_cosine_finds_the_nearest_beside_a_row_of_length_zero(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], "id bigint, vector array<double>")
    assert [h["id"] for h in vectors.nearest(queries, corpus, 1, metric="cosine").collect()] == [2]


def test_large_tables_are_numbered_in_more_parts(spark, monkeypatch):
    """What one task sorts does not grow with the table."""
    parts = []
    kept = ordering.durable
    monkeypatch.setattr(ordering, "durable", lambda df: parts.append(df.rdd.getNumPartitions()) or kept(df))
    monkeypatch.setattr(ordering, "SORTED_ROWS", 50)
    rows = with_position(spark.range(2000), "id", name="n")
    assert rows.where("n <> id").isEmpty()
    assert parts == [40]
