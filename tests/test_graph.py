import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import import_target
from siltstone.operators.graph import annotate_nodes, build_graph, direct_impact, node_display, node_issues
from siltstone.operators.impact import reachable, transitive_impact

MODULES = ["import os.path", "from a import x", "from pkg.b import y", "import c"]


def random_functions(functions, seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        owner = rng.choice([None, None, "", "A", "n3"])
        calls = {f"n{rng.randrange(30)}" for _ in range(rng.randrange(4))} | ({"gone.x"} if i % 7 == 0 else set())
        rows.append((i, f"{rng.choice('abcdefg')}.py", owner, f"n{rng.randrange(30)}", "x", sorted(calls), rng.sample(MODULES, rng.randrange(3))))
    return rows, functions(*rows)


def graph_spec(rows):
    """Nodes and edges built one after the other, the last type staying."""
    target = {"import os.path": "os.py", "from a import x": "a.py", "from pkg.b import y": "pkg/b.py", "import c": "c.py"}
    ident = lambda f, c, n: f"{f}::{c}::{n}" if c else f"{f}::{n}"
    nodes, edges = {r[1]: "file" for r in rows}, {}
    for _, file, _, _, _, _, imports in rows:
        for statement in imports:
            nodes[target[statement]] = "imported_module"
            edges[file, target[statement]] = "imports"
    for _, file, owner, name, _, _, _ in rows:
        if owner:
            nodes[f"{file}::{owner}"] = "class"
            edges[file, f"{file}::{owner}"] = "contains"
        nodes[ident(file, owner, name)] = "function"
        edges[f"{file}::{owner}" if owner else file, ident(file, owner, name)] = "has_method" if owner else "contains_function"
    local = {(r[1], r[3]) for r in rows if not r[2]}
    for _, file, owner, name, _, calls, _ in rows:
        for callee in calls:
            found = [ident(file, None, callee)] if (file, callee) in local else [ident(r[1], r[2], r[3]) for r in rows if r[3] == callee]
            for dst in found:
                edges[ident(file, owner, name), dst] = "calls"
    return nodes, edges


def reach_spec(edges, start):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        for src, dst in edges:
            if src == at and dst not in seen:
                seen.add(dst)
                todo.append(dst)
    return seen - {start}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_its_definition(spark, functions, seed):
    rows, frame = random_functions(functions, seed)
    nodes, edges = graph_spec(rows)
    graph = build_graph(frame)
    assert {(r.src, r.dst): r.type for r in graph.edges().collect()} == edges
    assert graph.edges().count() == graph.edge_count().first().edges == len(edges)
    assert {r.id: r.type for r in graph.nodes.collect()} == nodes
    ids = spark.createDataFrame([(n,) for n in nodes], "id string")
    assert sorted(map(tuple, graph.successors(ids).collect())) == sorted(edges)
    assert sorted((r.neighbour, r.id) for r in graph.predecessors(ids).collect()) == sorted(edges)


def test_reachability_against_its_definition(spark, functions):
    rows, frame = random_functions(functions, 3)
    nodes, edges = graph_spec(rows)
    graph = build_graph(frame)
    ids = spark.createDataFrame([(n,) for n in [*nodes, "unknown"]], "id string")  # more than one word of bits
    issues = spark.createDataFrame([("a.py",)] * 3 + [("b.py",)], "file string")
    expected = {n: reach_spec(edges, n) for n in nodes}
    pairs = {}
    for r in reachable(graph, ids).collect():
        pairs.setdefault(r.seed, set()).add(r.id)
    assert pairs == {n: r for n, r in expected.items() if r}
    counts = {"a.py": 3, "b.py": 1}
    found = {r.id: tuple(r)[1:] for r in transitive_impact(graph, ids, issues).collect()}
    assert found == {
        n: (sum(src == n for src, _ in edges), len(r), sum(counts.get(x, 0) for x in r)) for n, r in expected.items()
    }


def test_two_functions_calling_each_other(spark, functions):
    frame = functions((1, "a.py", None, "f", "x", ["g"], ()), (2, "a.py", None, "g", "x", ["f"], ()))
    ids = spark.createDataFrame([("a.py::f",), ("a.py::g",)], "id string")
    assert {tuple(r) for r in reachable(build_graph(frame), ids).collect()} == {("a.py::f", "a.py::g"), ("a.py::g", "a.py::f")}


def test_a_shared_name_is_never_multiplied(functions):
    """Counting and reachability join callers and definitions by name only after grouping."""
    frame = functions(*[(i, f"m{i}.py", "C", "get", "x", ["get"], ()) for i in range(200)])
    graph = build_graph(frame)
    assert graph.edge_count().first().edges == 200 * 200 + 400
    assert graph.call_edges().count() == 40000


IMPORTS = {
    "from a.b import c": ("a/b.py", "a/b.py"),
    "import a.b as c": ("a.py", "a.py"),
    "  from\t. import y": (None, None),
    "from . import y": ("/.py", "/.py"),
    "import a, b": ("a,.py", "a,.py"),
    "import java.util.List;": ("java.py", "java/util/List.java"),
    "import fs from 'fs'": ("fs.py", "fs.js"),
    "const x = require('lib/y');": (None, "lib/y.js"),
    "import './side'": ("'.py", "./side.js"),
}


def test_import_targets(spark):
    rows = spark.createDataFrame([(s,) for s in IMPORTS], "s string")
    assert {r.s: r.t for r in rows.select("s", import_target(F.col("s")).alias("t")).collect()} == {s: t for s, (t, _) in IMPORTS.items()}
    language = F.when(F.col("s").contains(";") & F.col("s").startswith("import"), "java").when(F.col("s").rlike("['(]"), "javascript").otherwise("python")
    by_language = rows.select("s", import_target(F.col("s"), language).alias("t"))
    assert {r.s: r.t for r in by_language.collect()} == {s: t for s, (_, t) in IMPORTS.items()}


def test_annotation_and_display(spark, functions):
    graph = build_graph(functions((1, "p/a.py", "C", "f", "x", (), ()), (2, "p/b.py", None, "g", "x", (), ())))
    issues = spark.createDataFrame(
        [("p/a.py", "security", "High")] * 30 + [("p/a.py", "security", "Low"), ("p/b.py", "complexity", "Medium")],
        "file string, category string, severity string",
    )
    annotated = annotate_nodes(graph.nodes, issues)
    rows = {r.id: r for r in annotated.collect()}
    assert rows["p/a.py"].total_issues == 31 and rows["p/a.py"].issues_by_category == {"security": 31}
    assert rows["p/a.py"].severity_distribution == {"High": 30, "Low": 1}
    assert (rows["p/b.py::g"].total_issues, rows["p/b.py::g"].issues_by_category) == (0, {})
    assert node_issues(graph.nodes, issues).count() == 32
    shown = {r.id: tuple(r)[1:] for r in node_display(annotated).collect()}
    assert shown == {
        "p/a.py": ("p/a.py", "#ff4444", 40),
        "p/b.py": ("p/b.py", "#ffaa00", 16),
        "p/a.py::C": ("a.py\nC", "#44ff44", 15),
        "p/a.py::C::f": ("a.py\nC.f", "#44ff44", 15),
        "p/b.py::g": ("b.py\ng", "#44ff44", 15),
    }
    asked = spark.createDataFrame([("p/a.py",), ("none",)], "id string")
    impact = {r.id: r for r in direct_impact(graph, issues, asked).collect()}
    assert tuple(impact["p/a.py"])[1:] == (0, 1, 31, 30, 4.1, None)
    assert impact["none"].error and impact["none"].successors is None


def test_a_written_graph_reads_its_calls_from_files(spark, functions):
    rows = functions((1, "a.py", None, "f", "x", ["g", "f"], ["import b"]), (2, "b.py", "C", "g", "x", ["f"], []))
    plain, written = build_graph(rows), build_graph(rows, write=True)
    for part in ("references", "local_calls", "static_edges"):
        assert getattr(written, part).inputFiles()
        assert sorted(getattr(written, part).collect()) == sorted(getattr(plain, part).collect())
    assert written.edge_count().first() == plain.edge_count().first()
