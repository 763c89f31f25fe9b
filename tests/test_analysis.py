import zipfile

from siltstone.plans.analysis import analyze
from siltstone.sources.tables import Collections
from siltstone.streaming.rules_stream import run_available_files, stream_fingerprints, stream_issues, stream_tree

SOURCES = {
    "a.py": "import b\n\ndef f(x):\n    return eval(x)\n\ndef g():\n    return f(1)\n",
    "b.py": "class K:\n    def f(self, x):\n        '''\n        doc\n        '''\n        return g()\n",
    "web/c.js": "function f(a) {\n  el.innerHTML = a;\n}\n",
    "build/skipped.py": "def f(): eval(1)\n",
}


def write(root):
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def summary_of(result):
    row = result.summary().first()
    return row.total_functions, row.files_analyzed, row.total_issues, row.dependencies, row.issues_by_category, row.issues_by_severity


def test_analyze_a_tree(spark, tmp_path):
    result = analyze(spark, write(tmp_path / "src"), str(tmp_path / "out"))
    assert {(r.file, r.class_name, r.function) for r in result.functions.collect()} == {
        ("a.py", None, "f"), ("a.py", None, "g"), ("b.py", "K", "f"), ("web/c.js", None, "f")}
    edges = {(r.src, r.dst, r.type) for r in result.graph.edges().collect()}
    assert edges == {
        ("a.py", "b.py", "imports"), ("a.py", "a.py::f", "contains_function"), ("a.py", "a.py::g", "contains_function"),
        ("b.py", "b.py::K", "contains"), ("b.py::K", "b.py::K::f", "has_method"), ("web/c.js", "web/c.js::f", "contains_function"),
        ("a.py::g", "a.py::f", "calls"), ("b.py::K::f", "a.py::g", "calls"), ("a.py::f", "a.py::eval", "calls")} - {("a.py::f", "a.py::eval", "calls")}
    found = {(r.file, r.function, r.rule_id) for r in result.issues.collect()}
    assert found == {("a.py", "f", "R1"), ("a.py", "f", "R5"), ("a.py", "f", "R15"), ("a.py", "g", "R15"), ("web/c.js", "f", "R7"), ("web/c.js", "f", "R15")}
    assert summary_of(result) == (4, 3, 6, 8, {"documentation": 3, "security": 3}, {"High": 3, "Low": 3})
    annotated = {r.id: r.total_issues for r in result.annotated_nodes().collect()}
    assert (annotated["a.py"], annotated["b.py"], annotated["a.py::f"]) == (4, 0, 0)
    assert result.report().count() == 4 and result.prompts().count() == 1
    store = Collections(spark, str(tmp_path / "out"))
    assert (store.code().count(), store.issues().count()) == (4, 6)
    assert any("### Issue 3" in p.read_text() for p in (tmp_path / "out" / "report").glob("part-*"))


def test_archive_and_single_file_agree_with_the_tree(spark, tmp_path):
    root = write(tmp_path / "src")
    with zipfile.ZipFile(tmp_path / "repo.zip", "w") as archive:
        for name, text in SOURCES.items():
            archive.writestr(name, text)
    whole = analyze(spark, root, str(tmp_path / "o1"))
    packed = analyze(spark, str(tmp_path / "repo.zip"), str(tmp_path / "o2"))
    assert summary_of(whole) == summary_of(packed)
    single = analyze(spark, f"{root}/build/skipped.py", str(tmp_path / "o3"))
    assert [(r.function, r.file) for r in single.functions.collect()] == [("f", f"{root}/build/skipped.py")]


def test_empty_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "notes.md").write_text("nothing")
    result = analyze(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    assert summary_of(result) == (0, 0, 0, 0, {}, {})
    assert [r.number for r in result.report().collect()] == [0]


def test_streams_equal_batches(spark, tmp_path):
    root = write(tmp_path / "src")
    batch = analyze(spark, root, str(tmp_path / "out"))
    files = stream_tree(spark, root)
    out, state = str(tmp_path / "rows"), str(tmp_path / "state")
    streamed = run_available_files(files, stream_issues, out, state)
    rules = batch.issues.where("phase = 0")
    key = ("file", "function", "rule_id", "severity")
    assert sorted(map(tuple, streamed.select(*key).collect())) == sorted(map(tuple, rules.select(*key).collect()))
    (tmp_path / "src" / "late.py").write_text("def late(): exec('')\n")
    again = run_available_files(files, stream_issues, out, state)
    assert {r.rule_id for r in again.where("file = 'late.py'").collect()} == {"R1", "R15"}
    prints = run_available_files(files, stream_fingerprints)
    assert prints.count() == 5
