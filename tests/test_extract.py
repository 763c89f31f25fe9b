import pytest

from siltstone.operators import extract
from siltstone.operators.extract import extract_functions, locate_functions, unread_files
from siltstone.schemas import FILES, FUNCTIONS

SOURCES = {
    "a.py": "import os\n\ndef one():\n    pass\n\n@dec\ndef two():\n    pass\n\nasync def three(): pass\nif True:\n    def four():\n        pass\n",
    "b.py": "class A:\n    def m(self):\n        def inner(): pass\n    class B:\n        def n(self, *a, k=1, **kw): pass\n    def o(self): pass\n",
    "c.py": "def f():\n    if a:\n        for x in y:\n            pass\n    elif b:\n        pass\n",
    "d.py": "def f():\n    f(g(1))\n    a.b()\n    a.b.c()\n    (lambda: h())()\n",
    "e.py": "import os\nfrom a import b\ndef f(): pass\nimport late\n",
    "f.js": "function decl(a) {\n  if (a) { for (let i = 0; i < 2; i++) {} }\n}\nclass K {\n  method(x) { return 1; }\n}\nconst h = (a) => a\nlist.map(y => y)\n",
    "g.java": "class G {\n  G(int a) {}\n  /** doc */\n  @Override\n  public int add(int a, List<String> b) {\n    if (a > 0) { return a; }\n    return 0;\n  }\n}\n",
    "broken.py": "def f(:\n",
    "null.py": "def f():\n    pass\n\0",
}
LANGUAGE = {"py": "python", "js": "javascript", "java": "java"}


def located(spark, text, language, **options):
    return locate_functions(spark.createDataFrame([("x", language, text)], FILES), **options).orderBy("pos").collect()


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(p, LANGUAGE[p.rsplit(".")[-1]], text) for p, text in SOURCES.items()]
    frame = extract_functions(spark.createDataFrame(rows, FILES))
    assert [(f.name, f.dataType.simpleString()) for f in frame.schema] == [(f.name, f.dataType.simpleString()) for f in FUNCTIONS]
    found = {}
    for row in frame.orderBy("file", "start_line").collect():
        found.setdefault(row.file, []).append(row)
    return found


def test_python_functions(extracted):
    assert [(r.function, r.start_line, r.end_line, r.class_name) for r in extracted["a.py"]] == [
        ("one", 3, 4, None), ("two", 7, 8, None), ("three", 10, 10, None), ("four", 12, 13, None)]
    assert extracted["a.py"][1].code == "def two():\n    pass"
    assert extracted["a.py"][3].code == "    def four():\n        pass"


def test_classes_and_parameters(extracted):
    assert [(r.class_name, r.function, r.parameters) for r in extracted["b.py"]] == [
        ("A", "m", ["self"]), ("B", "n", ["self", "a", "k", "kw"]), ("A", "o", ["self"])]


def test_depth_calls_imports(extracted):
    assert extracted["c.py"][0].nesting_depth == 5
    assert extracted["d.py"][0].calls == ["a.b", "c", "f"]
    assert extracted["e.py"][0].imports == ["import os", "from a import b"]


def test_javascript(spark, extracted):
    assert [(r.class_name, r.function, r.start_line, r.end_line, r.parameters) for r in extracted["f.js"]] == [
        (None, "decl", 1, 3, ["a"]), ("K", "method", 5, 5, ["x"]), (None, "h", 7, 7, ["a"])]
    assert extracted["f.js"][0].nesting_depth == 2
    assert [r.function for r in located(spark, SOURCES["f.js"], "javascript", compat=True)] == ["decl", "y"]


def test_java(extracted):
    (row,) = extracted["g.java"]
    assert (row.class_name, row.function, row.start_line, row.end_line, row.parameters, row.nesting_depth) == (
        "G", "add", 4, 8, ["a", "b"], 3)
    assert row.calls == [] and not row.has_docstring


def test_unreadable_files_give_no_rows(extracted):
    assert "broken.py" not in extracted and "null.py" not in extracted


def test_ids_differ(extracted):
    ids = [r.func_id for rows in extracted.values() for r in rows]
    assert len(set(ids)) == len(ids)


def test_strings_and_comments_hide_brackets(spark):
    text = "function a() { return \"}\"; // }\n/* } */ let t = `}`; let r = /[}]/; }\nfunction b() {}\n"
    assert [(r.function, r.start_line, r.end_line) for r in located(spark, text, "javascript")] == [("a", 1, 2), ("b", 3, 3)]


def test_expressions_are_not_declarations(spark):
    text = "const a = function named() {};\nexport default function kept() {}\nfoo(function cb() {});\n"
    assert [r.function for r in located(spark, text, "javascript")] == ["kept"]


def test_another_language_can_be_added(spark):
    files = spark.createDataFrame([("x.sql", "sql", "select 1\nselect 2")], FILES)
    rows = extract_functions(files, outliners={"sql": lambda text: [(None, "q", 2, 2, [], 0, [])]}).collect()
    assert [(r.function, r.code) for r in rows] == [("q", "select 2")]


def test_value_after_a_long_comment(spark):
    text = "foo(/*" + " c" * 5000 + "*/ function bar(a) {\n});\nfunction kept() {}\nreturn  \n\n function no() {}\n"
    assert [r.function for r in located(spark, text, "javascript")] == ["kept"]


def test_long_branch_chain(spark):
    text = "def f(x):\n    if x == 0:\n        pass\n" + "".join(f"    elif x == {i}:\n        pass\n" for i in range(5000))
    assert [(r.function, r.nesting_depth) for r in located(spark, text, "python")] == [("f", 3)]


def test_unread_files_are_counted(spark):
    rows = [(p, LANGUAGE[p.rsplit(".")[-1]], text) for p, text in SOURCES.items()]
    assert {r.path for r in unread_files(spark.createDataFrame(rows, FILES)).collect()} == {"broken.py", "null.py"}


def test_files_with_equal_text_are_read_once(spark, monkeypatch):
    text = "class A:\n    def f(self, a):\n        g(\"(\")\n"
    rows = [(f"a{i}.py", "python", text) for i in range(5)] + [("b.py", "python", "def h(): pass"), ("x.js", "javascript", text), ("bad.py", "python", "def f(:\n  )]")]
    files = spark.createDataFrame(rows, FILES)
    read = []
    kept = extract.locate_functions
    monkeypatch.setattr(extract, "locate_functions", lambda f, **more: read.append(f.count()) or kept(f, **more))
    found = {(r.file, r.class_name, r.function, r.code) for r in extract_functions(files).collect()}
    body = text.split("\n", 1)[1].rstrip("\n")
    assert found == {(f"a{i}.py", "A", "f", body) for i in range(5)} | {("b.py", None, "h", "def h(): pass")}
    assert read == [4]


def test_unread_files_by_brackets_and_open_strings(spark):
    texts = {"ok": "f(a[{1: '('}])", "shut": ")(", "cross": "(a[b)]", "left": "(\n(\n)", "open": "x = '''\n", "none": "x = 1", "lines": "f(\n[\n]\n)"}
    files = spark.createDataFrame([(n, "python", t) for n, t in texts.items()], FILES)
    assert {r.path for r in extract.unread_files(files).collect()} == {"shut", "cross", "left", "open"}


IN_ROWS = {
    "calls": "def f(a=g(1)):\n    x[h()].y(k()).z(q())[r()]\n    ((s)())(t())\n    return u.v(\n        w(),\n    ) or (\n        1.5.real, \"(\".join(a) \\\n        .strip())\n",
    "names": "async def f(\n    self, a: t[int] = [1, (2, b)], *c, d=lambda e, g: e, h=1 < 2, i=3 > 2, **k\n) -> r(1): pass\ndef g[T](u): pass\ndef h\n",
    "blocks": "class A:\n  def f(self):\n\tif a:\n\t\tfor b in c: pass\n\telse:\n\t\tclass B:\n\t\t\tdef g(): pass\n  # c\n  x = 1\n"
    "class C(A): \n  class D:\n    match x:\n      case 1:\n        def h():\n          match(a)\n\n  def i(): 1\n",
    "strings": "def f():\n    \"\"\" def g():\n    ( \"\"\"; a()\n    b = 'x\\\n    (y'; c()\n    return r'd()', f'{e()}' # g()\n\ndef h(): '''\n'''\n",
    "quote": "def f():\n  a = 'b''c'\n  d = 'e'\"f\n",
    "open": "def f():\n  '''\n",
    "shut": "def f():\n  (]\n",
    "none": "",
}


def test_texts_read_in_their_row_or_as_lines_and_tokens_agree(spark, monkeypatch):
    rows = [(name, "python", text) for name, text in (SOURCES | IN_ROWS).items() if not name.endswith((".js", ".java"))]
    rows += [("calls.py", "python", IN_ROWS["calls"]), ("calls", "python", "def other(): pass"), (None, "python", "def f(): pass"), ("nothing", "python", None)]
    files = spark.createDataFrame(rows, FILES)

    def read():
        return sorted(map(str, locate_functions(files).collect()))

    with monkeypatch.context() as short:
        short.setattr(extract, "_locate_by_rows", lambda *_: pytest.fail("short texts became rows"))
        in_place = read()
    monkeypatch.setattr(extract, "IN_PLACE", -1)
    assert in_place == read()
    # A path that repeats, strings and brackets that do not close have none.
    assert [sum(f"path='{n}'" in r for r in in_place) for n in ("names", "blocks", "strings", "calls.py", "calls", "open", "shut")] == [3, 3, 2, 1, 0, 0, 0]
