import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.config import DEFAULT_DIRS, DEFAULT_PATTERNS, ScanConfig
from siltstone.functions.text import file_suffix, language_of, matches_glob, under_directory
from siltstone.sources.tree import scan_archives, scan_file, scan_tree

TREE = {
    "a.py": b"def f():\n    return 1\n",
    "sub dir/B.PY": b"x = 1\r\ny = 2\r",
    "build/x.py": b"def g(): pass\n",
    "sub dir/node_modules/lib.js": b"function h() {}\n",
    "a.egg-info/y.py": b"z = 1\n",
    "h.min.js": b"function m() {}\n",
    "notes.md": b"# no code\n",
    "bad.py": b"\xff\xfe\x00",
    "e.tsx": "const é = 1".encode(),
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path / "root"


def test_scan_tree(spark, tree):
    rows = {r.path: (r.language, r.content) for r in scan_tree(spark, str(tree)).collect()}
    assert rows == {
        "a.py": ("python", "def f():\n    return 1\n"),
        "sub dir/B.PY": ("python", "x = 1\ny = 2\n"),
        "a.egg-info/y.py": ("python", "z = 1\n"),
        "e.tsx": ("javascript", "const é = 1"),
    }


def test_excluded_files_are_never_opened(spark, tree):
    scanned = scan_tree(spark, str(tree), ScanConfig().add_dir("sub dir").add_pattern("e.*"))
    assert {r.path for r in scanned.collect()} == {"a.py", "a.egg-info/y.py"}
    plan = scanned._jdf.queryExecution().executedPlan()
    plan.execute().count()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 3  # bad.py is opened as well


def test_single_file_ignores_exclusions(spark, tree):
    path = str(tree / "build" / "x.py")
    assert [tuple(r) for r in scan_file(spark, path).collect()] == [(path, "python", "def g(): pass\n")]
    assert scan_file(spark, str(tree / "notes.md")).count() == 0


def test_archive(spark, tree, tmp_path):
    with zipfile.ZipFile(tmp_path / "repo.zip", "w") as archive:
        for name, content in TREE.items():
            archive.writestr(f"repo-main/{name}", content)
    rows = {r.path for r in scan_archives(spark, str(tmp_path / "repo.zip")).collect()}
    assert rows == {f"repo-main/{n}" for n in ("a.py", "sub dir/B.PY", "a.egg-info/y.py", "e.tsx")}


def test_config_is_idempotent():
    config = ScanConfig().add_pattern("*.gen.py").add_pattern("*.gen.py").add_dir("x")
    assert config.patterns == (*DEFAULT_PATTERNS, "*.gen.py") and config.dirs[-1] == "x"
    assert config.remove_pattern("*.gen.py").remove_pattern("absent").patterns == DEFAULT_PATTERNS
    assert config.remove_dir("x").dirs == DEFAULT_DIRS
    assert ScanConfig(patterns=(), dirs=()) == ScanConfig()
    assert ScanConfig(patterns=("q",)).remove_pattern("q").patterns == ()


def test_no_exclusions_left(spark, tree):
    config = ScanConfig(patterns=("q",), dirs=("q",)).remove_pattern("q").remove_dir("q")
    assert scan_tree(spark, str(tree), config).count() == 7


def test_suffix_and_language(spark):
    cases = {"a.py": "python", "x/.py": None, ".py": None, "a.b.JSX": "javascript", "a.java": "java", "d.py/x": None, "a.": None}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", language_of(F.col("p")).alias("l"), file_suffix(F.col("p")))
    assert {r.p: r.l for r in rows.collect()} == cases


def test_globs_match_as_the_shell_does(spark):
    import fnmatch

    globs = ["*.min.js", "src*", "a?c.py", "[ab]x.py", "[!ab]y.py", "x[", "*.p[yz]", "we+ird(1).py", "[]]z.py"]
    paths = ["k/a.min.js", "src/x.py", "a/c.py", "abc.py", "ax.py", "cx.py", "cy.py", "ay.py", "x[", "q.pz", "q.pa",
             "we+ird(1).py", "d/we+ird(1).py", "]z.py", "line\nbreak.min.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for glob in globs:
        found = {r.p for r in rows.where(matches_glob(F.col("p"), [glob])).collect()}
        expected = {p for p in paths if fnmatch.fnmatchcase(p, glob) or fnmatch.fnmatchcase(p.split("/")[-1], glob)}
        assert found == expected, glob


def test_directory_names_match_whole(spark):
    paths = ["build/a.py", "rebuild/a.py", "x/build/y/a.py", "build", "x/build"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p for r in rows.where(under_directory(F.col("p"), ["build"])).collect()} == {"build/a.py", "x/build/y/a.py"}
