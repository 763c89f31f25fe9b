from pyspark.sql import functions as F

from siltstone.operators import duplicates, skew
from siltstone.operators.duplicates import all_issues, duplicate_issues


def same(functions, n, files):
    return functions(*[(i, files(i), None, f"f{i}", f"def f():\n    # {i}\n    return  1", (), ()) for i in range(n)])


def test_one_issue_per_member(functions):
    frame = functions(
        (1, "a.py", None, "f", "def f():\n  x = 1", (), ()),
        (2, "b.py", "C", "g", "# note\ndef  f():\n\n\tx =  1", (), ()),
        (3, "a.py", None, "h", "def f():\n  x = 1\n", (), ()),
        (4, "a.py", None, "k", "def f():\n  x = 2", (), ()),
    )
    found = {r.func_id: r for r in duplicate_issues(frame).collect()}
    assert {i: r.explanation.split("; ")[0] for i, r in found.items()} == {
        1: "The same code is in 1 functions of other files",
        2: "The same code is in 2 functions of other files",
        3: "The same code is in 1 functions of other files",
    }
    assert all(r.explanation.endswith(" has 3 members.") for r in found.values())
    row = found[2]
    assert (row.class_name, row.lines, row.category, row.severity, row.lead_id, row.phase) == (
        "C", [1, 4], "duplication", "Medium", 1, 1)


def test_members_of_one_file_have_none_elsewhere(functions):
    found = duplicate_issues(same(functions, 2, lambda i: "a.py")).collect()
    assert all(r.explanation.startswith("The same code is in 0 functions of other files;") for r in found)


def test_modes(functions):
    frame = functions(
        (1, "a.py", None, "f", 'def f():\n  """d"""\n  return 1', (), ()),
        (2, "b.py", None, "f", 'def f():\n  """d"""\n  return 2', (), ()),
    )
    assert duplicate_issues(frame).count() == 2
    assert duplicate_issues(frame, "balanced").count() == 0


def test_groups_of_any_size_have_one_form(spark, functions):
    one = functions((0, "x.py", None, "f", "def f():\n    return 1", (), ()))
    frame = one.drop("func_id").crossJoin(spark.range(10_000).withColumnRenamed("id", "func_id")).withColumn("file", F.concat(F.lit("m"), F.col("func_id") % 100))
    found = duplicate_issues(frame)
    shapes = found.groupBy(F.regexp_replace("explanation", "group [0-9a-f]+", "group x").alias("e")).count().collect()
    assert [tuple(r) for r in shapes] == [
        ("The same code is in 9900 functions of other files; duplicate group x has 10000 members.", 10_000)]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    files = duplicates.duplicate_group_files(duplicates.durable(duplicates.fingerprints(frame)))
    assert {(r.file, r.functions) for r in files.collect()} == {(f"m{i}", 100) for i in range(100)}


def test_hot_group_is_not_gathered(functions, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    frame = same(functions, 60, lambda i: f"m{i}.py").unionByName(
        functions(*[(100 + i, f"n{i}.py", None, "g", f"def g():\n  return {i // 2}", (), ()) for i in range(40)])
    )
    prints = duplicates.durable(duplicates.fingerprints(frame))
    members = duplicates.duplicate_members(prints)
    counts = {r.members: r["count"] for r in members.groupBy("members").count().collect()}
    assert counts == {60: 60, 2: 40}
    assert "Union" in members._jdf.queryExecution().optimizedPlan().toString()


def test_all_issues_order(functions):
    frame = same(functions, 3, lambda i: "a.py")
    rows = all_issues(frame).orderBy("phase", "lead_id", "func_id", "rule_pos").collect()
    assert [(r.func_id, r.rule_id) for r in rows] == [(0, "R15"), (1, "R15"), (2, "R15"), (0, "D1"), (1, "D1"), (2, "D1")]
    assert set(rows[0].asDict()) == {f for f in rows[-1].asDict()}


def test_counting_needs_no_listing(functions):
    counted = all_issues(same(functions, 3, lambda i: "a.py"), texts=False).groupBy("category").count()
    assert {r.category: r["count"] for r in counted.collect()} == {"documentation": 3, "duplication": 3}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and F is not None
