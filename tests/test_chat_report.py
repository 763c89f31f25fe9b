import random

from pyspark.sql import functions as F

from siltstone.operators import chat, report
from siltstone.schemas import ISSUES
from siltstone.sources import tables


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)


def window_spec(rows, size=5):
    out, by_conv = {}, {}
    for conv, turn, role, text in sorted(rows):
        if role in ("user", "assistant"):
            by_conv.setdefault(conv, []).append((turn, role, text))
    for conv, turns in by_conv.items():
        past = []
        for (turn, role, text), (_, next_role, reply) in zip(turns, turns[1:]):
            if role == "user" and next_role == "assistant" and "think" not in text:
                out[conv, turn] = (len(past[-size:]), "\n".join(past[-size:]))
                past.append(f"user:{text}\nbot:{reply}")
    return out


def test_windows_over_uneven_conversations(spark):
    rng = random.Random(0)
    roles = ["user", "user", "assistant", "assistant", "system"]
    rows = [(0 if i < 300 else rng.randrange(1, 20), i * 3, rng.choice(roles), f"t{i}" + (" think" if i % 11 == 0 else "")) for i in range(600)]
    found = {(r.conv_id, r.turn): (r.exchanges, r.window_text) for r in chat.last_exchanges(conversation(spark, rows)).collect()}
    assert found == window_spec(rows)
    assert max(n for n, _ in found.values()) == 5


def test_memory(spark):
    turns = conversation(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")])
    assert {(r.id, r.document, r.role) for r in chat.memory_rows(turns).collect()} == {("1:0", "user: hi", "user"), ("1:1", "assistant: hello", "assistant")}
    contexts = spark.createDataFrame([(1, 0, 2, "doc")], "conv_id bigint, turn bigint, pos int, text string")
    assert tuple(chat.context_rows(contexts).first()) == ("1:0:2", "doc", "context")


def test_confidence_gate_and_context(spark):
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0])], "query_id bigint, vector array<float>")
    memory = spark.createDataFrame([(10, [0.5, 0.0]), (11, [0.0, 1.0])], "id bigint, vector array<float>")
    confidences = chat.memory_confidence(asked, memory)
    assert {r.query_id: (r.hits, r.confidence) for r in confidences.collect()} == {1: (2, 0.75), 2: (2, -5.25)}
    assert {r.confidence for r in chat.memory_confidence(asked, memory.limit(0)).collect()} == {0.0}
    hits = chat.gated_code_hits(asked, confidences, memory)
    assert {r.query_id for r in hits.collect()} == {2}
    documents = spark.createDataFrame([(10, "ten"), (11, "eleven")], "id bigint, document string")
    texts = chat.context_text(asked, hits.join(documents, "id"))
    assert {r.query_id: r.text for r in texts.collect()} == {1: chat.NO_CONTEXT, 2: "ten\neleven"}


def issues(spark, *rows):
    full = [(0, i, i, 1, "R1", "a.py", None, f"f{i}", [1, 2], category, f"issue{i}", severity, why, how) for i, (category, severity, why, how) in enumerate(rows)]
    return spark.createDataFrame(full, ISSUES).repartition(3)


def test_report_order_and_priority(spark):
    found = issues(
        spark, ("security", "Medium", "w", "h"), ("duplication", "high", None, None), ("complexity", "High", "w", "h"), ("documentation", "Low", "w", "h"),
        ("other", "MEDIUM", "w", "h"), ("documentation", None, "w", "h"),
    )
    rows = report.with_priority(report.numbered(report.report_issues(found))).orderBy("number").collect()
    assert [(r.number, r.func_id, r.priority) for r in rows] == [(1, 1, "Medium"), (2, 2, "High"), (3, 0, "Medium"), (4, 4, "Medium")]
    assert rows[0].why.startswith("**Duplication:** No explanation provided\n\n") and rows[0].how == "No suggestion provided"
    assert rows[3].why == "w"


def test_report_text(spark, tmp_path):
    found = issues(spark, ("security", "High", "why", "how"), ("security", "Low", "why", "how"))
    tables.write_issues(found, str(tmp_path / "issues"))
    loaded = tables.load_report_issues(spark, str(tmp_path / "issues"))
    assert tables.read_issues(spark, str(tmp_path / "issues")).count() == 2 and loaded.count() == 1
    tables.write_report(report.report_sections(loaded), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.index("**Issues:** 1") < text.index("### Issue 1: issue0\n**File:** a.py (lines 1-2)") < text.index("**Priority:** High")


def test_empty_report(spark):
    rows = report.report_sections(issues(spark, ("security", "Low", "w", "h"))).collect()
    assert [(r.number, r.text) for r in rows] == [(0, report.EMPTY)]


def test_prompts_hold_four_issues_each(spark, functions):
    found = issues(spark, *[("security", "High", "w", "h")] * 9)
    code = functions(*[(i, "a.py", None, f"f{i}", f"code {i}", (), ()) for i in range(9)])
    prompts = {r.batch: r.prompt for r in report.batch_prompts(found, code).collect()}
    assert sorted(prompts) == [1, 2, 3]
    assert [f"code {i}" in prompts[i // 4 + 1] for i in range(9)] == [True] * 9
    assert prompts[3].count("### Issue") == 1 and "### Issue 1\nFile: a.py (lines 1-2)\nSeverity: High" in prompts[3]


def test_extract_lines(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4")], "path string, content string")
    asked = spark.createDataFrame([("a", 2, 3), ("a", 4, 9), ("a", 3, 2), ("b", 1, 1)], "path string, start_line int, end_line int")
    assert {(r.start_line, r.text) for r in report.extract_lines(asked, files).collect()} == {(2, "2\n3"), (4, "4"), (3, "")}


def test_function_sink(spark, functions, tmp_path):
    rows = functions((1, "a.py", None, "f", "x = 'é'", ["g"], ["import os"]))
    for fmt in ("json", "parquet"):
        tables.write_functions(rows, str(tmp_path / fmt), fmt)
        assert tables.read_functions(spark, str(tmp_path / fmt), fmt).collect() == rows.collect()
    assert F is not None


def test_debugging_turns_have_no_window(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "Think!"), (1, 4, "assistant", "c"),
            (1, 5, "user", None), (1, 6, "assistant", "d"), (1, 7, "user", "e"), (1, 8, "assistant", "f")]
    found = chat.last_exchanges(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {r.turn: r.window_text for r in found.collect()} == {
        1: "", 5: "user:a\nbot:b", 7: "user:a\nbot:b\nuser:\nbot:d"}
