"""Pages: main text and WARC archives."""

import gzip
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import content, queries, warc
from siltstone.llm.oracles import ORACLES
from siltstone.session import run_folder

FURNITURE = '<nav><ul><li><a href="/a">Home.</a></li><li><a href="/b">More, more.</a></li></ul></nav>'
BODY = "A first paragraph, with <b>bold</b> text &amp; signs.\n  And\tmore, of it."
SIDE = '<div class="sidebar">Side, text that is long. And longer, too.</div><aside>Aside, it is. Yes.</aside>'
END = "<footer>&copy; The site, all rights. Reserved.</footer>"


def page(inner):
    return f'<html><head><title>T, t.</title><style>p{{}}</style><script>var t="</p>"</script></head><body>{FURNITURE}{inner}{END}</body></html>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;  here", "plain <text> here"),
        (page(f"{SIDE}<article><h1>Head</h1><p>{BODY}<p>Short.</article>"),
         "Head\nA first paragraph, with bold text & signs. And more, of it.\nShort."),
        (page(f'<div class="ad">Buy, now!</div><article><p><b>Bold one<br><p>Two</p></b></article><div id="comments"><p>Nice, post.</p></div>'),
         "Bold one\nTwo"),
        (page(f'<div class="post"><h2>Title</h2><p>{BODY}</p><p>{BODY}</p></div><form><label>Mail, please.</label><input></form>'),
         "Title\n" + "\n".join(["A first paragraph, with bold text & signs. And more, of it."] * 2)),
        ("<article><p>cut off &am", "cut off &am"),
        ("<p>a<!-- no > end <p>b", "a"),
        ("<ul><li>x, one<li>y, two</ul></p></b>", "x, one\ny, two"),
    ],
)
def test_main_text(html, text):
    assert content.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f'<div class="layout has-sidebar"><article><p>{BODY}</article></div>'), ""),
        (page(f'<div class="content no-comments"><article><p>{BODY}</article></div>'), ""),
        (page(f'<article><h2 id="search-algorithm">Search</h2><p>{BODY}</article>'), "Search\n"),
        (page(f'<article><h2 id="related-work">Related</h2><section id="social-effects"><p>{BODY}</section></article>'), "Related\n"),
        (f"<form id=aspnet>{page(f'<article><p>{BODY}</article>')}</form>", ""),
        (f"<body><form><div><p>{BODY}</p></div></form></body>", ""),
        (page(f'<div class="sidebar"><main><p>{BODY}</main></div>'), ""),
    ],
)
def test_names_that_only_resemble_marks_drop_nothing(html, text):
    assert content.main_text(html) == text + "A first paragraph, with bold text & signs. And more, of it."


LONG = "This paragraph is long, has a comma or two, and ends with a stop. So does this one, which goes on a bit."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # An unmarked advert inside an article goes, in a short and in a long one.
        (page(f"<article><p>{LONG}</p><div>Buy cheap now</div><p>{LONG}</p></article>"), [LONG] * 2),
        (page(f"<article>{f'<p>{LONG}</p>' * 20}<div>Buy cheap now</div>{f'<p>{LONG}</p>' * 20}</article>"), [LONG] * 40),
        # A teaser article beside the real text does not stand for the page.
        (page(f"<article><p>Read this next one</p></article><div>{f'<p>{LONG}</p>' * 6}</div>"), [LONG] * 6),
        # Comments go, even where they are most of the page, with an article and without.
        (page(f'<div><p>{LONG}</p></div><div class="comments">{f"<p>{LONG}</p>" * 9}</div>'), [LONG]),
        (page(f'<article><p>{LONG}</p></article><div class="comments">{f"<p>{LONG}</p>" * 200}</div>'), [LONG]),
        # Short items and cells of an article stay, beside very long paragraphs too.
        (page(f"<article><p>{LONG}</p><ul>{'<li>An item</li>' * 20}</ul></article>"), [LONG] + ["An item"] * 20),
        (page(f"<article><p>{LONG * 20}</p><ul><li>One</li><li>Two</li></ul></article>"), [LONG * 20, "One", "Two"]),
        # Long unmarked text beside an article that holds the page's text goes; lists of links inside it go.
        (page(f"<article>{f'<p>{LONG}</p>' * 9}<ul><li><a href=x>Next, one</a></ul></article><div><p>{LONG}</p></div>"), [LONG] * 9),
        # An advert inside a form that holds the page; a heading in a header of its own.
        (f'<form>{page(f"<p>{LONG}</p><div class=ad><p>{LONG}</p></div>")}</form>', [LONG]),
        (page(f"<article><header><h1>Title</h1></header><div><p>{LONG}</p></div></article>"), ["Title", LONG]),
        # Nothing but headings, nothing but text in bare containers.
        ("<h1>One</h1><h1>Two</h1>", ["One", "Two"]),
        (f"<div>{LONG}</div><div>{LONG}</div>", [LONG] * 2),
    ],
)
def test_ratios_decide_and_names_are_a_prior(html, text):
    assert content.main_text(html) == "\n".join(text)


def test_long_broken_pages_take_linear_time():
    assert len(content.main_text("<" * 300_000)) >= 0
    assert content.main_text("<p a='" + "x" * 300_000) == ""
    assert content.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert content.main_text("<!--" * 50_000) == ""


def test_deeply_nested_marks_take_linear_time():
    assert content.main_text("<p>text, it is.</p>" + "<div class=ad>" * 5_000 + "ad" + "</div>" * 5_000) == "text, it is."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a b/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "same"),
            (5, "u", "same"), (None, "u", "same"), (7, "u", "é" * 5000), (8, "u", "x" * 3_000_000)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    return frame.withColumns({"text": F.lit("t"), "payload": F.lit("p"), "first": F.lit(1), "digest": F.lit("d")})


def test_extraction_of_rows(spark, pages):
    found = content.extract_content(pages)
    assert found.columns == ["page_id", "url", "text"] and found.count() == 9
    assert {(r.page_id, r.text) for r in found.collect() if r.page_id in (1, 3, 4)} == {(1, "same"), (3, ""), (4, "")}
    assert content.extract_content(pages.where("false")).collect() == []


def write(spark, frame, folder):
    warc.register(spark)
    frame.write.format("warc").mode("append").save(folder)
    return spark.read.format("warc")


def records(pages):
    rows = warc.with_revisits(pages.select("page_id", "url", "html"), "page_id", "html", extra=("url",))
    revisit = F.col("first").isNotNull()
    return rows.select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.col("first").cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.col("bytes").cast("bigint").alias("payload_bytes"),
        F.col("_payload").cast("binary").alias("payload"),
    )


def test_round_trip_and_revisits(spark, pages):
    folder = run_folder(spark, "warc-test")
    reader = write(spark, records(pages), folder)
    rows = reader.option("verify", "true").load(folder).collect()
    kinds = sorted((r.record_id or "-", r.record_type, r.refers_to) for r in rows)
    assert kinds == sorted(
        [("1", "response", None), ("2", "revisit", "1"), ("3", "response", None), ("4", "revisit", "3"), ("5", "revisit", "1"),
         ("5", "revisit", "1"), ("-", "revisit", "1"), ("7", "response", None), ("8", "response", None)]
    )
    by_id = {r.record_id: r for r in rows}
    assert by_id["1"].target_uri == "http://a b/\r\nX: y" and by_id["2"].target_uri is None
    assert bytes(by_id["7"].payload).decode() == "é" * 5000 and by_id["7"].payload_bytes == 10_000
    assert by_id["2"].payload is None and by_id["2"].payload_digest == by_id["1"].payload_digest == warc.digest_of(b"same")


def test_filters_reach_the_reader(spark, pages):
    folder = run_folder(spark, "warc-test")
    reader = write(spark, records(pages), folder)
    few = reader.option("payload", "false").load(folder).where("record_type = 'response' AND record_id IN ('1', '7')")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "record_type" in plan
    assert sorted((r.record_id, r.payload) for r in few.collect()) == [("1", None), ("7", None)]
    own = warc.WarcReader({"path": folder})
    left = list(own.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and own.allowed == {"record_type": {"revisit"}}
    got = [r for p in own.partitions() for b in own.read(p) for r in b.to_pylist()]
    assert len(got) == 5 and {r["record_type"] for r in got} == {"revisit"}


def test_unwanted_payloads_are_skipped():
    row = dict(record_id="a", record_type="response", target_uri=None, refers_to=None, payload_digest=None, payload_bytes=None, payload=b"x" * 99)
    data = warc.record_bytes(row, "2000-01-01T00:00:00Z")
    broken = data.replace(data[data.index(b"\x1f\x8b") : data.index(b"\x1f\x8b") + 12], b"?" * 12)
    with pytest.raises(Exception, match="header|incorrect|Error|invalid"):
        list(warc.read_records(io.BytesIO(broken), lambda r: True))
    assert list(warc.read_records(io.BytesIO(broken + data), lambda r: False)) == []
    packed = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data) + gzip.compress(data))))
    assert [r["payload"] for r in warc.read_records(packed, lambda r: True)] == [b"x" * 99] * 2


def test_an_empty_table_makes_an_empty_archive(spark, pages):
    folder = run_folder(spark, "warc-test")
    reader = write(spark, records(pages.where("false")), folder)
    assert reader.load(folder).collect() == []


def test_warc_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op6_warc"](spark, sf)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cursor = connection.execute(ORACLES["op6_warc"])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(cursor.fetchall())
