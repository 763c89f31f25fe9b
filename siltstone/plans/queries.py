"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import ScanConfig
from siltstone.functions import complexity
from siltstone.functions.normalize import code_hash
from siltstone.functions.questions import route, wants_debugging
from siltstone.functions.rules import holds_secret
from siltstone.functions.text import import_target, imports_before, language_of, matches_glob, slice_lines, under_directory
from siltstone.operators import answers, buckets, chat, duplicates, extract, graph, impact, issues, report, summary, vectors
from siltstone.plans.fixture import (
    CORPUS_SQL,
    files_view,
    modules_view,
    functions_view,
    paths_view,
    questions_view,
    table,
    turns_view,
)
from siltstone.schemas import ISSUE_ORDER
from siltstone.session import durable, spread
from siltstone.streaming.rules_stream import run_available, stream_issues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _entries(column: str) -> F.Column:
    """A map as sorted ``key=value`` text."""
    pairs = F.transform(
        F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.array_join(pairs, ",")


def _issue_key() -> F.Column:
    return (F.col("func_id") * 100 + F.col("rule_pos")).alias("issue_key")


def _issues(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return duplicates.all_issues(functions_view(spark, sf_dir), texts=texts)


def _written_issues(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """For queries that read the issues more than once, as numbering does."""
    return durable(_issues(spark, sf_dir, texts))


def _graph(spark: SparkSession, sf_dir: str) -> graph.CodeGraph:
    return graph.build_graph(functions_view(spark, sf_dir))


def _shared_graph(spark: SparkSession, sf_dir: str) -> graph.CodeGraph:
    """For queries that use several parts: the narrow input, calls and static edges are made once."""
    return graph.build_graph(durable(functions_view(spark, sf_dir).select(*graph.INPUT)), write=True)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_view(spark, sf_dir).select(F.col("file").alias("id")).distinct()


# -- sources ---------------------------------------------------------------


@query
def scan_exclude_dirs(spark, sf_dir):
    paths = paths_view(spark, sf_dir)
    return paths.where(~under_directory(F.col("path"), ScanConfig().dirs))


@query
def scan_exclude_globs(spark, sf_dir):
    config = ScanConfig().add_pattern("*.md")
    paths = paths_view(spark, sf_dir)
    return paths.where(~matches_glob(F.col("path"), config.patterns))


@query
def language_of_file(spark, sf_dir):
    paths = paths_view(spark, sf_dir)
    return paths.select("func_id", "path", language_of(F.col("path")).alias("language"))


@query
def slice_function_code(spark, sf_dir):
    files = files_view(spark, sf_dir).withColumn("lines", F.split("content", "\n", -1))
    return files.select(
        "func_id", slice_lines(F.col("lines"), F.col("start_line"), F.col("function_length")).alias("code")
    )


def _python_files(spark, sf_dir) -> DataFrame:
    return files_view(spark, sf_dir).select(F.col("func_id").cast("string").alias("path"), F.lit("python").alias("language"), "content")


@query
def extract_functions(spark, sf_dir):
    found = extract.extract_functions(_python_files(spark, sf_dir))
    return found.select(
        F.col("file").cast("bigint").alias("func_id"), "function", "class_name", "start_line", "end_line", "function_length",
        F.array_join("parameters", ",").alias("parameters"), "has_docstring", "code",
    )


@query
def unread_files(spark, sf_dir):
    return extract.unread_files(_python_files(spark, sf_dir)).select(F.col("path").cast("bigint").alias("func_id"))


@query
def extract_modules(spark, sf_dir):
    found = extract.extract_functions(modules_view(spark, sf_dir).select("path", "language", "content"))
    return found.select(
        F.col("file").alias("path"), "class_name", "function", "start_line", "end_line", "function_length", "nesting_depth", "has_docstring",
        F.array_join("parameters", ",").alias("parameters"), F.array_join("calls", ",").alias("calls"), F.array_join("imports", "|").alias("imports"),
    )


@query
def has_docstring(spark, sf_dir):
    return functions_view(spark, sf_dir).select("func_id", "has_docstring")


@query
def imports_before_function(spark, sf_dir):
    files = files_view(spark, sf_dir).withColumn("lines", F.split("content", "\n", -1))
    found = imports_before(F.col("lines"), F.col("start_line"))
    return files.select("func_id", F.array_join(found, "|").alias("imports"))


# -- rules -----------------------------------------------------------------

# Query name of each rule.
RULE_QUERIES = {
    "rule_eval_exec": "R1",
    "rule_sql_injection": "R2",
    "rule_weak_hash": "R3",
    "rule_hardcoded_secret": "R4",
    "rule_js_eval": "R5",
    "rule_js_function_constructor": "R6",
    "rule_js_inner_html": "R7",
    "rule_js_document_write": "R8",
    "rule_java_runtime_exec": "R9",
    "rule_java_weak_crypto": "R10",
    "rule_java_jdbc_concat": "R11",
    "rule_function_length": "R12",
    "rule_cyclomatic": "R13",
    "rule_nesting_depth": "R14",
    "rule_missing_docs": "R15",
}


def _flat(found: DataFrame, *more: str) -> DataFrame:
    start, end = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    return found.select(
        "func_id",
        "rule_id",
        "rule_pos",
        "file",
        "class_name",
        "function",
        start.alias("start_line"),
        end.alias("end_line"),
        "category",
        "issue",
        "severity",
        *more,
    )


def _rule_query(rule_id: str) -> Query:
    return lambda spark, sf_dir: _flat(issues.issues_of_rule(functions_view(spark, sf_dir), rule_id), "explanation")


for _name, _rule_id in RULE_QUERIES.items():
    QUERIES[_name] = _rule_query(_rule_id)


@query
def all_local_issues(spark, sf_dir):
    return _flat(issues.rule_issues(functions_view(spark, sf_dir)), "explanation", "suggestion")


@query
def secret_scan_documents(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return documents.where(holds_secret(F.col("text"))).select("doc_id", "source")


@query
def cyclomatic_complexity(spark, sf_dir):
    score = complexity.cyclomatic_complexity(F.col("code"))
    return functions_view(spark, sf_dir).select("func_id", score.alias("complexity"))


# -- duplicates --------------------------------------------------------------


@query
def normalized_code_hash(spark, sf_dir):
    return functions_view(spark, sf_dir).select("func_id", code_hash(F.col("code")).alias("code_hash"))


@query
def duplicate_groups(spark, sf_dir):
    return duplicates.duplicate_groups(duplicates.fingerprints(functions_view(spark, sf_dir)))


@query
def duplicate_members(spark, sf_dir):
    prints = duplicates.fingerprints(functions_view(spark, sf_dir)).select("func_id", "file", "code_hash")
    return duplicates.duplicate_members(durable(prints))


@query
def duplicate_group_files(spark, sf_dir):
    prints = duplicates.fingerprints(functions_view(spark, sf_dir)).select("func_id", "file", "code_hash")
    return duplicates.duplicate_group_files(durable(prints))


@query
def duplicate_issues(spark, sf_dir):
    return _flat(duplicates.duplicate_issues(functions_view(spark, sf_dir)), "lead_id", "explanation", "suggestion")


@query
def duplicate_documents(spark, sf_dir):
    return duplicates.duplicate_documents(table(spark, sf_dir, "documents"))


@query
def all_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("phase", "lead_id", "func_id", "rule_pos", "category", "issue", "severity")


# -- graph -------------------------------------------------------------------


@query
def import_targets(spark, sf_dir):
    each = functions_view(spark, sf_dir).select("func_id", F.posexplode("imports").alias("pos", "statement"))
    return each.withColumn("target", import_target(F.col("statement")))


@query
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes


@query
def graph_import_edges(spark, sf_dir):
    return graph.import_edges(functions_view(spark, sf_dir))


@query
def graph_structure_edges(spark, sf_dir):
    return graph.structure_edges(functions_view(spark, sf_dir)).select("src", "dst", "type").distinct()


@query
def graph_call_edges(spark, sf_dir):
    return _graph(spark, sf_dir).call_edges()


@query
def graph_edges(spark, sf_dir):
    return _shared_graph(spark, sf_dir).edges()


@query
def graph_edge_count(spark, sf_dir):
    return _shared_graph(spark, sf_dir).edge_count()


@query
def node_issue_counts(spark, sf_dir):
    annotated = graph.annotate_nodes(_graph(spark, sf_dir).nodes, _issues(spark, sf_dir))
    return annotated.select(
        "id",
        "type",
        "total_issues",
        _entries("issues_by_category").alias("by_category"),
        _entries("severity_distribution").alias("by_severity"),
    )


@query
def node_issue_list(spark, sf_dir):
    listed = graph.node_issues(_graph(spark, sf_dir).nodes, _issues(spark, sf_dir))
    return listed.select("id", _issue_key(), "issue", "severity")


@query
def graph_predecessors(spark, sf_dir):
    return _graph(spark, sf_dir).predecessors(_files(spark, sf_dir))


@query
def graph_successors(spark, sf_dir):
    return _graph(spark, sf_dir).successors(_files(spark, sf_dir))


@query
def transitive_impact(spark, sf_dir):
    return impact.transitive_impact(_shared_graph(spark, sf_dir), _files(spark, sf_dir), _issues(spark, sf_dir))


@query
def direct_impact(spark, sf_dir):
    asked = _files(spark, sf_dir).unionByName(
        _files(spark, sf_dir).select(F.concat("id", F.lit(".gone")).alias("id"))
    )
    return graph.direct_impact(_shared_graph(spark, sf_dir), _issues(spark, sf_dir), asked)


@query
def node_display(spark, sf_dir):
    return graph.node_display(graph.annotate_nodes(_graph(spark, sf_dir).nodes, _issues(spark, sf_dir)))


# -- summaries ---------------------------------------------------------------


@query
def analysis_summary(spark, sf_dir):
    functions = functions_view(spark, sf_dir)
    counted = summary.analysis_summary(functions, _issues(spark, sf_dir), _shared_graph(spark, sf_dir).edge_count())
    return counted.withColumns(
        {c: _entries(c) for c in ("issues_by_category", "issues_by_severity")}
    )


@query
def issues_by_category(spark, sf_dir):
    return summary.issues_by(_issues(spark, sf_dir), "category")


@query
def issues_by_severity(spark, sf_dir):
    return summary.issues_by(_issues(spark, sf_dir), "severity")


@query
def graph_summary(spark, sf_dir):
    built = _shared_graph(spark, sf_dir)
    annotated = graph.annotate_nodes(built.nodes, _issues(spark, sf_dir))
    return summary.graph_summary(built.node_count(), built.edge_count(), annotated)


@query
def graph_issue_rollup(spark, sf_dir):
    return summary.rollup_maps(graph.annotate_nodes(_graph(spark, sf_dir).nodes, _issues(spark, sf_dir)))


@query
def top_issue_files(spark, sf_dir):
    return summary.top_issue_files(graph.annotate_nodes(_graph(spark, sf_dir).nodes, _issues(spark, sf_dir)))


@query
def collection_stats(spark, sf_dir):
    return summary.collection_stats(functions_view(spark, sf_dir), _issues(spark, sf_dir))


@query
def report_header(spark, sf_dir):
    return summary.report_header(report.report_issues(_issues(spark, sf_dir)))


@query
def issues_per_file(spark, sf_dir):
    return summary.issues_by(_issues(spark, sf_dir), "file")


@query
def issues_per_function(spark, sf_dir):
    return summary.issues_by(_issues(spark, sf_dir), "func_id")


@query
def enriched_report(spark, sf_dir):
    functions = functions_view(spark, sf_dir)
    joined = summary.enriched_report(_issues(spark, sf_dir), functions)
    return joined.select(
        "func_id", "rule_pos", "category", "severity", "function_length", "nesting_depth", "has_docstring",
        F.array_join("parameters", ",").alias("parameters"), F.md5("code").alias("code_md5"),
    )


# -- vectors -----------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def _with_vector_id(rows: DataFrame, number: F.Column, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row gets the vector ``number`` modulo the number of vectors, by its id: many rows share one."""
    return rows.withColumn("vec_id", F.pmod(number, F.lit(_vectors(spark, sf_dir).count())))


def _having_vector(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a collection: those that have a vector, once for each."""
    return rows.join(_vectors(spark, sf_dir).select("vec_id"), "vec_id").drop("vec_id")


def _code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = functions_view(spark, sf_dir).select(F.col("func_id").alias("id"), "file")
    return _with_vector_id(rows, F.col("id"), spark, sf_dir)


def _issue_vectors(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = _issues(spark, sf_dir) if found is None else found
    rows = found.select(
        _issue_key().alias("id"), "func_id", "file", "category", "severity"
    )
    return _with_vector_id(rows, F.col("func_id"), spark, sf_dir)


def _all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


@query
def collection_code_rows(spark, sf_dir):
    rows = vectors.code_rows(functions_view(spark, sf_dir))
    return rows.select(
        "id", F.md5("document").alias("document_md5"), "class_name", "start_line", "end_line",
        F.to_json("calls").alias("calls"),
    )


@query
def collection_issue_rows(spark, sf_dir):
    rows = vectors.issue_rows(_written_issues(spark, sf_dir, texts=True))
    return rows.select("id", "document", "class_name", "category", "issue", "severity", F.to_json("lines").alias("lines"))


@query
def knn_top3(spark, sf_dir):
    corpus = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return _rounded(vectors.nearest(_all_queries(spark, sf_dir), corpus, 3))


@query
def knn_cosine(spark, sf_dir):
    corpus = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return _rounded(vectors.nearest(_all_queries(spark, sf_dir), corpus, 5, metric="cosine"))


@query
def knn_indexed(spark, sf_dir):
    """The nearest rows of every vector, exact, over an index of buckets."""
    corpus = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return _rounded(buckets.search(buckets.build_index(corpus), _all_queries(spark, sf_dir), 3).drop("approximate"))


@query
def knn_approximate(spark, sf_dir):
    """Ten near rows of every vector from the nearest buckets; flagged, without SQL."""
    corpus = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return buckets.search(buckets.build_index(corpus), _all_queries(spark, sf_dir), 10, share=buckets.SHARE)


@query
def knn_issues(spark, sf_dir):
    collection = _issue_vectors(spark, sf_dir)
    return _rounded(vectors.nearest(_all_queries(spark, sf_dir), collection, 5, vectors=_vectors(spark, sf_dir)))


@query
def knn_filtered(spark, sf_dir):
    labelled = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    chosen = vectors.where_equal(labelled, label=3, id=None)
    return _rounded(vectors.nearest(_all_queries(spark, sf_dir), chosen, 3))


@query
def lookup_by_id(spark, sf_dir):
    collection = functions_view(spark, sf_dir).select(F.col("func_id").alias("id"), "file", "function")
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return vectors.by_id(collection, ids)


@query
def issues_by_file_lookup(spark, sf_dir):
    chosen = vectors.where_equal(_issues(spark, sf_dir), file="src/m8.py", severity="High", category=None)
    return chosen.select("func_id", "rule_pos", "issue")


def _chat_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    return asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"))


@query
def knn_batch(spark, sf_dir):
    parts = _chat_queries(spark, sf_dir).select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("sub"))
    asked = _with_vector_id(parts, F.col("query_id") * 3 + F.col("sub"), spark, sf_dir)
    return _rounded(vectors.nearest_batch(asked, _code_vectors(spark, sf_dir), 3, vectors=_vectors(spark, sf_dir)))


@query
def code_with_context(spark, sf_dir):
    collection = _code_vectors(spark, sf_dir)
    hits = vectors.nearest(_all_queries(spark, sf_dir), collection, 5, vectors=_vectors(spark, sf_dir))
    placed = _having_vector(collection, spark, sf_dir).select("id", "file")
    return answers.code_with_context(hits, placed, _shared_graph(spark, sf_dir))


@query
def issues_with_context(spark, sf_dir):
    found = _written_issues(spark, sf_dir)
    rows = _issue_vectors(spark, sf_dir, found)
    hits = vectors.nearest(_all_queries(spark, sf_dir), rows, 5, vectors=_vectors(spark, sf_dir))
    collection = found.select(_issue_key().alias("id"), "file", "category", "severity")
    return answers.issues_with_context(hits, collection)


@query
def route_questions(spark, sf_dir):
    return questions_view(spark, sf_dir).select("question_id", route(F.col("question")).alias("type"))


@query
def answer_questions(spark, sf_dir):
    asked = _with_vector_id(questions_view(spark, sf_dir), F.col("text_id"), spark, sf_dir)
    code, found = _code_vectors(spark, sf_dir), _issue_vectors(spark, sf_dir)
    return answers.answer_questions(asked, code, found, vectors=_vectors(spark, sf_dir))


# -- chat --------------------------------------------------------------------


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory holds the assistant's turns, each with the id of a vector."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return _with_vector_id(rows, F.col("id") * 7, spark, sf_dir)


@query
def chat_memory_rows(spark, sf_dir):
    return chat.memory_rows(table(spark, sf_dir, "conversations"))


@query
def chat_last5_window(spark, sf_dir):
    return chat.last_exchanges(turns_view(spark, sf_dir))


@query
def chat_memory_confidence(spark, sf_dir):
    found = chat.memory_confidence(_all_queries(spark, sf_dir), _memory(spark, sf_dir), vectors=_vectors(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 6))


@query
def retrieval_gate(spark, sf_dir):
    asked, of = _all_queries(spark, sf_dir), _vectors(spark, sf_dir)
    confidences = chat.memory_confidence(asked, _memory(spark, sf_dir), vectors=of)
    return _rounded(chat.gated_code_hits(asked, confidences, _code_vectors(spark, sf_dir), vectors=of))


@query
def route_debug(spark, sf_dir):
    turns = turns_view(spark, sf_dir)
    return turns.select("conv_id", "turn", wants_debugging(F.col("text")).alias("debug"))


@query
def context_text(spark, sf_dir):
    asked, memory = _all_queries(spark, sf_dir), _memory(spark, sf_dir)
    hits = vectors.nearest(asked, memory, chat.MEMORY_HITS, vectors=_vectors(spark, sf_dir))
    documents = _having_vector(memory, spark, sf_dir).select("id", F.concat("role", F.lit(": "), "text").alias("document"))
    return chat.context_text(asked, hits.join(documents, "id"), chat.NO_HISTORY)


# -- report ------------------------------------------------------------------


@query
def report_issues(spark, sf_dir):
    return report.report_issues(_issues(spark, sf_dir)).select("func_id", "rule_pos", "severity", "category", "issue")


@query
def report_numbered(spark, sf_dir):
    rows = report.numbered(report.report_issues(_written_issues(spark, sf_dir).select(*ISSUE_ORDER, "severity")))
    return rows.select("number", "func_id", "rule_pos", "severity")


@query
def report_priority(spark, sf_dir):
    rows = report.with_priority(_issues(spark, sf_dir, texts=True))
    return rows.select("func_id", "rule_pos", "priority")


@query
def report_batches(spark, sf_dir):
    found = _written_issues(spark, sf_dir).select(*ISSUE_ORDER, "severity")
    rows = report.with_batch(report.numbered(report.report_issues(found)))
    return report.batch_counts(rows)


@query
def report_sections(spark, sf_dir):
    return report.report_sections(_written_issues(spark, sf_dir, texts=True))


@query
def report_prompts(spark, sf_dir):
    return report.batch_prompts(_written_issues(spark, sf_dir), functions_view(spark, sf_dir)).select(
        "batch", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("characters")
    )


@query
def extract_lines(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    start = F.col("path") % 3 + 1
    requests = documents.select(
        "path", start.cast("int").alias("start_line"), (start + F.col("path") % 4).cast("int").alias("end_line")
    )
    return report.extract_lines(requests, documents)


# -- streaming ---------------------------------------------------------------


@query
def stream_rule_parity(spark, sf_dir):
    """Rules over the order table read as a stream."""
    reader = spark.readStream.schema("o_orderkey bigint, o_custkey bigint")
    orders = reader.option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    corpus = spark.sql(CORPUS_SQL, orders=orders)
    length = F.size(F.split("code", "\n", -1))
    functions = corpus.withColumns(
        {
            "end_line": F.col("start_line") + length - 1,
            "function_length": length,
            "has_docstring": F.col("code").contains('"""'),
        }
    )
    return run_available(stream_issues(functions).select("func_id", "rule_id", "issue", "severity"))


