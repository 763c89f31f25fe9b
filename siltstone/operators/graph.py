"""Dependency graph of files, modules, classes and functions.

Calls are kept in two parts.  A call to a class-less function of the caller's
own file has one target.  Any other call refers to a *name*, and every function
of that name is a target: spelled out, that is callers times definitions per
name, which grows with the square of a common name.  The graph therefore keeps
``references`` (caller, name) and ``definitions`` (name, function) apart.
Counts, neighbours and reachability work on the two; only ``call_edges`` and
``edges`` join them, for callers that want the edge list itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import import_target, language_of, node_id
from siltstone.session import durable

# All that a graph is built from.
INPUT = ("func_id", "file", "class_name", "function", "calls", "imports")

# Which write of a node or edge comes later; the last one keeps its type.
_FILE, _IMPORT, _STRUCTURE = 0, 1, 2


def _write_order(phase: int, func_id: str | None = None, step: int = 0) -> Column:
    position = F.col(func_id) if func_id else F.lit(0).cast("bigint")
    return F.struct(F.lit(phase).alias("phase"), position.alias("position"), F.lit(step).alias("step"))


@dataclass(frozen=True)
class CodeGraph:
    """Lazy parts of the graph; every part holds distinct rows.

    ``static_edges`` (src, dst, type) are imports and structure, ``local_calls``
    (src, dst) calls with one target, ``references`` (src, name) the other calls
    and ``definitions`` (name, dst) the functions by name.
    """

    nodes: DataFrame
    static_edges: DataFrame
    local_calls: DataFrame
    references: DataFrame
    definitions: DataFrame
    is_written: bool = False

    def written(self) -> CodeGraph:
        """The same graph with every part computed once into the checkpoint folder.

        Worth while for any job that uses more than one part.
        """
        if self.is_written:
            return self
        parts = ("nodes", "static_edges", "local_calls", "references", "definitions")
        return CodeGraph(*(durable(getattr(self, part)) for part in parts), is_written=True)

    def call_edges(self) -> DataFrame:
        named = self.references.join(self.definitions, "name").select("src", "dst")
        return self.local_calls.unionByName(named)

    def edges(self) -> DataFrame:
        """Edge list (src, dst, type) with one edge per pair; calls win."""
        calls = self.call_edges().withColumn("type", F.lit("calls"))
        return self.static_edges.join(self._shadowed(), ["src", "dst"], "left_anti").unionByName(calls)

    def _shadowed(self) -> DataFrame:
        """Static edges that are call edges as well, found without the edge list.

        Few static edges start at a caller at all; only those are compared with
        the definitions.  Their starts, files and classes, are written by
        themselves: where they are few, no call is shuffled to find that out.
        """
        static = self.static_edges.select("src", "dst", F.substring_index("dst", "::", -1).alias("name"))
        starts = durable(static.select("src").distinct())
        references, calls = (part.join(starts, "src", "left_semi") for part in (self.references, self.local_calls))
        named = static.join(references, ["src", "name"], "left_semi").join(
            self.definitions, ["dst", "name"], "left_semi"
        )
        local = static.join(calls, ["src", "dst"], "left_semi")
        return named.unionByName(local).select("src", "dst")

    def node_count(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes"))

    def edge_count(self) -> DataFrame:
        """Number of edges from the parts, in time linear in their size."""
        callers = self.references.groupBy("name").agg(F.count("*").alias("callers"))
        targets = self.definitions.groupBy("name").agg(F.count("*").alias("targets"))
        named = callers.join(targets, "name").select((F.col("callers") * F.col("targets")).alias("n"))
        parts = [
            named,
            self.local_calls.agg(F.count("*").alias("n")),
            self.static_edges.agg(F.count("*").alias("n")),
            self._shadowed().agg((-F.count("*")).alias("n")),
        ]
        counted = parts[0]
        for part in parts[1:]:
            counted = counted.unionByName(part)
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))

    def successors(self, ids: DataFrame) -> DataFrame:
        """(id, neighbour) along the edges out of ``ids`` (a frame with column id)."""
        start = ids.select(F.col("id").alias("src")).distinct()
        own = self.static_edges.select("src", "dst").unionByName(self.local_calls)
        named = self.references.join(start, "src", "left_semi").join(self.definitions, "name")
        found = own.join(start, "src", "left_semi").unionByName(named.select("src", "dst"))
        return found.distinct().select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))

    def predecessors(self, ids: DataFrame) -> DataFrame:
        """(id, neighbour) against the edges into ``ids``."""
        end = ids.select(F.col("id").alias("dst")).distinct()
        own = self.static_edges.select("src", "dst").unionByName(self.local_calls)
        named = self.definitions.join(end, "dst", "left_semi").join(self.references, "name")
        found = own.join(end, "dst", "left_semi").unionByName(named.select("src", "dst"))
        return found.distinct().select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))


def import_edges(functions: DataFrame, by_language: bool = False) -> DataFrame:
    """Distinct (src, dst) from files to the modules they import."""
    statements = functions.select("file", F.explode(F.array_distinct("imports")).alias("statement"))
    language = language_of(F.col("file")) if by_language else None
    target = import_target(F.col("statement"), language)
    return statements.select(F.col("file").alias("src"), target.alias("dst")).where("dst IS NOT NULL").distinct()


def structure_edges(functions: DataFrame) -> DataFrame:
    """Membership edges with their write order: file, class, function."""
    file, owner = F.col("file"), F.nullif(F.col("class_name"), F.lit(""))
    class_id = F.concat(file, F.lit("::"), owner)
    function_id = node_id(file, owner, F.col("function"))

    def edge(src: Column, dst: Column, kind: str, node_type: str, step: int) -> Column:
        return F.struct(
            src.alias("src"),
            dst.alias("dst"),
            F.lit(kind).alias("type"),
            F.lit(node_type).alias("node_type"),
            _write_order(_STRUCTURE, "func_id", step).alias("written"),
        )

    pair = F.when(
        owner.isNotNull(),
        F.array(
            edge(file, class_id, "contains", "class", 0),
            edge(class_id, function_id, "has_method", "function", 1),
        ),
    ).otherwise(F.array(edge(file, function_id, "contains_function", "function", 1)))
    return functions.select(F.inline(pair))


def _last_type(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by("type", "written").alias("type"))


def build_graph(functions: DataFrame, *, by_language: bool = False, write: bool = False) -> CodeGraph:
    """Graph of a FUNCTIONS frame.  Reads identity, calls and imports only.

    With ``write`` calls and static edges are computed once into the checkpoint
    folder, for callers that read them several times.
    """
    files = functions.select("file").distinct()
    imports = import_edges(functions, by_language)
    structure = structure_edges(functions)

    nodes = _last_type(
        files.select(F.col("file").alias("id"), F.lit("file").alias("type"), _write_order(_FILE).alias("written"))
        .unionByName(
            imports.select(
                F.col("dst").alias("id"),
                F.lit("imported_module").alias("type"),
                _write_order(_IMPORT).alias("written"),
            )
        )
        .unionByName(structure.select(F.col("dst").alias("id"), F.col("node_type").alias("type"), "written")),
        "id",
    )
    static_edges = _last_type(
        imports.select(
            "src", "dst", F.lit("imports").alias("type"), _write_order(_IMPORT).alias("written")
        ).unionByName(structure.select("src", "dst", "type", "written")),
        "src",
        "dst",
    )

    named = functions.select(
        "file",
        F.nullif(F.col("class_name"), F.lit("")).alias("class_name"),
        F.col("function").alias("name"),
        node_id(F.col("file"), F.col("class_name"), F.col("function")).alias("dst"),
    )
    definitions = named.select("name", "dst").distinct()
    local = named.where("class_name IS NULL").select("file", "name", "dst").distinct()
    called = functions.select(
        "file",
        node_id(F.col("file"), F.col("class_name"), F.col("function")).alias("src"),
        F.explode(F.array_distinct("calls")).alias("name"),
    ).distinct()
    resolved = called.join(local, ["file", "name"], "left").select("src", "name", "dst")
    if write:
        resolved, static_edges = durable(resolved), durable(static_edges)
    return CodeGraph(
        nodes=nodes,
        static_edges=static_edges,
        local_calls=resolved.where("dst IS NOT NULL").select("src", "dst"),
        references=resolved.where("dst IS NULL").select("src", "name"),
        definitions=definitions,
    )


def file_issue_counts(issues: DataFrame) -> DataFrame:
    """Per file: total and the two maps.

    Issues are first counted by file, category and severity, so the list per
    file is as short as the closed sets of categories and severities.
    """
    fine = issues.groupBy("file", "category", "severity").agg(F.count("*").alias("n"))
    counts = fine.groupBy("file").agg(
        F.sum("n").alias("total_issues"), F.sort_array(F.collect_list(F.struct("category", "severity", "n"))).alias("counts")
    )

    def as_map(key: str) -> Column:
        def total(name: Column) -> Column:
            same = F.filter("counts", lambda c: c[key] == name)
            return F.aggregate(same, F.lit(0).cast("bigint"), lambda sum_, c: sum_ + c["n"])

        names = F.array_distinct(F.transform("counts", lambda c: c[key]))
        return F.map_from_arrays(names, F.transform(names, total))

    return counts.select(
        "file",
        "total_issues",
        as_map("category").alias("issues_by_category"),
        as_map("severity").alias("severity_distribution"),
    )


def annotate_nodes(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """Nodes with the issue counts of the file they name, zero for all others."""
    empty = F.create_map().cast("map<string,bigint>")
    return nodes.join(file_issue_counts(issues).withColumnRenamed("file", "id"), "id", "left").select(
        "id",
        "type",
        F.coalesce("total_issues", F.lit(0)).cast("bigint").alias("total_issues"),
        F.coalesce("issues_by_category", empty).alias("issues_by_category"),
        F.coalesce("severity_distribution", empty).alias("severity_distribution"),
    )


def node_issues(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """The issue list of each node, one row per issue."""
    return nodes.select(F.col("id").alias("file")).join(issues, "file").withColumnRenamed("file", "id")


# Display colours by worst severity, and size limits.
COLOURS = {"High": "#ff4444", "Medium": "#ffaa00", "Low": "#ffff00"}
COLOUR_WITHOUT_ISSUES = "#44ff44"
SMALLEST, LARGEST = 15, 40


def node_display(annotated: DataFrame) -> DataFrame:
    """Label, colour and size with which a node is drawn."""
    parts = F.split("id", "::")
    name = F.substring_index(F.get(parts, F.lit(0)), "/", -1)
    last = F.element_at(parts, -1)
    label = (
        F.when(F.size(parts) > 2, F.concat(name, F.lit("\n"), F.get(parts, F.lit(1)), F.lit("."), last))
        .when(F.size(parts) == 2, F.concat(name, F.lit("\n"), last))
        .otherwise(F.col("id"))
    )
    colour = F.lit(COLOUR_WITHOUT_ISSUES)
    for severity in reversed(COLOURS):
        present = F.coalesce(F.try_element_at("severity_distribution", F.lit(severity)), F.lit(0)) > 0
        colour = F.when(present, COLOURS[severity]).otherwise(colour)
    size = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.lit(SMALLEST) + F.col("total_issues")))
    return annotated.select("id", label.alias("label"), colour.alias("color"), size.cast("bigint").alias("size"))


def direct_impact(graph: CodeGraph, issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbour counts, issue counts and score of each id.

    An id that is no node of the graph gets an error text and null counts.
    """
    asked = ids.select("id").distinct()
    known = asked.join(graph.nodes.select("id"), "id", "left_semi").withColumn("known", F.lit(True))
    into = graph.predecessors(known).groupBy("id").agg(F.count("*").alias("predecessors"))
    out = graph.successors(known).groupBy("id").agg(F.count("*").alias("successors"))
    found = (
        issues.groupBy(F.col("file").alias("id"))
        .agg(F.count("*").alias("total_issues"), F.count_if(F.col("severity") == "High").alias("high_issues"))
    )
    rows = asked.join(known, "id", "left").join(into, "id", "left").join(out, "id", "left").join(found, "id", "left")

    def count(name: str) -> Column:
        return F.when(F.col("known"), F.coalesce(name, F.lit(0)).cast("bigint"))

    score = count("successors") + count("total_issues") * F.lit(0.1)
    return rows.select(
        "id",
        count("predecessors").alias("predecessors"),
        count("successors").alias("successors"),
        count("total_issues").alias("total_issues"),
        count("high_issues").alias("high_severity_issues"),
        F.round(score, 6).alias("impact_score"),
        F.when(F.col("known").isNull(), F.lit("File not found in dependency graph")).alias("error"),
    )
