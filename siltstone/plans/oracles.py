"""The queries once more, as SQL for another engine.

Written on their own: rule hits come from the conditions under which the
corpus gets its lines, not from the patterns, and graph, search and window
results from plain joins over the whole tables.
"""

from __future__ import annotations

from siltstone.functions.rules import default_rules
from siltstone.operators import report
from siltstone.operators.chat import NO_HISTORY
from siltstone.operators.duplicates import SUGGESTION
from siltstone.plans.fixture import CORPUS_SQL, FILES_SQL, PATHS_SQL, QUESTIONS_SQL, TURNS_SQL


# Fixed values, spelled out here so that a word missing in the engine shows.
BRANCH_WORDS = "if elif switch case default for while do foreach try catch except finally and or".split()
BRANCH_SIGNS = ("&&", r"\|\|", r"\?")
ROUTES = {
    "security": ("security", "vulnerability", "injection", "crypto", "secret"),
    "performance": ("performance", "bottleneck", "slow", "optimize"),
    "duplication": ("duplicate", "copy", "similar"),
    "documentation": ("documentation", "docstring", "comment"),
    "complexity": ("complex", "complexity", "nested"),
}
DEFAULT_PATTERNS = ("*.min.js", "*.bundle.js", "*.chunk.js", "*.vendor.js")
DEFAULT_DIRS = (
    "__pycache__ node_modules .git .svn .hg build dist target out bin obj lib "
    ".vscode .idea venv env .env env.bak venv.bak analysis_output chroma_db *.egg-info *.dist-info"
).split()


def _text(value: str) -> str:
    """A string literal; line feeds are spelled chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


# What the module texts hold, by the number of their first lines (n) and of the lines for odd keys (j).
_MODULE_FUNCTIONS = """(0, 'K', 5, 'run', 0, 6, 0, 12, 2, 5, 'self,a,rest,b,kw', 'f,os.listdir,self.go', 'import os|from a.b import c', FALSE),
  (0, 'K', 5, 'late', 0, 14, 2, 14, 2, 1, 'self', '', 'import os|from a.b import c', FALSE),
  (0, NULL, 1, 'top_', 11, 16, 2, 21, 2, 5, 'u', 'v', 'import os|from a.b import c', FALSE),
  (1, NULL, 1, 'load_', 11, 5, 0, 10, 1, 4, 'a,b,rest', '', 'import x from ''x'';', FALSE),
  (1, 'K', 5, 'get', 0, 12, 1, 12, 1, 0, 'x', '', 'import x from ''x'';', FALSE),
  (1, 'K', 5, 'handle', 0, 13, 1, 15, 1, 0, 'e', '', 'import x from ''x'';', FALSE),
  (1, NULL, 1, 'pick_', 7, 17, 1, 17, 1, 0, 'u', '', 'import x from ''x'';', FALSE),
  (2, 'K', 5, 'add_', 11, 6, 0, 14, 1, 5, 'a,m', '', 'import java.util.List;', TRUE),
  (2, 'K', 5, 'call', 0, 16, 1, 16, 1, 0, 'q', '', 'import java.util.List;', FALSE)"""
_MODULE_ROWS = f"""SELECT path, class || CAST(k % c AS VARCHAR) AS class_name,
    name || CASE WHEN d > 0 THEN CAST(k % d AS VARCHAR) ELSE '' END AS function,
    CAST(k % 4 + a + aj * (k % 2) AS INT) AS start_line, CAST(k % 4 + b + bj * (k % 2) AS INT) AS end_line,
    CAST(b - a + (bj - aj) * (k % 2) + 1 AS INT) AS function_length, depth AS nesting_depth, doc AS has_docstring, parameters,
    calls || CASE WHEN name = 'run' AND k % 2 = 1 THEN ',z' ELSE '' END AS calls, imports
  FROM (SELECT o_orderkey AS k, concat('m/f', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.java' END) AS path FROM orders)
  JOIN (VALUES {_MODULE_FUNCTIONS}) t(m, class, c, name, d, a, aj, b, bj, depth, parameters, calls, imports, doc) ON k % 3 = m"""

# Condition on k = func_id under which the corpus text triggers each rule.
_HITS = {
    "R1": "k % 17 = 0 OR k % 43 = 0",
    "R2": "k % 19 = 0",
    "R3": "k % 23 = 0",
    "R4": "k % 29 = 0",
    "R5": "k % 17 = 0",
    "R6": "k % 31 = 0",
    "R7": "k % 37 = 0",
    "R8": "k % 41 = 0",
    "R9": "k % 43 = 0",
    "R10": "k % 47 = 0",
    "R11": "k % 53 = 0",
    "R12": "function_length > 200",
    "R13": "complexity > 10",
    "R14": "k % 6 > 3",
    "R15": "(file LIKE '%.py' AND k % 11 <> 0 AND k % 3 <> 0) OR (file NOT LIKE '%.py' AND k % 7 <> 0)",
}
_LABELS = {
    "R12": "'Function too long (' || function_length || ' lines)'",
    "R13": "'High cyclomatic complexity (' || complexity || ')'",
    "R14": "'Excessive nesting depth (' || k % 6 || ')'",
}
_SEVERITIES = {
    "R12": "CASE WHEN function_length > 500 THEN 'High' ELSE 'Medium' END",
    "R13": "CASE WHEN complexity > 15 THEN 'High' ELSE 'Medium' END",
}
_EXPLANATIONS = {
    "R12": "'The function spans ' || function_length || ' lines.'",
    "R13": "'The function has a branch score of ' || complexity || '.'",
    "R14": "'Statements are nested ' || k % 6 || ' levels deep.'",
    "R15": "'Nothing documents the function ' || function || '.'",
}


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(lower(code), {_text(pattern)}))"


def _occurrences(sign: str) -> str:
    return f"(length(code) - length(replace(code, '{sign}', '')))"


_WHOLE = " + ".join([_count(rf"\b{w}\b") for w in BRANCH_WORDS] + [_count(s) for s in BRANCH_SIGNS] + [_count(r"\belse\s+if\b")])
_OPEN = " + ".join(map(_occurrences, "([{")) + " - " + " - ".join(map(_occurrences, ")]}"))


def _rule_select(position: int, rule) -> str:
    rule_id = rule.rule_id
    label = _LABELS.get(rule_id) or _text(rule.label)
    severity = _SEVERITIES.get(rule_id) or _text(rule.severity)
    explanation = _EXPLANATIONS.get(rule_id) or _text(rule.explanation)
    return f"""SELECT k, {position} AS rule_pos, '{rule_id}' AS rule_id, '{rule.category}' AS category,
      {label} AS issue, {severity} AS severity, {explanation} AS explanation, {_text(rule.suggestion)} AS suggestion,
      file, class_name, function, start_line, end_line FROM scored WHERE {_HITS[rule_id]}"""


_CTES = {
    "corpus": CORPUS_SQL.format(orders="orders"),
    "paths": PATHS_SQL.format(corpus="corpus"),
    "files": FILES_SQL.format(corpus="corpus"),
    "questions": QUESTIONS_SQL.format(events="events"),
    "fn": """SELECT func_id AS k, file, class_name, function, start_line, code, nesting_depth,
      len(string_split(code, chr(10))) AS function_length,
      start_line + len(string_split(code, chr(10))) - 1 AS end_line,
      string_split(calls_csv, ',') AS calls, string_split(imports_csv, '|') AS imports,
      concat_ws('::', file, class_name, function) AS node FROM corpus""",
    "scored": f"""SELECT *, CAST(floor(1 + {_WHOLE} + 0.5 * {_count('=>')} + 0.5 * greatest(0, {_OPEN})) AS BIGINT)
      AS complexity FROM fn""",
    "rule_rows": "\n UNION ALL ".join(_rule_select(i, r) for i, r in enumerate(default_rules(), 1)),
    "code_lines": "SELECT k, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM fn",
    "marked": """SELECT k, n, line, contains(line, repeat('"', 3)) AS quoted,
      sum(CASE WHEN contains(line, repeat('"', 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS quotes
      FROM code_lines""",
    "hashes": """SELECT k, md5(string_agg(regexp_replace(trim(line), '\\s+', ' ', 'g'), chr(10) ORDER BY n)) AS h
      FROM marked WHERE NOT quoted AND quotes % 2 = 0 AND trim(line) <> '' AND NOT starts_with(trim(line), '#')
      GROUP BY k""",
    "groups": "SELECT h, count(*) AS members, min(k) AS lead_id FROM hashes GROUP BY h HAVING count(*) > 1",
    "members": "SELECT fn.*, h, members, lead_id FROM fn JOIN hashes USING (k) JOIN groups USING (h)",
    "copies": """SELECT k, h, members, members - count(*) OVER (PARTITION BY h, file) AS others FROM members""",
    "issues": """SELECT 0 AS phase, k AS lead_id, k, rule_pos, rule_id, category, issue, severity, file, class_name,
        function, start_line, end_line FROM rule_rows
      UNION ALL SELECT 1, lead_id, k, 16, 'D1', 'duplication', 'Duplicate function detected', 'Medium', file,
        class_name, function, start_line, end_line FROM members""",
    "texts": f"""SELECT k, rule_pos, explanation, suggestion FROM rule_rows
      UNION ALL SELECT k, 16, 'The same code is in ' || others || ' functions of other files; duplicate group '
        || h || ' has ' || members || ' members.', {_text(SUGGESTION)} FROM copies""",
    "statements": "SELECT k, file, unnest(imports) AS statement, generate_subscripts(imports, 1) - 1 AS pos FROM fn",
    "targets": """SELECT k, file, pos, statement, CASE statement WHEN 'import os.path' THEN 'os.py'
      WHEN 'import a, b' THEN 'a,.py' WHEN 'from . import y' THEN '/.py' WHEN 'import java.util.List;' THEN 'java.py'
      WHEN 'import fs from ''fs''' THEN 'fs.py' ELSE 'src/m' || (k % 97) || '.py' END AS target FROM statements""",
    "structure": """SELECT file AS src, file || '::' || class_name AS dst, 'contains' AS type, 'class' AS node_type, k
        FROM fn WHERE class_name IS NOT NULL
      UNION ALL SELECT file || '::' || class_name, node, 'has_method', 'function', k FROM fn WHERE class_name IS NOT NULL
      UNION ALL SELECT file, node, 'contains_function', 'function', k FROM fn WHERE class_name IS NULL""",
    "nodes": """SELECT id, arg_max(type, rank) AS type FROM (
        SELECT file AS id, 'file' AS type, -2 AS rank FROM fn
        UNION ALL SELECT target, 'imported_module', -1 FROM targets
        UNION ALL SELECT dst, node_type, 2 * k + CASE node_type WHEN 'class' THEN 0 ELSE 1 END FROM structure) n GROUP BY id""",
    "calls": "SELECT DISTINCT file, node AS src, unnest(calls) AS callee FROM fn",
    "local_calls": """SELECT DISTINCT c.src, c.callee, f.node AS dst FROM calls c
      JOIN fn f ON f.file = c.file AND f.function = c.callee AND f.class_name IS NULL""",
    "call_edges": """SELECT src, dst FROM local_calls UNION
      SELECT c.src, f.node FROM calls c JOIN fn f ON f.function = c.callee
      WHERE NOT EXISTS (SELECT 1 FROM local_calls l WHERE l.src = c.src AND l.callee = c.callee)""",
    "edges": """SELECT src, dst, arg_max(type, rank) AS type FROM (
        SELECT file AS src, target AS dst, 'imports' AS type, -1 AS rank FROM targets
        UNION ALL SELECT src, dst, type, k FROM structure
        UNION ALL SELECT src, dst, 'calls', 9000000000000000 FROM call_edges) e GROUP BY src, dst""",
    "file_counts": """SELECT file, count(*) AS n, count(*) FILTER (WHERE severity = 'High') AS high FROM issues GROUP BY file""",
    "by_category": """SELECT file, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category
      FROM (SELECT file, category, count(*) AS n FROM issues GROUP BY 1, 2) c GROUP BY file""",
    "by_severity": """SELECT file, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity
      FROM (SELECT file, severity, count(*) AS n FROM issues GROUP BY 1, 2) c GROUP BY file""",
    "annotated": """SELECT id, type, coalesce(n, 0) AS total_issues, coalesce(by_category, '') AS by_category,
      coalesce(by_severity, '') AS by_severity, coalesce(high, 0) AS high FROM nodes
      LEFT JOIN file_counts f ON f.file = id LEFT JOIN by_category c ON c.file = id LEFT JOIN by_severity s ON s.file = id""",
    "vectors": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "size": "SELECT count(*) AS n FROM embeddings",
    "distances": """SELECT a.vec_id AS q, b.vec_id AS c, b.label,
      power(list_distance(a.v, b.v), 2) AS distance, list_cosine_distance(a.v, b.v) AS cosine FROM vectors a, vectors b""",
    "issue_vec": "SELECT k * 100 + rule_pos AS id, file, category, severity, k % n AS vec FROM issues, size",
    "code_vec": "SELECT k AS id, file, k % n AS vec FROM fn, size",
    "memory": """SELECT conv_id * 1000 + turn AS id, text, ((conv_id * 1000 + turn) * 7) % n AS vec
      FROM conversations, size WHERE role = 'assistant'""",
    "memory_hits": """SELECT * FROM (SELECT q, id, text, distance, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank
      FROM distances JOIN memory ON c = vec) m WHERE rank <= 5""",
    "confidence": """SELECT vec_id AS query_id, count(q) AS hits, coalesce(1 - min(distance), 0.0) AS confidence
      FROM embeddings LEFT JOIN memory_hits ON q = vec_id GROUP BY vec_id""",
    "kept": "SELECT * FROM issues WHERE severity IN ('High', 'Medium')",
    "numbered": """SELECT *, row_number() OVER (ORDER BY severity <> 'High', lower(severity), phase, lead_id, k, rule_pos) AS number
      FROM kept""",
    "turns": TURNS_SQL.format(conversations="conversations"),
    "spoken": """SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM turns
      WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "exchanges": """SELECT conv_id, turn, 'user:' || coalesce(text, '') || chr(10) || 'bot:' || coalesce(next_text, '') AS shown
      FROM spoken WHERE role = 'user' AND next_role = 'assistant' AND coalesce(lower(text), '') NOT LIKE '%think%'""",
}

_ROUTE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"lower(question) LIKE '%{word}%'" for word in words) + f" THEN '{name}'"
    for name, words in ROUTES.items()
) + " ELSE 'general' END"


def _needed(sql: str) -> list[str]:
    """Names of the views a statement uses, in the order they are defined."""
    import re

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z_]+\b", text)) & set(_CTES):
            if name not in seen:
                seen.add(name)
                visit(_CTES[name])

    visit(sql)
    return [name for name in _CTES if name in seen]


def _with(sql: str, recursive: str = "") -> str:
    views = [f"{name} AS MATERIALIZED ({_CTES[name]})" for name in _needed(sql + recursive)]
    if recursive:
        views.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" + sql if views else sql


_FLAT = "k AS func_id, rule_id, rule_pos, file, class_name, function, start_line, end_line, category, issue, severity"


def _hits(corpus: str, k: int, where: str = "TRUE", measure: str = "distance") -> str:
    return f"""SELECT q AS query_id, rank, id, round(d, 6) AS distance FROM (
      SELECT q, id, {measure} AS d, row_number() OVER (PARTITION BY q ORDER BY {measure}, id) AS rank
      FROM distances JOIN {corpus} ON c = vec WHERE {where}) h WHERE rank <= {k}"""


def _like(glob: str) -> str:
    return f"regexp_matches(path, '{glob.replace('.', chr(92) + '.').replace('*', '.*')}$')"


def _statements() -> dict[str, str]:
    from siltstone.plans.queries import RULE_QUERIES

    sql = {
        "scan_exclude_dirs": "SELECT func_id, path FROM paths WHERE NOT list_has_any(string_split(path, '/')[:-2], "
        + "[" + ", ".join(f"'{d}'" for d in DEFAULT_DIRS) + "])",
        "scan_exclude_globs": "SELECT func_id, path FROM paths WHERE NOT ("
        + " OR ".join(_like(g) for g in (*DEFAULT_PATTERNS, "*.md")) + ")",
        "language_of_file": """SELECT func_id, path, CASE WHEN lower(path) LIKE '%.py' THEN 'python'
          WHEN lower(path) LIKE '%.java' THEN 'java' WHEN lower(path) LIKE '%.js' OR lower(path) LIKE '%.jsx'
          OR lower(path) LIKE '%.ts' OR lower(path) LIKE '%.tsx' THEN 'javascript' END AS language FROM paths""",
        "slice_function_code": "SELECT func_id, code FROM corpus",
        # Brackets that never close, in every 59th text, leave a file unread.
        "extract_functions": """SELECT f.func_id, 'fn' AS function, CAST(NULL AS VARCHAR) AS class_name, f.start_line,
          f.start_line + f.function_length - 1 AS end_line, f.function_length, 'a' AS parameters, f.func_id % 3 = 0 AS has_docstring, code
          FROM files f JOIN corpus USING (func_id) WHERE f.func_id % 59 <> 0""",
        "unread_files": "SELECT func_id FROM files WHERE func_id % 59 = 0",
        "extract_modules": _MODULE_ROWS,
        "has_docstring": "SELECT func_id, func_id % 3 = 0 AS has_docstring FROM corpus",
        "imports_before_function": "SELECT func_id, imports_csv AS imports FROM corpus",
        "all_local_issues": f"SELECT {_FLAT}, explanation, suggestion FROM rule_rows",
        "secret_scan_documents": """SELECT doc_id, source FROM documents WHERE regexp_matches(text,
          '(?i)(api[_-]?key|password|secret|token)\\s*=\\s*["''][^"'']+["'']')""",
        "cyclomatic_complexity": "SELECT k AS func_id, complexity FROM scored",
        "normalized_code_hash": "SELECT k AS func_id, h AS code_hash FROM hashes",
        "duplicate_groups": "SELECT h AS code_hash, members, lead_id FROM groups",
        "duplicate_members": "SELECT h AS code_hash, k AS func_id, file, members, lead_id FROM members",
        "duplicate_group_files": "SELECT h AS code_hash, file, count(*) AS functions FROM members GROUP BY h, file",
        "duplicate_issues": f"""SELECT {_FLAT}, lead_id, explanation, suggestion FROM issues JOIN texts USING (k, rule_pos)
          WHERE rule_pos = 16""",
        "duplicate_documents": """SELECT md5(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc
          FROM documents GROUP BY 1 HAVING count(*) > 1""",
        "all_issues": "SELECT phase, lead_id, k AS func_id, rule_pos, category, issue, severity FROM issues",
        "import_targets": "SELECT k AS func_id, pos, statement, target FROM targets",
        "graph_nodes": "SELECT id, type FROM nodes",
        "graph_import_edges": "SELECT DISTINCT file AS src, target AS dst FROM targets",
        "graph_structure_edges": "SELECT DISTINCT src, dst, type FROM structure",
        "graph_call_edges": "SELECT src, dst FROM call_edges",
        "graph_edges": "SELECT src, dst, type FROM edges",
        "graph_edge_count": "SELECT count(*) AS edges FROM edges",
        "node_issue_counts": "SELECT id, type, total_issues, by_category, by_severity FROM annotated",
        "node_issue_list": "SELECT id, k * 100 + rule_pos AS issue_key, issue, severity FROM nodes JOIN issues ON file = id",
        "graph_predecessors": "SELECT dst AS id, src AS neighbour FROM edges WHERE dst IN (SELECT file FROM fn)",
        "graph_successors": "SELECT src AS id, dst AS neighbour FROM edges WHERE src IN (SELECT file FROM fn)",
        "direct_impact": """WITH asked AS (SELECT DISTINCT file AS id FROM fn UNION ALL SELECT DISTINCT file || '.gone' FROM fn)
          SELECT id, CASE WHEN known THEN predecessors END AS predecessors, CASE WHEN known THEN successors END AS successors,
            CASE WHEN known THEN total END AS total_issues, CASE WHEN known THEN high END AS high_severity_issues,
            CASE WHEN known THEN round(successors + total * CAST(0.1 AS DOUBLE), 6) END AS impact_score,
            CASE WHEN NOT known THEN 'File not found in dependency graph' END AS error
          FROM (SELECT a.id, a.id IN (SELECT id FROM nodes) AS known,
              (SELECT count(*) FROM edges WHERE dst = a.id) AS predecessors,
              (SELECT count(*) FROM edges WHERE src = a.id) AS successors,
              coalesce(n, 0) AS total, coalesce(high, 0) AS high
            FROM asked a LEFT JOIN file_counts f ON f.file = a.id) x""",
        "node_display": """SELECT id, CASE len(string_split(id, '::')) WHEN 1 THEN id
            WHEN 2 THEN regexp_extract(string_split(id, '::')[1], '[^/]*$') || chr(10) || string_split(id, '::')[2]
            ELSE regexp_extract(string_split(id, '::')[1], '[^/]*$') || chr(10) || string_split(id, '::')[2] || '.'
              || string_split(id, '::')[3] END AS label,
          CASE WHEN contains(by_severity, 'High') THEN '#ff4444' WHEN contains(by_severity, 'Medium') THEN '#ffaa00'
            WHEN contains(by_severity, 'Low') THEN '#ffff00' ELSE '#44ff44' END AS color,
          greatest(15, least(40, 15 + total_issues)) AS size FROM annotated""",
        "analysis_summary": """SELECT (SELECT count(*) FROM fn) AS total_functions, (SELECT count(DISTINCT file) FROM fn) AS files_analyzed,
          (SELECT count(*) FROM issues) AS total_issues, (SELECT count(*) FROM edges) AS dependencies,
          (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM
            (SELECT category, count(*) AS n FROM issues GROUP BY 1) c) AS issues_by_category,
          (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM
            (SELECT severity, count(*) AS n FROM issues GROUP BY 1) c) AS issues_by_severity""",
        "issues_by_category": "SELECT category, count(*) AS issues FROM issues GROUP BY category",
        "issues_by_severity": "SELECT severity, count(*) AS issues FROM issues GROUP BY severity",
        "graph_summary": """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
          (SELECT CAST(sum(total_issues) AS BIGINT) FROM annotated) AS issues""",
        "graph_issue_rollup": """SELECT 'category' AS kind, category AS name, count(*) AS issues FROM issues GROUP BY category
          UNION ALL SELECT 'severity', severity, count(*) FROM issues GROUP BY severity""",
        "top_issue_files": """SELECT id, regexp_extract(id, '[^/]*$') AS name, total_issues FROM annotated
          WHERE total_issues > 0 ORDER BY total_issues DESC, id LIMIT 10""",
        "collection_stats": """SELECT 'code_functions' AS collection, count(*) AS rows FROM fn
          UNION ALL SELECT 'issues', count(*) FROM issues""",
        "report_header": """SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'High') AS high,
          count(*) FILTER (WHERE severity = 'Medium') AS medium FROM kept""",
        "issues_per_file": "SELECT file, count(*) AS issues FROM issues GROUP BY file",
        "issues_per_function": "SELECT k AS func_id, count(*) AS issues FROM issues GROUP BY k",
        "enriched_report": """SELECT i.k AS func_id, rule_pos, category, severity, function_length, nesting_depth,
          i.k % 3 = 0 AS has_docstring, 'a' AS parameters, md5(code) AS code_md5 FROM issues i JOIN fn USING (k)""",
        "collection_code_rows": """SELECT concat_ws('::', file, coalesce(class_name, 'None'), function,
            CAST(row_number() OVER (ORDER BY k) - 1 AS VARCHAR)) AS id, md5(code) AS document_md5,
          coalesce(class_name, '') AS class_name, start_line, end_line,
          '["' || array_to_string(calls, '","') || '"]' AS calls FROM fn""",
        "collection_issue_rows": """SELECT concat_ws('::', file, coalesce(class_name, ''), function,
            'issue' || (row_number() OVER (ORDER BY phase, lead_id, k, rule_pos) - 1)) AS id,
          explanation || ' ' || suggestion AS document, coalesce(class_name, '') AS class_name, category, issue, severity,
          '[' || start_line || ',' || end_line || ']' AS lines FROM issues JOIN texts USING (k, rule_pos)""",
        "knn_top3": _hits("(SELECT vec_id AS id, vec_id AS vec FROM embeddings) e", 3),
        "knn_indexed": _hits("(SELECT vec_id AS id, vec_id AS vec FROM embeddings) e", 3),
        "knn_cosine": _hits("(SELECT vec_id AS id, vec_id AS vec FROM embeddings) e", 5, measure="cosine"),
        "knn_issues": _hits("issue_vec", 5),
        "knn_filtered": _hits("(SELECT vec_id AS id, vec_id AS vec FROM embeddings) e", 3, "label = 3"),
        "lookup_by_id": "SELECT k AS id, file, function FROM fn WHERE k IN (SELECT event_id FROM events)",
        "issues_by_file_lookup": "SELECT k AS func_id, rule_pos, issue FROM issues WHERE file = 'src/m8.py' AND severity = 'High'",
        "knn_batch": """WITH asked AS (SELECT conv_id * 1000 + turn AS query_id, sub, ((conv_id * 1000 + turn) * 3 + sub) % n AS vec
            FROM conversations, size, (VALUES (1), (2), (3)) s(sub) WHERE role = 'user'),
          per_vec AS (SELECT q, id, distance, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank
            FROM distances JOIN code_vec ON c = vec)
          SELECT query_id, sub, rank, id, round(distance, 6) AS distance FROM asked JOIN per_vec ON q = asked.vec WHERE rank <= 3""",
        "code_with_context": f"""WITH hits AS ({_hits('code_vec', 5)})
          SELECT query_id, rank, h.id, f.file, (SELECT count(*) FROM edges WHERE dst = f.file) AS predecessors,
            (SELECT count(*) FROM edges WHERE src = f.file) AS successors,
            (SELECT count(*) FROM fn o WHERE o.file = f.file) - 1 AS related_functions
          FROM hits h JOIN fn f ON f.k = h.id""",
        "issues_with_context": f"""WITH hits AS ({_hits('issue_vec', 5)})
          SELECT query_id, rank, h.id, i.file, i.category, i.severity,
            (SELECT count(*) FROM issues o WHERE o.file = i.file) AS file_issues,
            (SELECT count(*) FROM issues o WHERE o.category = i.category) AS category_issues,
            (SELECT count(*) FROM issues o WHERE o.severity = i.severity) AS severity_issues
          FROM hits h JOIN issue_vec i ON i.id = h.id""",
        "route_questions": f"SELECT question_id, {_ROUTE} AS type FROM questions",
        "answer_questions": f"""WITH asked AS (SELECT question_id, text_id % n AS q, {_ROUTE} AS type FROM questions, size),
          plan AS (SELECT DISTINCT q, type, CASE type WHEN 'performance' THEN 'complexity' WHEN 'general' THEN NULL ELSE type END AS category,
            CASE type WHEN 'general' THEN 5 ELSE 10 END AS issue_k,
            CASE WHEN type IN ('security', 'performance', 'general') THEN 5 ELSE 0 END AS code_k FROM asked),
          in_issues AS (SELECT p.q, type, least(count(*), min(issue_k)) AS n, arg_min(id, (distance, id)) AS best
            FROM plan p JOIN distances d ON d.q = p.q JOIN issue_vec i ON i.vec = d.c AND (p.category IS NULL OR p.category = i.category)
            GROUP BY p.q, type),
          in_code AS (SELECT p.q, type, least(count(*), min(code_k)) AS n, arg_min(id, (distance, id)) AS best
            FROM plan p JOIN distances d ON d.q = p.q JOIN code_vec i ON i.vec = d.c WHERE code_k > 0 GROUP BY p.q, type),
          counted AS (SELECT question_id, type, coalesce(i.n, 0) AS a, coalesce(c.n, 0) AS b, i.best AS best_issues, c.best AS best_code
            FROM asked LEFT JOIN in_issues i USING (q, type) LEFT JOIN in_code c USING (q, type))
          SELECT question_id, type, a AS issues_found, b AS code_found, best_issues, best_code, CASE type
            WHEN 'security' THEN 'Found ' || a || ' security issues and ' || b || ' related code functions.'
            WHEN 'performance' THEN 'Found ' || a || ' complexity issues and ' || b || ' related code functions.'
            WHEN 'duplication' THEN 'Found ' || a || ' duplicate functions.'
            WHEN 'documentation' THEN 'Found ' || a || ' documentation issues.'
            WHEN 'complexity' THEN 'Found ' || a || ' complexity issues.'
            ELSE 'Found ' || b || ' relevant code functions and ' || a || ' related issues.' END AS summary FROM counted""",
        "chat_memory_rows": "SELECT conv_id || ':' || turn AS id, role || ': ' || text AS document, role FROM conversations",
        "chat_last5_window": """SELECT conv_id, turn, count(shown) OVER w AS exchanges,
            coalesce(string_agg(shown, chr(10)) OVER w, '') AS window_text FROM exchanges
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
        "chat_memory_confidence": "SELECT query_id, hits, round(confidence, 6) AS confidence FROM confidence",
        "retrieval_gate": f"SELECT * FROM ({_hits('code_vec', 3)}) g WHERE query_id IN (SELECT query_id FROM confidence WHERE confidence < 0.5)",
        "route_debug": "SELECT conv_id, turn, lower(text) LIKE '%think%' AS debug FROM turns",
        "context_text": f"""SELECT vec_id AS query_id, coalesce(string_agg('assistant: ' || text, chr(10) ORDER BY rank), '{NO_HISTORY}') AS text
          FROM embeddings LEFT JOIN memory_hits ON q = vec_id GROUP BY vec_id""",
        "report_issues": "SELECT k AS func_id, rule_pos, severity, category, issue FROM kept",
        "report_numbered": "SELECT number, k AS func_id, rule_pos, severity FROM numbered",
        "report_priority": """SELECT k AS func_id, rule_pos, CASE WHEN category IN ('security', 'complexity') AND severity = 'High'
          THEN 'High' ELSE 'Medium' END AS priority FROM issues""",
        "report_batches": "SELECT CAST(floor((number - 1) / 4) AS BIGINT) + 1 AS batch, count(*) AS issues FROM numbered GROUP BY 1",
        "extract_lines": """SELECT doc_id AS path, doc_id % 3 + 1 AS start_line, doc_id % 3 + 1 + doc_id % 4 AS end_line,
          array_to_string(string_split(text, chr(10))[doc_id % 3 + 1 : doc_id % 3 + 1 + doc_id % 4], chr(10)) AS text FROM documents""",
        "stream_rule_parity": "SELECT k AS func_id, rule_id, issue, severity FROM rule_rows",
    }
    place = "file || ' (lines ' || start_line || '-' || end_line || ')'"
    why = "CASE category " + " ".join(
        f"WHEN '{c}' THEN '**{heading}:** ' || explanation || chr(10) || chr(10) || {_text(closing)}"
        for c, (heading, closing, _) in report.SECTIONS.items()
    ) + " END"
    sql["report_sections"] = f"""SELECT CAST(0 AS BIGINT) AS number, {_text(report.TITLE)} || chr(10) || chr(10) || '**Issues:** ' || count(*)
          || chr(10) || '**High:** ' || count(*) FILTER (WHERE severity = 'High') || chr(10) || '**Medium:** '
          || count(*) FILTER (WHERE severity = 'Medium') || chr(10) || chr(10) || '---' || chr(10) AS text FROM kept
        UNION ALL SELECT number, '### Issue ' || number || ': ' || issue || chr(10) || '**File:** ' || {place} || chr(10)
          || '**Severity:** ' || severity || chr(10) || '**Category:** ' || category || chr(10) || chr(10)
          || '**Why it matters:**' || chr(10) || {why} || chr(10) || chr(10) || '**How to fix it:**' || chr(10) || suggestion
          || chr(10) || chr(10) || '**Priority:** ' || CASE WHEN category IN ('security', 'complexity') AND severity = 'High'
            THEN 'High' ELSE 'Medium' END || chr(10) || chr(10) || '---' || chr(10) FROM numbered JOIN texts USING (k, rule_pos)"""
    sql["report_prompts"] = f"""SELECT CAST(floor((number - 1) / 4) AS BIGINT) + 1 AS batch, md5(prompt) AS prompt_md5, length(prompt) AS characters
        FROM (SELECT min(number) AS number, {_text(report.PROMPT_HEAD)} || string_agg(chr(10) || '### Issue ' || ((number - 1) % 4 + 1)
          || chr(10) || 'File: ' || numbered.file || ' (lines ' || numbered.start_line || '-' || numbered.end_line || ')' || chr(10)
          || 'Severity: ' || severity || chr(10) || 'Category: ' || category || chr(10) || 'Issue: ' || issue || chr(10)
          || 'Code:' || chr(10) || code || chr(10), '' ORDER BY number) AS prompt
        FROM numbered JOIN fn USING (k) GROUP BY floor((number - 1) / 4)) p"""
    for name, rule_id in RULE_QUERIES.items():
        sql[name] = f"SELECT {_FLAT}, explanation FROM rule_rows WHERE rule_id = '{rule_id}'"
    return sql


def oracle_sql() -> dict[str, str]:
    statements = {}
    for name, sql in _statements().items():
        if sql.startswith("WITH "):
            views = ",\n".join(f"{v} AS MATERIALIZED ({_CTES[v]})" for v in _needed(sql))
            statements[name] = f"WITH {views},\n{sql[5:]}"
        else:
            statements[name] = _with(sql)
    reach = """reach AS (SELECT DISTINCT file AS seed, file AS id FROM fn
      UNION SELECT seed, dst FROM reach JOIN edges ON src = id)"""
    statements["transitive_impact"] = _with(
        """SELECT seed AS id, (SELECT count(*) FROM edges WHERE src = seed) AS direct_dependents,
          count(*) FILTER (WHERE reach.id <> seed) AS transitive_dependents,
          CAST(coalesce(sum(n) FILTER (WHERE reach.id <> seed), 0) AS BIGINT) AS total_issues_in_dependents
        FROM reach LEFT JOIN file_counts ON file = reach.id GROUP BY seed""",
        reach,
    )
    return statements
