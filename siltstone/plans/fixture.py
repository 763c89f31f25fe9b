"""Views that derive source-like rows from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import has_docstring
from siltstone.session import spread

CORPUS_SQL = r"""
SELECT o_orderkey AS func_id,
  concat('src/m', CAST(o_custkey % 97 AS STRING), CASE o_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tsx' ELSE '.java' END) AS file,
  concat(CASE WHEN o_orderkey % 11 = 0 THEN '_' ELSE '' END, 'fn_', CAST(o_orderkey % 5003 AS STRING)) AS function,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('C', CAST(o_orderkey % 3 AS STRING)) END AS class_name,
  CAST(1 + (o_orderkey % 13) * 20 AS INT) AS start_line,
  CAST(o_orderkey % 6 AS INT) AS nesting_depth,
  concat('def fn(a):',
    CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), '  ', repeat('"', 3), chr(10), '  doc', chr(10), '  ', repeat('"', 3)) ELSE '' END,
    CASE WHEN o_orderkey % 17 = 0 THEN concat(chr(10), '  eval(a)') ELSE '' END,
    CASE WHEN o_orderkey % 19 = 0 THEN concat(chr(10), '  q = "select " + a + " from t"') ELSE '' END,
    CASE WHEN o_orderkey % 23 = 0 THEN concat(chr(10), '  h = md5(a)') ELSE '' END,
    CASE WHEN o_orderkey % 29 = 0 THEN concat(chr(10), '  api_key = ''k', CAST(o_orderkey AS STRING), '''') ELSE '' END,
    CASE WHEN o_orderkey % 31 = 0 THEN concat(chr(10), '  new Function(a)') ELSE '' END,
    CASE WHEN o_orderkey % 37 = 0 THEN concat(chr(10), '  el.innerHTML = a') ELSE '' END,
    CASE WHEN o_orderkey % 41 = 0 THEN concat(chr(10), '  document.write(a)') ELSE '' END,
    CASE WHEN o_orderkey % 43 = 0 THEN concat(chr(10), '  Runtime.getRuntime().exec(a)') ELSE '' END,
    CASE WHEN o_orderkey % 47 = 0 THEN concat(chr(10), '  MessageDigest.getInstance("MD5")') ELSE '' END,
    CASE WHEN o_orderkey % 53 = 0 THEN concat(chr(10), '  Statement.executeQuery(a +"x")') ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN concat(chr(10), '  /** jsdoc */') ELSE '' END,
    CASE WHEN o_orderkey % 59 = 0 THEN concat(chr(10), '  f((x => [x') ELSE '' END,
    repeat(concat(chr(10), '  if a and b:', chr(10), '    c  =  1'), CAST(o_orderkey % 9 AS INT)),
    CASE WHEN o_orderkey % 101 = 0 THEN repeat(concat(chr(10), '  x = 1'), 210) ELSE '' END,
    CASE WHEN o_orderkey % 503 = 0 THEN repeat(concat(chr(10), '  y = 2'), 400) ELSE '' END,
    chr(10), '  # note ', CAST(o_orderkey AS STRING),
    chr(10), '  return helper_', CAST(o_orderkey % 50 AS STRING), '(a)') AS code,
  concat('fn_', CAST(CAST(floor((o_orderkey % 5003) / 3) AS BIGINT) AS STRING), CASE WHEN o_orderkey % 97 = 0 THEN concat(',fn_', CAST(((o_orderkey % 5003) * 3 + 1) % 5003 AS STRING)) ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN concat(',fn_', CAST(o_orderkey % 5003 AS STRING)) ELSE '' END, ',obj.method') AS calls_csv,
  concat('import os.path', CASE WHEN o_orderkey % 2 = 0 THEN concat('|from src.m', CAST(o_orderkey % 97 AS STRING), ' import x') ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN '|import a, b|from . import y|import java.util.List;|import fs from ''fs''' ELSE '' END) AS imports_csv
FROM {orders}
"""

PATHS_SQL = """
SELECT func_id,
  concat(CASE func_id % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'src/node_modules/' WHEN 2 THEN 'a.egg-info/' ELSE '' END,
    'f', CAST(func_id AS STRING),
    CASE func_id % 9 WHEN 0 THEN '.min.js' WHEN 1 THEN '.chunk.js' WHEN 2 THEN '.md' WHEN 3 THEN '.PY' WHEN 4 THEN '.jsx' WHEN 5 THEN '.ts' WHEN 6 THEN '.java' WHEN 7 THEN '.py' ELSE '' END) AS path
FROM {corpus}
"""

FILES_SQL = """
SELECT func_id, file,
  concat(replace(imports_csv, '|', chr(10)), chr(10), code, chr(10), 'import late') AS content,
  CAST(length(imports_csv) - length(replace(imports_csv, '|', '')) + 2 AS INT) AS start_line,
  CAST(length(code) - length(replace(code, chr(10), '')) + 1 AS INT) AS function_length
FROM {corpus}
"""

# Whole source files in three languages, made from the key k: k % 4 comment lines
# on top, some lines only where k is odd, <k%5> in a line is that number.
MODULES = {
    "python": """
import os
from a.b import c
note # note ( {
class K<k%5>(Base):
    \"\"\"doc ( {
    end\"\"\"
    def run(self, a, *rest, b=f(1), **kw):
        # open (
        if a and (b or
                rest):
            for x in os.listdir(a):
                self.go(len(x))
odd         elif b:
odd             x.y.z()
        return "}"

    async def late(self): pass

def top_<k%11>(u):
    def inner(v):
        while v:
            with u:
                v()
    return inner
tail = 1""",
    "javascript": """
import x from 'x';
note // note ) }
/* block {
   ` " */ const t = `a { ${1}
// in template }`;
export async function load_<k%11>(a, b = [1, 2], ...rest) {
  if (a) { return "}"; } else if (b) {
    for (let i = 0; i < 3; i++) { while (a) { a--; } }
  }
odd   for (const q of b) { try { q(); } catch (e) {} }
  return function named() {};
}
class K<k%5> extends Base {
  static async get(x, {y}) { return x; }
  handle = (e) => {
    this.go(e);
  }
}
const pick_<k%7> = (u) => u.v
list.map(z => z);""",
    "java": """
import java.util.List;
note // note (
public class K<k%5><T> {
  private int[] n = {1, 2};
  K<k%5>(int a) { n[0] = a; }
  /** doc { */
  @Override
  public <R> Map<String, R> add_<k%11>(final int a, Map<String, R> m,
      int... rest) throws A, B {
    String s = "{" + '"' + \"\"\"
      { " }
    \"\"\";
    if (a > 0) { for (int i = 0; i < a; i++) { a--; } }
odd     try (X x = y()) { } catch (E e) { }
    return null;
  }
  interface In {
    void call(int q);
  }
}""",
}


def _line_sql(line: str) -> str:
    """One line behind a line feed, in SQL of both engines; braces would be read as places of tables."""
    often = "1"
    for mark, times in (("note ", "CAST(k % 4 AS INT)"), ("odd ", "CAST(k % 2 AS INT)")):
        if line.startswith(mark):
            often, line = times, line.removeprefix(mark)
    parts = []
    for i, text in enumerate(re.split(r"<k%(\d+)>", line)):
        if i % 2:
            parts.append(f"CAST(k % {text} AS STRING)")
        else:
            parts += [{"{": "chr(123)", "}": "chr(125)"}.get(t, "'" + t.replace("'", "''") + "'") for t in re.split("([{}])", text)]
    return f"repeat(concat(chr(10), {', '.join(parts)}), {often})"


_MODULE_TEXTS = {name: "concat(" + ", ".join(map(_line_sql, text.split("\n")[1:])) + ")" for name, text in MODULES.items()}
_ENDINGS = {"python": ".py", "javascript": ".ts", "java": ".java"}
MODULES_SQL = f"""
SELECT k, concat('m/f', CAST(k AS STRING), CASE k % 3 {" ".join(f"WHEN {i} THEN '{_ENDINGS[m]}'" for i, m in enumerate(MODULES))} END) AS path,
  CASE k % 3 {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODULES))} END AS language,
  substr(CASE k % 3 {" ".join(f"WHEN {i} THEN {_MODULE_TEXTS[m]}" for i, m in enumerate(MODULES))} END, 2) AS content
FROM (SELECT o_orderkey AS k FROM {{orders}}) keys
"""

# One of the routing words, or a text without any; some in upper case, some
# with a second word.
QUESTION_WORDS = (
    "security",
    "vulnerability",
    "injection",
    "crypto",
    "secret",
    "performance",
    "bottleneck",
    "slow",
    "optimize",
    "duplicate",
    "copy",
    "similar",
    "documentation",
    "docstring",
    "comment",
    "complex",
    "complexity",
    "nested",
    "billing",
    "login",
    "retries",
    "caches",
)
QUESTIONS_SQL = f"""
SELECT event_id AS question_id, event_id % 66 AS text_id,
  concat('where is ',
    CASE WHEN event_id % 66 >= 44 THEN upper(word) ELSE word END,
    CASE WHEN event_id % 66 >= 22 AND event_id % 66 < 44 THEN ' or nested copy' ELSE '' END,
    ' handled?') AS question
FROM (SELECT event_id, CASE event_id % 22
    {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(QUESTION_WORDS))} END AS word
  FROM {{events}}) words
"""


# The conversations hold no turn that asks for debugging, so some user turns get the word.
TURNS_SQL = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' AND (conv_id + turn) % 11 = 0 THEN concat(text, ' Think again.') ELSE text END AS text
FROM {conversations}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are made from two numbers each and are costly to analyse, so
    the numbers are spread over the cores before the text exists."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spark.sql(CORPUS_SQL, orders=spread(keys))


def functions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a FUNCTIONS frame."""
    length = F.size(F.split("code", "\n", -1))
    return corpus_view(spark, sf_dir).select(
        "func_id",
        "file",
        "class_name",
        "function",
        "start_line",
        (F.col("start_line") + length - 1).alias("end_line"),
        F.array(F.lit("a")).alias("parameters"),
        length.alias("function_length"),
        "nesting_depth",
        has_docstring(F.col("code")).alias("has_docstring"),
        F.split("calls_csv", ",").alias("calls"),
        F.split("imports_csv", "[|]").alias("imports"),
        F.col("file").alias("parent_file"),
        "code",
    )


def paths_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATHS_SQL, corpus=corpus_view(spark, sf_dir))


def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES_SQL, corpus=corpus_view(spark, sf_dir))


def modules_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as FILES, with the key they are made from."""
    return spark.sql(MODULES_SQL, orders=spread(table(spark, sf_dir, "orders").select("o_orderkey")))


def questions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS_SQL, events=table(spark, sf_dir, "events"))


def turns_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TURNS_SQL, conversations=table(spark, sf_dir, "conversations"))
