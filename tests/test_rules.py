import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions.complexity import cyclomatic_complexity
from siltstone.functions.normalize import normalized_code
from siltstone.functions.text import has_docstring, imports_before, strip
from siltstone.operators.issues import issues_of_rule, rule_issues

ODD = ["\x1c", "\x85", " ", "\u212a", "ſ", "\x0b", "\u3000", "²", "é", "\r", "\0"]
PIECES = [
    "def f(a):", "# note", "  # indented", "", "   ", "\t", '"""', "'''", '"""one line"""', "'''x''' + \"\"\"", "x = 'a' + b + 'c'",
    'q = "s" + t', '+ "', "if a and b:", "else if", "ELSE  IF", "elif", "=> {", "x ? y : z", "a && b || c", "iff if_ if", "{[(", ")]}",
    "password = 'p'", "TOKEN='t'", "to\u212aen = 'k'", "ſecret = \"s\"", "api-key\u3000=\x1c'z'", "  c  =  1 ", "for while do case default",
    "eval (x)", "exec\u3000(", "medieval(", "md5(", "_md5(", "²md5(", *ODD]
TEXTS = st.lists(
    st.lists(st.sampled_from(PIECES), max_size=14).flatmap(
        lambda p: st.lists(st.sampled_from(["\n", "\n", "\n", " ", ""]), min_size=len(p), max_size=len(p)).map(
            lambda s: "".join(a + b for a, b in zip(p, s))
        )
    ),
    min_size=150,
    max_size=250,
)
PROPERTY = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

WORDS = "if elif switch case default for while do foreach try catch except finally and or".split()


def computed(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string").repartition(4, "i")
    return [tuple(r)[1:] for r in sorted(rows.select("i", *columns).collect())]


def complexity_spec(code):
    low = code.lower()
    whole = sum(len(re.findall(rf"\b{w}\b", low)) for w in WORDS)
    whole += len(re.findall(r"\belse\s+if\b", low)) + low.count("&&") + low.count("||") + low.count("?")
    open_ = sum(map(code.count, "{[(")) - sum(map(code.count, "}])"))
    return int(1 + whole + 0.5 * low.count("=>") + 0.5 * max(0, open_))


def normal_spec(code, balanced=False):
    kept, inside = [], None
    for line in code.split("\n"):
        words = " ".join(line.split())
        if not words:
            continue
        quote = inside or next((q for q in ('"""', "'''") if q in line), None)
        if '"""' in line or "'''" in line:
            if inside is None or quote in line:
                toggles = line.count(quote) % 2 == 1 if balanced else True
                if toggles:
                    inside = quote if inside is None else None
        elif inside is None and not words.startswith("#"):
            kept.append(words)
    return "\n".join(kept)


@PROPERTY
@given(TEXTS)
def test_complexity_follows_its_definition(spark, texts):
    found = computed(spark, texts, cyclomatic_complexity(F.col("code")))
    assert [x for (x,) in found] == [complexity_spec(t) for t in texts]


@PROPERTY
@given(TEXTS)
def test_normal_form_follows_its_definition(spark, texts):
    code = F.col("code")
    found = computed(spark, texts, normalized_code(code), normalized_code(code, "balanced"))
    assert found == [(normal_spec(t), normal_spec(t, balanced=True)) for t in texts]


@PROPERTY
@given(TEXTS)
def test_patterns_match_as_in_python(spark, texts):
    specs = {
        R.EVAL_EXEC: re.compile(r"\b(eval|exec)\s*\("),
        R.SQL_INJECTION: re.compile(r"""["'].*\+.*["']"""),
        R.WEAK_HASH: re.compile(r"\b(md5|sha1)\s*\("),
        R.HARDCODED_SECRET: re.compile(r"""(api[_-]?key|password|secret|token)\s*=\s*["'][^"']+["']""", re.I),
    }
    found = computed(spark, texts, *[F.col("code").rlike(p) for p in specs])
    assert found == [tuple(bool(s.search(t)) for s in specs.values()) for t in texts]


@PROPERTY
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    lines = F.split("code", "\n", -1)
    found = computed(spark, texts, strip(F.col("code")), has_docstring(F.col("code")), imports_before(lines, F.lit(3)))

    def expected(t):
        head = t.strip().split("\n")
        doc = len(head) > 1 and any('"""' in x or "'''" in x for x in head[:5])
        return t.strip(), doc, [x.strip() for x in t.split("\n")[:3] if x.strip().startswith(("import ", "from "))]

    assert found == [expected(t) for t in texts]


CASES = {
    "R1": (["x = eval (s)", "exec(s)"], ["medieval(s)", "evaluate(s)", "_eval(s)"]),
    "R2": (["q = 'a' + b + 'c'", "\"+\""], ["q = 'a'\n+ 'b'", "a + b", "'a' b +"]),
    "R3": (["md5(x)", "sha1 (x)"], ["MD5(x)", "hmd5(x)"]),
    "R4": (["API_KEY = 'x'", "my_password='y'"], ["password = ''", "token == x"]),
    "R5": (["eval(x)"], ["exec(x)"]),
    "R6": (["new  Function('x')"], ["newFunction()"]),
    "R7": (["a.innerHTML == b"], ["innerHTML = b"]),
    "R8": (["document.write (x)"], ["documentXwrite(x)"]),
    "R9": (["Runtime.getRuntime().exec(c)"], ["getRuntime().exec(c)"]),
    "R10": (['MessageDigest.getInstance( "SHA1" )'], ['MessageDigest.getInstance("SHA-1")']),
    "R11": (['Statement.executeQuery(a +"x")', 'Statement.executeUpdate (q+"a" + b +"c")'], ['Statement.execute(a +"x")', 'Statement.executeQuery(a\n+"x")', 'Statement.executeQuery(a +")']),
}


def test_security_rules(spark, functions):
    rows = [(f"{rule}{hit}{i}", code, rule, hit) for rule, (yes, no) in CASES.items() for hit, codes in ((1, yes), (0, no)) for i, code in enumerate(codes)]
    frame = functions(*[(i, "a.c", None, name, code, (), ()) for i, (name, code, _, _) in enumerate(rows)])
    hits = {(r.function, r.rule_id) for r in rule_issues(frame).collect()}
    for name, code, rule, hit in rows:
        assert ((name, rule) in hits) == bool(hit), (rule, code)
    for rule in CASES:
        assert {r.function for r in issues_of_rule(frame, rule).collect()} == {f for f, x in hits if x == rule}


def test_the_two_reference_fixtures(functions):
    rows = functions((1, "test.py", None, "test_function", "def test_function():\n    eval('1')", (), ()))
    assert any("eval" in r.issue for r in rule_issues(rows).collect())


def test_measures(spark, functions):
    frame = functions(*[(i, "x.py", None, "_f", "y\n" * n + "z", (), ()) for i, n in enumerate((199, 200, 499, 500))])
    found = {r.func_id: (r.issue, r.severity) for r in rule_issues(frame).where("rule_id = 'R12'").collect()}
    assert found == {1: ("Function too long (201 lines)", "Medium"), 2: ("Function too long (500 lines)", "Medium"), 3: ("Function too long (501 lines)", "High")}
    deep = frame.withColumn("nesting_depth", (F.col("func_id") + 2).cast("int"))
    assert {r.func_id for r in rule_issues(deep).where("rule_id = 'R14'").collect()} == {2, 3}
    branchy = functions(*[(n, "x.py", None, "_f", "if " * n, (), ()) for n in (9, 10, 14, 15)])
    assert {r.func_id: r.severity for r in rule_issues(branchy).where("rule_id = 'R13'").collect()} == {10: "Medium", 14: "Medium", 15: "High"}


def test_documentation(functions):
    cases = [
        ("a.py", "f", "x", True), ("a.py", "_f", "x", False), ("a.py", "__init__", "x", True), ("a.py", "__x", "x", False),
        ("a.py", "f", 'def f():\n """d"""', False), ("a.JS", "_f", "x", True), ("a.tsx", "f", "/** d */", False), ("a.java", "f", "/**/", True),
        ("a.java", "f", "/**\n*/", False), ("a.c", "f", "x", False), ("a.java", "f", "*/ /** x", True),
    ]
    frame = functions(*[(i, file, None, name, code, (), ()) for i, (file, name, code, _) in enumerate(cases)])
    found = {r.func_id for r in rule_issues(frame).where("rule_id = 'R15'").collect()}
    assert found == {i for i, case in enumerate(cases) if case[3]}


def test_by_language(functions):
    frame = functions((1, "a.py", None, "f", "new Function(x)", (), ()), (2, "a.ts", None, "f", "new Function(x)", (), ()))
    assert {r.func_id for r in rule_issues(frame, by_language=True).where("rule_id = 'R6'").collect()} == {2}
    assert {r.func_id for r in rule_issues(frame).where("rule_id = 'R6'").collect()} == {1, 2}


def test_a_rule_can_be_added(functions):
    todo = R.Rule("X1", "documentation", "Open task", "Low", lambda: F.col("code").contains("TODO"), "A task is open.", "Do it.")
    frame = functions((1, "a.py", None, "_f", "TODO eval(x)", (), ()))
    found = [(r.rule_pos, r.rule_id) for r in rule_issues(frame, (*R.default_rules(), todo)).orderBy("rule_pos").collect()]
    assert found == [(1, "R1"), (5, "R5"), (16, "X1")]


def test_long_lines_take_linear_time(spark):
    text = "'" * 20000 + "x" * 20000 + '"""' * 3000
    frame = spark.createDataFrame([(text,)], "code string")
    for mode in ("reference", "balanced"):
        assert frame.select(normalized_code(F.col("code"), mode)).collect()
    assert frame.where(F.col("code").rlike(R.SQL_INJECTION)).count() == 0


def test_cheap_tests_before_patterns_change_nothing(spark):
    from siltstone.functions import complexity, normalize, text

    # What the classes of Unicode alone give, without the plain tests before them.
    words = f"{text.WORD_START}(?:{'|'.join(complexity.BRANCH_WORDS)}){text.WORD_END}"
    assert "(?<![a-z0-9_])" in complexity._BRANCH
    codes = ["if xéif _if 1if ß if.if", "a => b => [{(", ")]} ([{ =>", "İf IF else  if elseif", "", "x ? y && z || w", None]
    codes += ["a  b\t c\n \t\n # d e \x1c f\r\n  #g\n", "   ", "a b", "''' x\n y ''' z\n  k  l", "a \t", "q\x85 r  \n s"]
    frame = spark.createDataFrame([(c,) for c in codes], "code string")
    low, code = F.lower("code"), F.col("code")

    def lacking(sign):
        return F.length(F.replace(code, F.lit(sign)))

    halves = (F.length(code) - lacking("=>")) / 2 + F.greatest(F.lit(0), sum(map(lacking, ")]}"), F.lit(0)) - sum(map(lacking, "([{"), F.lit(0)))
    branches = F.regexp_count(low, F.lit(f"{words}|&&|\\|\\||\\?")) + F.regexp_count(low, F.lit(complexity._ELSE_IF))
    plain = F.regexp_replace(F.regexp_replace(code, normalize._REGIONS["reference"], ""), rf"{text.LINE_SPACE}+", " ")
    plain = F.trim(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    plain = F.trim(F.regexp_replace(plain, r"(?md)^#[^\n]*\n?", ""), F.lit("\n"))
    rows = frame.select(
        complexity.cyclomatic_complexity(code), (F.lit(1) + branches + F.floor(halves / 2)).cast("int"), normalize.normalized_code(code), plain
    ).collect()
    assert len(rows) == len(codes)
    for score, wanted, normal, wanted_normal in rows:
        assert (score, normal) == (wanted, wanted_normal)
