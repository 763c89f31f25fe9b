"""One row per function from source files.

Lines, tokens and brackets come from ``tokens``; everything here is windows
over them.  In JavaScript and Java a declaration is a run of neighbours in the
sequence of its bracket.  In Python a block ends before the next statement that
is not indented further than its header.  Of functions within functions only
the outermost has a row; its class is the innermost class around it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import indented, lexis
from siltstone.functions.indented import WORDS
from siltstone.functions.lexis import CODE, OPENERS, is_name
from siltstone.functions.text import has_docstring, imports_before, slice_lines
from siltstone.operators.tokens import LINE, source_lines, source_tokens, unmatched
from siltstone.session import discard, durable

FOUND = ("class_name", "function", "start_line", "end_line", "parameters", "nesting_depth", "calls")
_FOUND = (
    "array<struct<class_name:string,function:string,start_line:int,end_line:int,"
    "parameters:array<string>,nesting_depth:int,calls:array<string>>>"
)

# For another language: takes a text, gives rows of FOUND.
Outliner = Callable[[str], list[tuple]]

# Words that languages reserve.
SPLIT_BY = {"elif", "else", "except", "finally"}  # these go on with a statement that was there before
MODIFIERS = (
    "public protected private static final abstract synchronized native strictfp default async get set override readonly declare export"
).split()
CONTROL_HEADS = ("if", "for", "while", "switch", "catch")
CONTROLS = (*CONTROL_HEADS, "try", "else", "finally", "do")
BEFORE_VALUE = ("=", "(", ",", ":", "?", "[", "!", "&", "|", "+", "return", "=>")
IN_PLACE = 1 << 16  # Python texts of up to so many characters are read within their row


def _order(*keys: str):
    return Window.partitionBy("path", *keys).orderBy("pos")


def _seen(*keys: str):
    return _order(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _coming(*keys: str):
    """Rows behind the present one, the nearest last, so that no frame is looked through again and again."""
    return Window.partitionBy("path", *keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def _sum(column: Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _beside(rows: DataFrame, steps: range, *fields: str) -> DataFrame:
    """``t-2, t-1, t1, ...``: neighbours in the sequence of a bracket as structs of fields."""
    order = _order("inst")
    what = F.struct("tok", *fields)
    return rows.withColumns({f"t{k}": F.lead(what, k).over(order) if k > 0 else F.lag(what, -k).over(order) for k in steps if k})


def _t(k: int, field: str = "tok") -> Column:
    return F.col(f"`t{k}`.{field}")


# ---------------------------------------------------------------- JavaScript and Java


def _bracketed(tokens: DataFrame, compat: bool) -> tuple[DataFrame, DataFrame]:
    """Functions and class bodies of the languages with brackets.

    Functions: ``path, language, function, own_class, pos, end, start_line,
    end_line, sig, body``; class bodies: ``path, name, pos, end``.
    """
    rows = _beside(tokens.where(F.col("language") != "python"), range(-3, 6), "pos", "line", "pair")
    java = F.col("language") == "java"
    name = is_name(F.col("tok"))
    rows = rows.withColumn("last_line", F.greatest("pair_line", "line"))
    stop = F.when(F.col("tok").isin("{", ";", "=", "}"), F.struct("tok", "pos", "line", F.col("pair").alias("end"), F.col("pair_line").alias("end_line")))
    rows = rows.withColumn("next_stop", F.last(stop, ignorenulls=True).over(_coming("inst")))
    # Bodies of classes and other types, by the place of their bracket.
    heads = F.col("tok").isin("class", "interface", "enum", "record") & (_t(-1).isNull() | ~_t(-1).isin(".", "@")) & is_name(_t(1), ["extends", "implements"])
    heads &= (F.col("tok") == "class") | java
    shut = (F.col("next_stop.tok") == "{") & F.col("next_stop.end").isNotNull()
    bodies = rows.where(heads & shut).select(
        "path", F.col("next_stop.pos").alias("pos"), F.col("next_stop.end").alias("end"), _t(1).alias("name"), F.col("tok").alias("kind")
    )
    classes = bodies.where("kind = 'class'").drop("kind")
    own = bodies.select(F.col("path").alias("_p"), F.col("pos").alias("_body"), F.col("name").alias("own_type"))
    rows = rows.join(own, (F.col("path") == F.col("_p")) & (F.col("inst") == F.col("_body")), "left").drop("_p", "_body")

    # Members begin behind the last semicolon or closing brace of their body.
    cut = F.col("tok").isin(";", "}")
    rows = rows.withColumn("segment", _sum(cut.cast("int"), _seen("inst")))
    part = _seen("inst", "segment")
    first = F.first(F.struct("pos", "line")).over(part.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({
        "first": first,
        "assigned": F.coalesce(F.max(F.col("tok") == "=").over(part), F.lit(False)),
    })
    signature = name & (_t(1) == "(") & (_t(2) == ")")
    direct = F.col("own_type").isNotNull() & signature & ~F.col("assigned") & ~F.coalesce(_t(-1).isin(".", "new", "@", "function"), F.lit(False))

    typed = (is_name(_t(-1), MODIFIERS + ["extends", "implements"]) & (_t(-2).isNull() | (_t(-2) != "@"))) | _t(-1).isin("]", ">")
    java_method = java & direct & typed & (F.col("tok") != F.col("own_type")) & _t(3).isin("{", ";", "throws", "[")
    at_start = _t(-1).isNull() | _t(-1).isin(";", "}", "*", ")") | _t(-1).isin(*MODIFIERS) | (_t(-2) == "@")
    js_method = ~java & direct & at_start & _t(3).isin("{", ":") & ~F.col("tok").isin(*CONTROL_HEADS) & F.lit(not compat)

    starred = F.when(_t(-1) == "*", _t(-2)).otherwise(_t(-1)) == "function"
    word_at = F.when(_t(-1) == "*", 2).otherwise(1)
    before_word = F.when(word_at == 2, _t(-3)).otherwise(_t(-2))
    is_async = before_word == "async"
    rows = _beside(rows, range(-4, -3), "line")
    before_all = F.when(is_async, F.when(word_at == 2, _t(-4)).otherwise(_t(-3))).otherwise(before_word)
    value = F.when(before_all.isNull(), F.coalesce(F.col("inst_tok").isin("(", "["), F.lit(False))).otherwise(before_all.isin(*BEFORE_VALUE))
    declared = ~java & signature & starred & ~value & _t(3).isin("{", ":")
    declared_at = F.when(word_at == 2, F.when(is_async, _t(-3, "line")).otherwise(_t(-2, "line"))).otherwise(
        F.when(is_async, _t(-2, "line")).otherwise(_t(-1, "line"))
    )
    # Arrows: a name, perhaps a type of one word, the sign, and parameters in brackets or alone.
    shift = F.when(_t(2) == "async", 1).otherwise(0)
    p = lambda k, field="tok": F.when(shift == 1, _t(k + 1, field)).otherwise(_t(k, field))
    rows = _beside(rows, range(6, 9), "pos", "line")
    named = ~java & name & (_t(1) == "=")
    listed = named & (p(2) == "(") & (p(3) == ")") & ((p(4) == "=>") | ((p(4) == ":") & (p(6) == "=>")))
    lone = named & is_name(p(2)) & (p(3) == "=>")
    typed_name = (_t(-1) == ":") & is_name(_t(-2))
    bare = ~java & name & (_t(1) == "=>")
    if compat:
        listed, lone = F.lit(False), F.lit(False)
    else:
        bare = F.lit(False)
    arrow_at = F.when(bare, F.struct(*(_t(1, f).alias(f) for f in ("pos", "line")))).when(
        lone, F.struct(*(p(3, f).alias(f) for f in ("pos", "line")))
    ).when(listed, F.when(p(4) == "=>", F.struct(*(p(4, f).alias(f) for f in ("pos", "line")))).otherwise(F.struct(*(p(6, f).alias(f) for f in ("pos", "line")))))
    kind = F.when(java_method | js_method, "member").when(declared, "declared").when(listed | lone | bare, "arrow")
    arrow_name = F.when(typed_name & ~bare, _t(-2)).otherwise(F.col("tok"))
    arrow_sig = F.when(listed, p(2, "pos"))
    arrow_lone = F.when(bare, F.col("tok")).when(lone, p(2))
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    found = found.select(
        "path", "language", "kind", "inst", F.col("own_type"),
        F.when(F.col("kind") == "arrow", arrow_name).otherwise(F.col("tok")).alias("function"),
        F.col("pos"),
        F.when(F.col("kind") == "member", F.col("first.line")).when(F.col("kind") == "declared", declared_at)
        .when(typed_name & ~F.lit(compat), _t(-2, "line")).otherwise(F.col("line")).alias("start_line"),
        F.when(F.col("kind") == "arrow", arrow_sig).otherwise(_t(1, "pos")).alias("sig"),
        F.when(F.col("kind") == "arrow", arrow_lone).alias("lone"),
        F.when(F.col("kind") == "arrow", arrow_at["pos"]).otherwise(_t(2, "pos")).alias("asks"),
    )
    # What stands behind a parameter list, and where the body behind an arrow ends.
    breaks = F.col("tok").isin(";", ",") | (F.col("line") > F.lag("last_line").over(_order("inst")))
    ends = F.when(breaks, F.struct(F.lag("last_line").over(_order("inst")).alias("line"), F.lag(F.coalesce("pair", "pos")).over(_order("inst")).alias("pos")))
    ends = F.when(F.lead("pos").over(_order("inst")).isNull() & ~breaks, F.struct(F.col("last_line").alias("line"), F.coalesce("pair", "pos").alias("pos"))).otherwise(ends)
    asked = rows.withColumn("_ends", ends).withColumn("_end", F.last("_ends", ignorenulls=True).over(_coming("inst")))
    own_end = F.when(F.lead("pos").over(_order("inst")).isNull(), F.struct(F.col("last_line").alias("line"), F.coalesce("pair", "pos").alias("pos")))
    asked = asked.withColumn("_body_end", F.coalesce("_end", own_end)).withColumn("_after", F.lead(F.struct("tok", "pos", "pair", "pair_line", "_body_end")).over(_order("inst")))
    asked = asked.where(F.col("tok").isin(")", "=>")).select(
        F.col("path").alias("_p"), F.col("pos").alias("_a"), F.col("next_stop").alias("stop"), F.col("_after").alias("after")
    )
    found = found.join(asked, (F.col("path") == F.col("_p")) & (F.col("asks") == F.col("_a")))
    braced = F.when(F.col("kind") == "arrow", F.col("after.tok") == "{").otherwise(F.col("stop.tok") == "{")
    ok = (F.col("kind") == "arrow") & F.col("after").isNotNull() | (F.col("stop.tok") == "{") | (F.col("language") == "java") & (F.col("stop.tok") == ";")
    found = found.where(ok).select(
        "path", "language", "function", "pos", "start_line", "sig", "lone",
        F.when(F.col("kind") == "arrow", F.when(braced, F.col("after.pair")).otherwise(F.col("after._body_end.pos")))
        .otherwise(F.coalesce("stop.end", "stop.pos")).alias("end"),
        F.when(F.col("kind") == "arrow", F.when(braced, F.col("after.pair_line")).otherwise(F.col("after._body_end.line")))
        .otherwise(F.coalesce("stop.end_line", "stop.line")).alias("end_line"),
        F.when(braced, F.when(F.col("kind") == "arrow", F.col("after.pos")).otherwise(F.col("stop.pos"))).alias("body"),
    )
    return found, classes


def _bracketed_levels(tokens: DataFrame) -> DataFrame:
    """``path, pos, add, here``: what a token adds to the nesting from here on, and the nesting that it stands for by itself."""
    rows = _beside(tokens.where(F.col("language") != "python"), range(-3, 3), "pos")
    java = F.col("language") == "java"
    in_list = tokens.where((F.col("tok") == ";") & (F.col("inst_tok") == "(")).select(F.col("path").alias("_p"), F.col("inst").alias("_l")).distinct()
    rows = rows.join(in_list, (F.col("path") == F.col("_p")) & (_t(1, "pos") == F.col("_l")), "left")
    tok = F.col("tok")
    control = tok.isin(*CONTROLS) & ~F.coalesce(_t(-1).isin(".", "function"), F.lit(False)) & (~tok.isin(*CONTROL_HEADS) | _t(1).isin("(", "await"))
    behind_do = F.coalesce((_t(-1) == "}") & (_t(-2) == "{") & (_t(-3) == "do"), F.lit(False))
    own = F.when(tok == "if", 1).when((tok == "while") & ~behind_do, 1).when((tok == "for") & F.col("_l").isNotNull(), 1)
    own = own.when((tok == "try") & ~(java & (_t(1) == "(")), 1).otherwise(0)
    headed = F.coalesce((_t(-1) == ")") & _t(-3).isin("if", "for", "while"), F.lit(False)) | F.coalesce(_t(-1).isin("else", "do"), F.lit(False))
    goes_on = headed | tok.isin("else", "catch", "finally")
    rows = rows.withColumns({"_control": F.coalesce(control, F.lit(False)), "_own": own})
    rows = rows.withColumn("_chain", _sum((F.col("_control") & ~goes_on).cast("int"), _order("inst").rowsBetween(Window.unboundedPreceding, 0)))
    weight = F.when(F.col("_control"), F.sum(F.when(F.col("_control"), F.col("_own"))).over(_order("inst", "_chain").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_weight", weight)
    of_body = F.last("_weight", ignorenulls=True).over(_seen("inst"))
    body_of = F.when(_t(-1).isin("else", "try", "do", "finally"), _t(-1)).when((_t(-1) == ")") & _t(-3).isin(*CONTROL_HEADS), _t(-3))
    # A brace behind these is a value or the body of a switch, not a block.
    value = F.when(_t(-1).isNull(), F.coalesce(F.col("inst_tok") != "{", F.lit(False))).otherwise(_t(-1).isin("=", "]", ",", "{", "("))
    block = F.when(java & ~value & (F.coalesce(body_of, F.lit("")) != "switch"), 1).otherwise(0)
    add = F.when(tok == "{", F.when(body_of.isNotNull(), F.coalesce(of_body, F.lit(0))).otherwise(0) + block)
    rows = rows.withColumn("_add", add)
    rows = rows.withColumn("_shut", F.when(tok == "}", -F.lag("_add").over(_order("inst"))))
    rows = rows.withColumn("add", F.coalesce("_add", "_shut", F.lit(0)))
    return rows.select("path", "pos", "add", F.coalesce("_weight", F.lit(0)).alias("here"))


# ---------------------------------------------------------------- Python


def _statements(lines: DataFrame) -> DataFrame:
    """``path, pos, line, indent, kind, name, last_line``: each logical line of Python, its first word and where it ends."""
    order = Window.partitionBy("path").orderBy("line")
    code = F.col("code")
    rows = lines.where("language = 'python'").withColumn("_net", indented.net_brackets(code))
    rows = rows.withColumn("_deep", _sum(F.col("_net"), order.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    filled = code.rlike(r"\S")
    joined = F.coalesce(indented.joins_next(F.lag("code").over(order)), F.lit(False))
    rows = rows.withColumns({
        "_fresh": filled & (F.col("state") == CODE) & ~F.col("_deep") & ~joined,
        "_covered": filled | (F.col("state") != CODE) | F.col("_deep"),
    })
    rows = rows.withColumn("_number", F.sum(F.col("_fresh").cast("bigint")).over(order)).where("_covered AND _number > 0")
    first = indented.first_word(code)
    kind = F.when(indented.opens_block(first, code), first)
    head = F.struct("line", indented.indent_of(F.col("text")).alias("indent"), kind.alias("kind"), indented.defined_name(code).alias("name"))
    grouped = rows.groupBy("path", "_number").agg(F.min(F.when(F.col("_fresh"), head)).alias("h"), F.max("line").alias("last_line"))
    place = F.col("h.line").cast("bigint") * LINE
    return grouped.select("path", place.alias("pos"), "h.*", "last_line")


def _blocks(statements: DataFrame) -> DataFrame:
    """``path, pos, line, kind, name, end_line`` of each statement with a block."""
    order = Window.partitionBy("path").orderBy("pos")
    opens = F.col("kind").isNotNull()
    rows = statements.withColumn("_opens", opens)
    rows = rows.withColumns({"_end": F.lag("last_line").over(order), "_came": F.lag("indent").over(order), "_head": F.lag("_opens").over(order)})
    # Where statements are not indented further than before, blocks may end; each such place asks all indents that blocks have.
    ender = rows.where((F.col("indent") < F.col("_came")) | F.col("_head")).select("path", "pos", "indent", F.col("_end").alias("end"))
    bottom = rows.groupBy("path").agg((F.max("pos") + LINE).alias("pos"), F.lit(-1).alias("indent"), F.max("last_line").alias("end"))
    indents = rows.where("_opens").groupBy("path").agg(F.collect_set("indent").alias("_indents"))
    ends = ender.unionByName(bottom).join(indents, "path")
    ends = ends.select("path", "pos", "end", F.explode(F.filter("_indents", lambda i: i >= F.col("indent"))).alias("indent"))
    headed = rows.where("_opens").select("path", "pos", "line", "indent", "kind", "name", F.lit(1).alias("_role"))
    both = headed.unionByName(ends.withColumn("_role", F.lit(0)), allowMissingColumns=True)
    # From below: a header asks before its own line answers.
    upwards = Window.partitionBy("path", "indent").orderBy(F.desc("pos"), F.desc("_role")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("end_line", F.last("end", ignorenulls=True).over(upwards)).where("_role = 1")
    return both.select("path", "pos", "line", "indent", "kind", "name", "end_line")


def _python(tokens: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, classes and nesting of Python, in the form of the others."""
    end = ((F.col("end_line") + 1).cast("bigint") * LINE - 1).alias("end")
    classes = blocks.where("kind = 'class'").select("path", "pos", end, "name")
    rows = _beside(tokens.where(F.col("language") == "python"), range(-1, 4), "pos").where(_t(-1) == "def")
    sig = F.when(_t(1) == "(", _t(1, "pos")).when((_t(1) == "[") & (_t(3) == "("), _t(3, "pos"))
    signed = rows.select(F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("tok").alias("_n"), sig.alias("sig"))
    defs = blocks.where("kind = 'def'").join(
        signed, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")) & (F.col("name") == F.col("_n")), "left"
    )
    functions = defs.select(
        "path", F.lit("python").alias("language"), F.col("name").alias("function"), "pos", F.col("line").alias("start_line"), "sig",
        F.lit(None).cast("string").alias("lone"), end, "end_line", F.col("pos").alias("body"),
    )
    weight = indented.levels_of(F.col("kind"))
    both = blocks.select("path", F.explode(F.array(F.struct("pos", weight.alias("add")), F.struct(end.alias("pos"), (-weight).alias("add")))).alias("e"))
    levels = both.groupBy("path", "e.pos").agg(F.sum("e.add").alias("add")).withColumn("here", F.lit(0))
    return functions, classes, levels


def _callees(tokens: DataFrame) -> DataFrame:
    """``path, pos, callee``: the outermost calls of Python, by name or by owner and name.

    In a chain of names, dots and brackets the last call counts; neither its
    arguments nor what it is called on are looked into.
    """
    rows = _beside(tokens.where(F.col("language") == "python"), range(-3, 0), "line")
    tok, before = F.col("tok"), _t(-1)
    ends_value = F.coalesce(is_name(before, WORDS) | before.isin(")", "]", "}", '"', "'", '"""', "'''"), F.lit(False))
    own_line = (F.col("inst") < 0) & (F.col("line") > F.coalesce(_t(-1, "line"), F.lit(0)))
    goes_on = F.when(tok.isin(")", "]", "}"), True).when(tok == ".", ends_value).when(tok.isin("(", "["), ends_value).otherwise(F.coalesce(before == ".", F.lit(False)))
    goes_on = goes_on & ~(own_line & ~tok.isin(")", "]", "}"))
    # In "def f(" and "class C(" nothing is called.
    called = (tok == "(") & goes_on & ~F.coalesce(_t(-2).isin("def", "class"), F.lit(False))
    rows = rows.withColumns({"_chain": _sum((~goes_on).cast("int"), _order("inst").rowsBetween(Window.unboundedPreceding, 0)), "_called": called})
    last_call = F.max(F.when(F.col("_called"), F.col("pos"))).over(Window.partitionBy("path", "inst", "_chain"))
    rows = rows.withColumn("_last", last_call)
    opening = tok.isin("(", "[", "{")
    shut = F.when(opening & (F.col("pos") <= F.col("_last")), 1).when(tok.isin(")", "]", "}") & (F.col("pair") <= F.col("_last")), -1).otherwise(0)
    rows = rows.withColumn("_shut", shut)
    rows = rows.withColumn("_hidden", _sum(F.col("_shut"), _seen()))
    owner = is_name(_t(-3), WORDS)
    deeper = F.lag(F.col("tok"), 4).over(_order("inst")) == "."
    rows = rows.withColumn("_deeper", F.coalesce(deeper, F.lit(False)))
    attribute = F.coalesce(_t(-2) == ".", F.lit(False))
    callee = F.when(attribute, F.when(owner & ~F.col("_deeper"), F.concat(_t(-3), F.lit("."), before)).otherwise(before)).otherwise(before)
    plain = rows.where(F.col("_called") & (F.col("pos") == F.col("_last")) & (F.col("_hidden") == 0) & is_name(before, WORDS))
    return plain.select("path", "pos", callee.alias("callee"))


def _parameters(tokens: DataFrame) -> DataFrame:
    """``path, sig, parameters``: the names in each pair of round brackets, as parameters of the language."""
    rows = _beside(tokens.where("inst_tok = '('"), range(-2, 2))
    tok, java = F.col("tok"), F.col("language") == "java"
    angle = F.when(tok == "<", 1).when(tok == ">", -1).otherwise(0)
    whole = Window.partitionBy("path", "inst")
    rows = rows.withColumns({"_angle": _sum(angle, _seen("inst")), "_level": F.sum(angle).over(whole), "_step": angle})
    outside = (F.col("_angle") <= 0) | (F.col("_level") != 0)
    in_lambda = F.coalesce(F.last(F.when(tok == "lambda", True).when(tok == ":", False), ignorenulls=True).over(_seen("inst")), F.lit(False))
    name = is_name(tok, ["lambda"])
    leading = name & (_t(-1).isNull() | _t(-1).isin(",", "*", "**", "...")) & ~in_lambda
    # In Java the name is the last word, behind a type; one with dots is a rest parameter.
    ended = _t(1).isNull() | _t(1).isin(",", "[")
    dotted = F.coalesce(_t(-1) == "...", F.lit(False))
    last = name & ended & _t(-1).isNotNull() & ~_t(-1).isin(",", "@") & ~dotted
    names = rows.withColumn("_name", F.when(outside & F.when(java, last).otherwise(leading), F.struct("pos", "tok"))).where(F.col("_name").isNotNull())
    return names.groupBy("path", F.col("inst").alias("sig")).agg(F.transform(F.array_sort(F.collect_list("_name")), lambda n: n["tok"]).alias("parameters"))


# ---------------------------------------------------------------- all together


def _outermost(functions: DataFrame) -> DataFrame:
    """Functions that stand in no other; functions never overlap otherwise."""
    order = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = functions.withColumn("_reach", F.max("end").over(order))
    return rows.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("pos"))).drop("_reach")


def _with_class(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """The innermost class around each function, by one sweep over openings and closings."""
    opened = classes.select("path", "pos", F.lit(1).alias("_role"), F.lit(1).alias("_step"), F.col("name").alias("_class"))
    closed = classes.select("path", F.col("end").alias("pos"), F.lit(0).alias("_role"), F.lit(-1).alias("_step"))
    both = functions.withColumns({"_role": F.lit(2), "_step": F.lit(0)})
    both = both.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    sweep = Window.partitionBy("path").orderBy("pos", "_role").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_depth", F.sum("_step").over(sweep))
    innermost = Window.partitionBy("path", "_depth").orderBy("pos", "_role").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("class_name", F.when(F.col("_depth") > 0, F.last("_class", ignorenulls=True).over(innermost)))
    return both.where("_role = 2").drop("_role", "_step", "_class", "_depth")


def _nesting(functions: DataFrame, levels: DataFrame) -> DataFrame:
    """``path, pos, nesting_depth``: the highest running sum within each function, above that before its body."""
    own = functions.where(F.col("body").isNotNull()).select("path", F.col("body").alias("pos"), F.lit(0).alias("_role"), F.col("pos").alias("_of"), "end")
    both = levels.withColumn("_role", F.lit(1)).unionByName(own, allowMissingColumns=True)
    sweep = Window.partitionBy("path").orderBy("pos", "_role").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_sum", F.sum(F.coalesce("add", F.lit(0))).over(sweep))
    around = F.last(F.when(F.col("_role") == 0, F.struct("_of", "end", F.col("_sum").alias("base"))), ignorenulls=True).over(sweep)
    both = both.withColumn("_f", around).where((F.col("_role") == 1) & (F.col("pos") < F.col("_f.end")))
    deepest = both.groupBy("path", F.col("_f._of").alias("pos")).agg(F.max(F.col("_sum") + F.col("here") - F.col("_f.base")).alias("nesting_depth"))
    return deepest


def _calls(functions: DataFrame, callees: DataFrame) -> DataFrame:
    """``path, pos, calls``: the names called within each function, sorted, each once."""
    own = functions.select("path", "pos", F.lit(0).alias("_role"), "end")
    both = callees.withColumn("_role", F.lit(1)).unionByName(own, allowMissingColumns=True)
    sweep = Window.partitionBy("path").orderBy("pos", "_role").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_f", F.last(F.when(F.col("_role") == 0, F.struct("pos", "end")), ignorenulls=True).over(sweep))
    inside = both.where((F.col("_role") == 1) & (F.col("pos") < F.col("_f.end")))
    return inside.groupBy("path", F.col("_f.pos").alias("pos")).agg(F.sort_array(F.collect_set("callee")).alias("calls"))


def _read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines, written once, and the paths of files that are not of their language."""
    lines = durable(source_lines(files))
    return lines, _not_readable(files, lines)


def _not_readable(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``path``: brackets that do not match, strings or comments that do not end, or a sign U+0000."""
    last = lines.groupBy("path").agg(F.max_by(F.struct("text", "state", "language"), "line").alias("_l"))
    end = F.substring(lexis.then(F.col("_l.state"), lexis.effect(F.col("_l.text"), F.col("_l.language"), F.lit(True))), 1, 1)
    open_ = last.where(end != CODE).select("path")
    zero = files.where(F.col("language").isin(*OPENERS) & F.col("content").contains("\0")).select("path")
    return unmatched(lines).unionByName(open_).unionByName(zero).distinct()


def _copies(files: DataFrame) -> DataFrame:
    """``path, read_at``: files whose text, in the same language, is read at another path; paths that repeat are none."""
    texts = files.where("path IS NOT NULL").select("path", "language", F.sha2("content", 256).alias("_text"))
    single = texts.groupBy("path").agg(F.count("*").alias("_n"), F.min("language").alias("language"), F.min("_text").alias("_text"))
    single = durable(single.where("_n = 1 AND _text IS NOT NULL").drop("_n"))
    alike = single.groupBy("language", "_text").agg(F.min("path").alias("read_at"), F.count("*").alias("_n")).where("_n > 1")
    found = durable(single.join(alike, ["language", "_text"]).where("path <> read_at").select("path", "read_at"))
    discard(single)
    return found


def locate_functions(files: DataFrame, *, compat: bool = False) -> DataFrame:
    """``path`` and the columns of FOUND for each function of FILES in the languages known here.

    ``compat`` leaves out JavaScript methods and arrows with bracketed
    parameters, names other arrows by their parameter, and knows parameters of
    Java only.  A null path or content has no functions; of files that repeat a
    path each must be given apart.

    A Python text of up to IN_PLACE characters is read within its row.  The
    other texts become rows of lines and tokens, which any length allows.
    """
    known = files.where(F.col("language").isin(*OPENERS) & F.col("content").isNotNull() & F.col("path").isNotNull())
    in_place = (F.col("language") == "python") & (F.length("content") <= IN_PLACE)
    found = F.when(in_place, indented.functions_of(F.col("content")))
    placed = durable(known.select("path", in_place.alias("in_place"), found.alias("found")))
    repeated = files.groupBy("path").count().where("count > 1").select("path")
    each = placed.join(repeated, "path", "left_anti").select("path", F.explode("found").alias("f")).select("path", "f.*")
    each = each.select("path", *FOUND, (F.col("start_line").cast("bigint") * LINE).alias("pos"))
    if compat:
        each = each.withColumn("parameters", F.array().cast("array<string>"))
    if placed.where("NOT in_place").isEmpty():
        return each
    return each.unionByName(_locate_by_rows(known.where(~in_place), compat))


def _locate_by_rows(files: DataFrame, compat: bool) -> DataFrame:
    """As ``locate_functions``, by windows over lines and tokens."""
    lines, bad = _read(files)
    bad = durable(bad)
    lines_ = lines.join(bad, "path", "left_anti")
    tokens = tokens_ = durable(source_tokens(lines_))
    braced, bodies = _bracketed(tokens_, compat)
    statements = durable(_statements(lines_))
    blocks = durable(_blocks(statements))
    unbraced, classes, levels = _python(tokens_, blocks)
    functions = _outermost(braced.unionByName(unbraced))
    functions = durable(_with_class(functions, bodies.unionByName(classes)))
    levels = _bracketed_levels(tokens_).unionByName(levels)
    out = functions.join(_nesting(functions, levels), ["path", "pos"], "left")
    out = out.join(_calls(functions.where("language = 'python'"), _callees(tokens_)), ["path", "pos"], "left")
    out = out.join(_parameters(tokens_), ["path", "sig"], "left")
    none = F.array().cast("array<string>")
    names = F.when(F.col("lone").isNotNull(), F.array("lone")).otherwise(F.coalesce("parameters", none))
    if compat:
        names = F.when(F.col("language") == "java", names).otherwise(none)
    found = durable(out.select(
        "path", "class_name", "function", F.col("start_line").cast("int"), F.col("end_line").cast("int"), names.alias("parameters"),
        F.coalesce("nesting_depth", F.lit(0)).cast("int").alias("nesting_depth"), F.coalesce("calls", none).alias("calls"), "pos",
    ))
    discard(lines, tokens, bad, statements, blocks, functions)
    return found


def extract_functions(files: DataFrame, *, compat: bool = False, outliners: dict[str, Outliner] | None = None) -> DataFrame:
    """FUNCTIONS from FILES, whose paths differ.

    ``outliners`` adds languages: by name, a function from a text to rows of
    FOUND, which takes the place of the built-in rules.  Of files with equal
    text one is read for all.
    """
    outliners = outliners or {}
    known = files.where(~F.col("language").isin(*outliners)) if outliners else files
    copies = _copies(known.where(F.col("language").isin(*OPENERS)))
    found = locate_functions(known.join(copies, "path", "left_anti"), compat=compat)
    columns = F.struct(*FOUND)
    each = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", columns.alias("f")))), lambda x: x["f"]).alias("found"))
    of_copies = copies.join(each.withColumnRenamed("path", "read_at"), "read_at").select("path", "found")
    located = files.select("path", "content").join(each.unionByName(of_copies), "path")
    if outliners:

        @F.pandas_udf(_FOUND)
        def outlined(content: pd.Series, language: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(FOUND, row)) for row in outliners[lang](text)] for text, lang in zip(content, language)])

        other = files.where(F.col("language").isin(*outliners))
        located = located.unionByName(other.select("path", "content", outlined("content", "language").alias("found")))
    located = located.select(F.col("path").alias("file"), F.split("content", "\n", -1).alias("lines"), "found")
    cut = F.transform(
        "found",
        lambda f: F.struct(
            f.alias("f"),
            slice_lines(F.col("lines"), f["start_line"], f["end_line"] - f["start_line"] + 1).alias("code"),
            imports_before(F.col("lines"), f["start_line"]).alias("imports"),
        ),
    )
    each = located.select("file", F.posexplode(cut).alias("pos", "x"))
    return each.select(
        F.xxhash64("file", "x.f.start_line", "x.f.function", "pos").alias("func_id"),
        "file",
        F.col("x.f.class_name").alias("class_name"),
        F.col("x.f.function").alias("function"),
        F.col("x.f.start_line").alias("start_line"),
        F.col("x.f.end_line").alias("end_line"),
        F.col("x.f.parameters").alias("parameters"),
        (F.col("x.f.end_line") - F.col("x.f.start_line") + 1).alias("function_length"),
        F.col("x.f.nesting_depth").alias("nesting_depth"),
        has_docstring(F.col("x.code")).alias("has_docstring"),
        F.col("x.f.calls").alias("calls"),
        F.col("x.imports").alias("imports"),
        F.col("file").alias("parent_file"),
        F.col("x.code").alias("code"),
    )


def unread_files(files: DataFrame) -> DataFrame:
    """Files (``path, language``) that give no functions because they are not of their language."""
    lines, bad = _read(files)
    kept = durable(files.select("path", "language").join(bad, "path", "left_semi"))
    discard(lines)
    return kept
