"""Lines and tokens of source files, with the brackets that they stand in.

Strings and comments that run over lines are found by composing what each line
does to the lexical state; only lines that can change a state take part, in
blocks of bounded size, and blocks are composed like lines.  Brackets are
running sums: the matching bracket of one is the next on its level, and the
tokens between the two that stand in no deeper bracket are one sequence, in
which a declaration is a few neighbours however long its parts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import lexis
from siltstone.functions.lexis import CLOSING, OPENING, TOKEN
from siltstone.session import durable

BLOCK = 64  # effects composed at a time
TOP = -1  # what a token outside all brackets stands in
LINE = 1 << 32  # a place is its line times this, plus the number of the token


def _effects_before(events: DataFrame) -> DataFrame:
    """``path, at, before``: the effect of all earlier events (``at`` counts from 0) of the path together."""
    events = durable(events)
    blocks = events.withColumn("_block", F.floor(F.col("at") / BLOCK).cast("bigint"))
    order = Window.partitionBy("path", "_block").orderBy("at")
    so_far = F.collect_list("effect").over(order.rowsBetween(Window.unboundedPreceding, -1))
    inside = blocks.withColumn("_before", F.aggregate(so_far, F.lit(lexis.STATES), lexis.then))
    # Whole blocks are composed like events; behind the last one of a path stands an empty one, which asks for what was before it.
    whole = inside.where(F.col("at") % BLOCK == BLOCK - 1)
    whole = durable(whole.select("path", F.col("_block").alias("at"), lexis.then(F.col("_before"), F.col("effect")).alias("effect")))
    if whole.isEmpty():
        return inside.select("path", "at", F.col("_before").alias("before"))
    last = whole.groupBy("path").agg((F.max("at") + 1).alias("at")).withColumn("effect", F.lit(lexis.STATES))
    outside = _effects_before(whole.unionByName(last))
    outside = outside.select(F.col("path").alias("_p"), F.col("at").alias("_b"), F.col("before").alias("_outside"))
    joined = inside.join(outside, (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")), "left")
    before = lexis.then(F.coalesce("_outside", F.lit(lexis.STATES)), F.col("_before"))
    return joined.select("path", "at", before.alias("before"))


def source_lines(files: DataFrame) -> DataFrame:
    """``path, language, line, text, state, code`` of each line of FILES; lines count from 1.

    ``state`` is the lexical state before the line, ``code`` the line without
    comments and insides of strings.  Languages without rules have no lines.
    Files that can leave nothing open need no states, so they are not shuffled.
    """
    known = files.where(F.col("language").isin(*lexis.OPENERS) & F.col("content").isNotNull() & F.col("path").isNotNull())
    quiet = lexis.stays_in_code(F.col("content"), F.col("language"))
    code = F.lit(lexis.CODE)
    return _each_line(known.where(quiet)).select(
        "path", "language", "line", "text", code.alias("state"), lexis.code_of(F.col("text"), code, F.col("language")).alias("code")
    ).unionByName(_with_states(_each_line(known.where(~quiet))))


def _each_line(files: DataFrame) -> DataFrame:
    each = files.select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("_at", "text"))
    return each.select("path", "language", (F.col("_at") + 1).alias("line"), lexis.plain(F.col("text")).alias("text"))


def _with_states(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("line")
    lines = lines.withColumn("_behind", F.coalesce(F.lag(F.col("text").endswith("\\")).over(order), F.lit(False)))
    may_move = F.col("_behind") | lexis.moves(F.col("text"))
    effect = F.when(may_move, lexis.effect(F.col("text"), F.col("language"), F.col("_behind"))).otherwise(lexis.UNMOVED)
    lines = lines.withColumn("_effect", effect)
    lines = lines.withColumn("_moves", F.col("_behind") | (F.col("_effect") != lexis.UNMOVED))
    lines = lines.withColumn("_at", F.sum(F.col("_moves").cast("bigint")).over(order) - 1)
    events = lines.where("_moves").select("path", F.col("_at").alias("at"), F.col("_effect").alias("effect"))
    before = _effects_before(events).select(F.col("path").alias("_p"), F.col("at").alias("_e"), F.col("before").alias("_before"))
    # A line takes what the last event up to it found; behind that event its own effect counts too.
    lines = lines.join(before, (F.col("path") == F.col("_p")) & (F.col("_at") == F.col("_e")), "left")
    behind = lexis.then(F.col("_before"), F.max(F.when(F.col("_moves"), F.col("_effect"))).over(Window.partitionBy("path", "_at")))
    state = F.when(F.col("_moves"), F.col("_before")).otherwise(F.coalesce(behind, F.lit(lexis.STATES)))
    lines = lines.withColumn("state", F.substring(state, 1, 1))
    return lines.select("path", "language", "line", "text", "state", lexis.code_of(F.col("text"), F.col("state"), F.col("language")).alias("code"))


def _step(tok: Column) -> Column:
    return F.when(tok.isin(*OPENING), 1).when(tok.isin(*CLOSING), -1).otherwise(0)


def source_tokens(lines: DataFrame) -> DataFrame:
    """``path, language, pos, line, tok, inst, inst_tok, level, pair, pair_tok`` of each token.

    ``inst`` is the place of the bracket that the token stands in (of a bracket:
    that both it and its partner stand in), ``pair`` the place of a bracket's
    partner.
    """
    each = lines.select("path", "language", "line", F.posexplode(F.regexp_extract_all("code", F.lit(TOKEN), F.lit(0))).alias("_i", "tok"))
    tokens = each.withColumn("pos", F.col("line").cast("bigint") * LINE + F.col("_i")).drop("_i")
    order = Window.partitionBy("path").orderBy("pos")
    step = _step(F.col("tok"))
    depth = F.sum(step).over(order)
    tokens = tokens.withColumn("_step", step).withColumn("_depth", depth)
    tokens = tokens.withColumn("level", F.col("_depth") + F.when(F.col("_step") == -1, 1).otherwise(0))
    tokens = tokens.withColumn("outer", F.col("level") - F.when(F.col("_step") != 0, 1).otherwise(0))
    bracket = F.col("_step") != 0
    pairs = Window.partitionBy("path", "level", bracket).orderBy("pos")
    for name, column in (("pair", "pos"), ("pair_tok", "tok"), ("pair_line", "line")):
        beside = F.when(F.col("_step") == 1, F.lead(column).over(pairs)).when(F.col("_step") == -1, F.lag(column).over(pairs))
        tokens = tokens.withColumn(name, beside)
    # An opening bracket stands in the sequence outside it and begins the one inside.
    marker = F.struct(F.lit(0).alias("role"), F.col("level").alias("outer"))
    sibling = F.struct(F.lit(1).alias("role"), F.col("outer").alias("outer"))
    both = tokens.withColumn("_r", F.explode(F.when(F.col("_step") == 1, F.array(sibling, marker)).otherwise(F.array(sibling))))
    inside = Window.partitionBy("path", "_r.outer").orderBy("pos", "_r.role").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("_r.role") == 0, F.struct("pos", "tok"))
    both = both.withColumn("_in", F.last(opened, ignorenulls=True).over(inside)).where("_r.role = 1")
    return both.select(
        "path", "language", "pos", "line", "tok", "level", "pair", "pair_tok", "pair_line",
        F.coalesce("_in.pos", F.lit(TOP)).alias("inst"), F.col("_in.tok").alias("inst_tok"),
    )


def unmatched(lines: DataFrame) -> DataFrame:
    """``path`` of the files whose brackets do not match, from the brackets of their lines alone.

    Where a path repeats, lines do too, and their brackets match nothing.
    """
    found = lines.select("path", "line", F.regexp_replace("code", r"[^()\[\]{}]+", "").alias("_b")).where("_b <> ''")
    listed = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "_b"))).alias("_l"))
    brackets = F.array_join(F.transform("_l", lambda x: x["_b"]), "")
    repeated = F.size(F.array_distinct(F.transform("_l", lambda x: x["line"]))) < F.size("_l")
    return listed.where(repeated | lexis.unmatched(brackets)).select("path")
