"""The functions of one Python text as a column: lines, statements and tokens stay arrays of their row.

The rules are those of ``operators.extract``, which holds lines and tokens as
rows instead, for texts of any length.  A fold keeps what is open: the blocks
around a statement, or the brackets around a token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import lexis
from siltstone.functions.lexis import CLOSING, CODE, OPENING, TOKEN, is_name

# Words that the language reserves.
WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield"
).split()
# Levels that statements add, themselves and their block or the block alone.
LEVELS = dict.fromkeys(("if", "elif", "else", "for", "while", "try", "except", "finally", "match"), 2) | dict.fromkeys(
    ("with", "class", "def"), 1
)
_PLAIN_SIGNATURE = r"\A\x{FEFF}?\s*(?:async\s+)?def\s+\w+\s*\(([^()\[\]{}]*)\)"
_STRINGS = "array<string>"
# Tokens as far as calls depend on them: words and quotes that a dot or bracket follows, "def", "class", dots, brackets and
# line feeds before one of these; a run of other tokens is one that ends a chain.
_WORD = r"[\p{L}\p{N}_$#]"
_DEFINES = rf"(?:def|class)(?!{_WORD})"
_FOLLOWED = r"\s*+[.(\[]"
_OTHER = rf"(?!{_DEFINES}){_WORD}++(?!{_FOLLOWED})|\.\.\.(?!{_FOLLOWED})|[\x22\x27](?!{_FOLLOWED})|(?!{_WORD})[^\s.()\[\]{{}}\x22\x27]"
_CHAIN_TOKEN = rf"(?:\s*+(?={_OTHER}))?+((?:{_OTHER})(?:\s*+(?:{_OTHER}))*+|\n\s*+|{_WORD}++|\.\.\.|\S)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there: a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda so_far, _: so_far, body)


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


# ---------------------------------------------------------------- lines


def net_brackets(code: Column) -> Column:
    return F.regexp_count(code, F.lit(r"[(\[{]")) - F.regexp_count(code, F.lit(r"[)\]}]"))


def joins_next(code: Column) -> Column:
    return code.rlike(r"\\\s*\z")


def indent_of(text: Column) -> Column:
    """Signs before the first other one; a tab counts as eight, a byte order mark as none."""
    marked = F.length(F.replace(F.regexp_extract(text, r"\A\x{FEFF}?([ \t\f]*)", 1), F.lit("\t"), F.lit(" " * 8)))
    return F.when(text.contains("\t") | text.startswith("\ufeff"), marked).otherwise(F.length(text) - F.length(F.ltrim(text, F.lit(" \f"))))


def first_word(code: Column) -> Column:
    """The first word of a statement, behind ``async``, or its first sign; empty where there is none."""
    return F.regexp_extract(code, r"\A\x{FEFF}?\s*(?:async\s+(?=def|for|with))?(\w+|\S)", 1)


def opens_block(first: Column, code: Column) -> Column:
    """Whether a statement with this first word has a block; ``match`` may also be a name."""
    return first.isin(*LEVELS) & ((first != "match") | code.rlike(r":\s*\z"))


def defined_name(code: Column) -> Column:
    return F.regexp_extract(code, r"\A\x{FEFF}?\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)


def levels_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), kind)


def _states(texts: Column) -> Column:
    """``state`` behind all lines and ``before``, one sign for each line."""
    start = F.struct(F.lit(CODE).alias("state"), F.lit(False).alias("joined"), F.lit("").alias("before"))

    def step(so_far: Column, text: Column) -> Column:
        return F.struct(
            lexis.after(text, so_far["state"], so_far["joined"], "python").alias("state"),
            text.endswith("\\").alias("joined"),
            F.concat(so_far["before"], so_far["state"]).alias("before"),
        )

    return F.aggregate(texts, start, step)


def _codes(content: Column, texts: Column, states: Column) -> Column:
    """The lines without comments and insides of strings; where nothing runs on over lines, at one go."""
    one_by_one = F.transform(texts, lambda text, at: lexis.code_in(text, F.substring(states["before"], at + 1, F.lit(1)), "python"))
    return F.when(states["quiet"], F.split(lexis.quiet_python(content), "\n", -1)).otherwise(one_by_one)


def _line(text: Column, at: Column, code: Column, in_code: Column) -> Column:
    def facts(first: Column) -> Column:
        starts = (first != "") & in_code
        return _let(
            F.when(starts & opens_block(first, code), first),
            lambda kind: F.struct(
                (at + 1).alias("line"),
                F.when(code.rlike(r"[()\[\]{}]"), net_brackets(code)).otherwise(0).alias("net"),
                starts.alias("starts"),
                ((first != "") | ~in_code).alias("covered"),
                F.when(code.contains("\\"), joins_next(code)).otherwise(False).alias("joins"),
                F.when(starts, indent_of(text)).alias("indent"),
                F.when(kind.isNotNull(), levels_of(kind)).alias("add"),
                kind.alias("kind"),
                F.when(kind.isin("def", "class"), defined_name(code)).alias("name"),
            ),
        )

    return _let(first_word(code), facts)


# ---------------------------------------------------------------- statements and blocks

_FOUND = "array<struct<line:int,end_line:int,name:string,class_name:string,depth:int>>"


def _outermost(lines: Column) -> Column:
    """The functions that stand in no other, with the innermost class around each and how deep its blocks go."""
    nothing = F.lit(None).cast("string")
    start = F.struct(
        F.lit(0).alias("deep"),
        F.lit(False).alias("joined"),
        F.lit(0).alias("last"),
        F.struct(
            _none("array<struct<indent:int,class_name:string,level:int>>").alias("around"),
            F.lit(-1).alias("top"),
            F.struct(F.lit(0).alias("line"), F.lit(0).alias("indent"), nothing.alias("name"), nothing.alias("class_name"), F.lit(0).alias("base")).alias("own"),
            F.lit(0).alias("deepest"),
            _none(_FOUND).alias("found"),
        ).alias("blocks"),
    )

    def closed(blocks: Column, last: Column) -> Column:
        own = blocks["own"]
        done = F.struct(own["line"], last.alias("end_line"), own["name"], own["class_name"], (blocks["deepest"] - own["base"]).alias("depth"))
        return F.concat(blocks["found"], F.array(done))

    def entered(blocks: Column, line: Column, last: Column) -> Column:
        own = blocks["own"]
        ends = (own["line"] > 0) & (line["indent"] <= own["indent"])
        left = F.when(blocks["top"] >= line["indent"], F.filter(blocks["around"], lambda b: b["indent"] < line["indent"])).otherwise(blocks["around"])

        def opened(left: Column) -> Column:
            parent = F.try_element_at(left, F.lit(-1))
            base = F.coalesce(parent["level"], F.lit(0))
            level = base + F.coalesce(line["add"], F.lit(0))
            opens = line["add"].isNotNull()
            free = (own["line"] == 0) | ends
            starts = free & F.coalesce(line["kind"] == "def", F.lit(False))
            block = F.struct(line["indent"], F.when(line["kind"] == "class", line["name"]).otherwise(parent["class_name"]).alias("class_name"), level.alias("level"))
            new = F.struct(line["line"], line["indent"], line["name"], parent["class_name"].alias("class_name"), base.alias("base"))
            none = F.struct(F.lit(0).alias("line"), F.lit(0).alias("indent"), nothing.alias("name"), nothing.alias("class_name"), F.lit(0).alias("base"))
            return F.struct(
                F.when(opens, F.concat(left, F.array(block))).otherwise(left).alias("around"),
                F.when(opens, line["indent"]).otherwise(F.coalesce(parent["indent"], F.lit(-1))).alias("top"),
                F.when(starts, new).when(ends, none).otherwise(own).alias("own"),
                F.when(starts, level).when(opens, F.greatest(blocks["deepest"], level)).otherwise(blocks["deepest"]).alias("deepest"),
                F.when(ends, closed(blocks, last)).otherwise(blocks["found"]).alias("found"),
            )

        return _let(left, opened)

    def step(so_far: Column, line: Column) -> Column:
        inside = so_far["deep"] > 0
        fresh = line["starts"] & ~inside & ~so_far["joined"]
        covered = line["covered"] | inside
        blocks = so_far["blocks"]
        same = ~fresh | (line["add"].isNull() & (blocks["top"] < line["indent"]))
        return F.struct(
            (so_far["deep"] + line["net"]).alias("deep"),
            line["joins"].alias("joined"),
            F.when(fresh | covered & (so_far["last"] > 0), line["line"]).otherwise(so_far["last"]).alias("last"),
            F.when(same, blocks).otherwise(entered(blocks, line, so_far["last"])).alias("blocks"),
        )

    def finish(end: Column) -> Column:
        return F.when(end["blocks"]["own"]["line"] > 0, closed(end["blocks"], end["last"])).otherwise(end["blocks"]["found"])

    return F.aggregate(lines, start, step, finish)


# ---------------------------------------------------------------- tokens


def _step(tok: Column) -> Column:
    return F.when(tok.isin(*OPENING), 1).when(tok.isin(*CLOSING), -1).otherwise(0)


def _in_signature(tokens: Column) -> Column:
    """Of the tokens behind a name, those that stand directly in its round brackets; square ones may come before."""
    start = F.struct(F.lit("first").alias("part"), F.lit(0).alias("deep"), _none().alias("found"))

    def step(so_far: Column, tok: Column) -> Column:
        part, deep = so_far["part"], so_far["deep"] + _step(tok)
        goes = F.when(part == "first", F.when(tok == "(", "in").when(tok == "[", "types").otherwise("done"))
        goes = goes.when(part == "types", F.when(deep == 0, "typed").otherwise("types")).when(part == "typed", F.when(tok == "(", "in").otherwise("done"))
        goes = goes.when(deep == 0, "done").otherwise("in")
        direct = (part == "in") & (deep > 0) & ((deep == 1) | (so_far["deep"] == 1))
        found = F.when(direct, F.concat(so_far["found"], F.array(tok))).otherwise(so_far["found"])
        return F.when(part == "done", so_far).otherwise(F.struct(goes.alias("part"), deep.alias("deep"), found.alias("found")))

    return F.aggregate(tokens, start, step, lambda end: end["found"])


def _names(tokens: Column) -> Column:
    """The parameters among the tokens of a signature."""
    angle = lambda tok: F.when(tok == "<", 1).when(tok == ">", -1).otherwise(0)
    whole = F.size(F.filter(tokens, lambda t: t == "<")) - F.size(F.filter(tokens, lambda t: t == ">"))
    start = F.struct(F.lit(",").alias("before"), F.lit(False).alias("in_lambda"), F.lit(0).alias("angle"), _none().alias("found"))

    def of(level: Column) -> Column:
        def step(so_far: Column, tok: Column) -> Column:
            leading = so_far["before"].isin(",", "*", "**", "...") & ~so_far["in_lambda"] & ((so_far["angle"] <= 0) | (level != 0)) & is_name(tok, ["lambda"])
            return F.struct(
                tok.alias("before"),
                F.when(tok == "lambda", True).when(tok == ":", False).otherwise(so_far["in_lambda"]).alias("in_lambda"),
                (so_far["angle"] + angle(tok)).alias("angle"),
                F.when(leading, F.concat(so_far["found"], F.array(tok))).otherwise(so_far["found"]).alias("found"),
            )

        return F.aggregate(tokens, start, step, lambda end: end["found"])

    return _let(whole, of)


def _parameters(code: Column, name: Column) -> Column:
    """The names in the signature at the beginning of a function's code."""
    plain = F.regexp_extract_all(F.regexp_extract(code, _PLAIN_SIGNATURE, 1), F.lit(TOKEN), F.lit(0))

    def nested(tokens: Column) -> Column:
        at = F.array_position(tokens, "def").cast("int")
        return F.when(F.get(tokens, at) == name, _in_signature(F.slice(tokens, at + 2, F.size(tokens)))).otherwise(_none())

    tokens = F.when(code.rlike(_PLAIN_SIGNATURE), plain).otherwise(_let(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), nested))
    return _let(tokens, _names)


def _calls(code: Column) -> Column:
    """The outermost calls, by name or by owner and name, sorted, each once.

    In a chain of names, dots and brackets the last call counts; neither its
    arguments nor what it is called on are looked into.  Of the bracket that a
    token stands in, the fold keeps the four tokens before, the names of the
    chain that it is in and those of earlier chains.
    """
    no_token = F.lit(None).cast("string")

    def seen(tok: Column, before: Column, names: Column, earlier: Column) -> Column:
        return F.struct(tok.alias("t1"), before["t1"].alias("t2"), before["t2"].alias("t3"), before["t3"].alias("t4"), names.alias("names"), earlier.alias("earlier"))

    empty = F.struct(*(no_token.alias(f"t{k}") for k in range(1, 5)), _none().alias("names"), _none().alias("earlier"))
    outside = F.array(empty)
    start = F.struct(F.lit(0).alias("hidden"), F.lit(True).alias("new_line"), empty.alias("here"), F.filter(outside, lambda x: F.lit(False)).alias("around"))

    def both(here: Column) -> Column:
        return F.when(F.size(here["names"]) == 0, here["earlier"]).otherwise(F.concat(here["earlier"], here["names"]))

    def state(hidden, new_line, here, around) -> Column:
        return F.struct(hidden.alias("hidden"), new_line.alias("new_line"), here.alias("here"), around.alias("around"))

    def step(so_far: Column, tok: Column) -> Column:
        here, around, hidden = so_far["here"], so_far["around"], so_far["hidden"]
        no, visible = F.lit(False), F.lit(0)
        before = here["t1"]
        ends_value = F.coalesce(before.isin(")", "]", "}", '"', "'"), no) | is_name(before, WORDS)
        own_line = so_far["new_line"] & (F.size(around) == 0)
        goes_on = F.when(tok.isin(".", "(", "["), ends_value).otherwise(F.coalesce(before == ".", no)) & ~own_line
        owned = F.coalesce(here["t2"] == ".", no) & is_name(here["t3"], WORDS) & ~F.coalesce(here["t4"] == ".", no)
        names = F.when(is_name(before, WORDS), F.array(F.when(owned, F.concat(here["t3"], F.lit("."), before)).otherwise(before))).otherwise(_none())
        outer = F.try_element_at(around, F.lit(-1))
        shut = seen(tok, outer, F.concat(outer["names"], both(here)), outer["earlier"])
        deep = hidden + _step(tok)
        in_hidden = F.when(deep == 0, state(visible, no, seen(tok, here, here["names"], here["earlier"]), around)).otherwise(state(deep, so_far["new_line"], here, around))

        def in_sequence(goes_on: Column) -> Column:
            # What is called stands before the bracket; inside it nothing counts.
            called = (tok == "(") & goes_on & ~F.coalesce(here["t2"].isin("def", "class"), no)
            moved = F.when(goes_on, seen(tok, here, here["names"], here["earlier"])).otherwise(seen(tok, here, _none(), both(here)))
            return (
                F.when(called, state(F.lit(1), no, seen(tok, here, names, here["earlier"]), around))
                .when(tok.isin(*OPENING), state(visible, no, empty, F.concat(around, F.array(moved))))
                .otherwise(state(visible, no, moved, around))
            )

        return (
            F.when(hidden > 0, in_hidden)
            .when(tok.startswith("\n"), state(visible, so_far["new_line"] | (F.size(around) == 0), here, around))
            .when(tok.isin(*CLOSING), state(visible, no, shut, F.slice(around, F.lit(1), F.size(around) - 1)))
            .otherwise(_let(goes_on, in_sequence))
        )

    tokens = F.regexp_extract_all(code, F.lit(_CHAIN_TOKEN), F.lit(1))
    return F.sort_array(F.array_distinct(F.aggregate(tokens, start, step, lambda end: both(end["here"]))))


# ---------------------------------------------------------------- all together


def _functions(content: Column, texts: Column, states: Column) -> Column:
    def each(found: Column, codes: Column) -> Column:
        return _let(
            F.array_join(F.slice(codes, found["line"], found["end_line"] - found["line"] + 1), "\n"),
            lambda code: F.struct(
                found["class_name"].alias("class_name"),
                found["name"].alias("function"),
                found["line"].alias("start_line"),
                found["end_line"].alias("end_line"),
                _parameters(code, found["name"]).alias("parameters"),
                found["depth"].alias("nesting_depth"),
                _calls(code).alias("calls"),
            ),
        )

    def of_codes(codes: Column) -> Column:
        in_code = lambda at: states["quiet"] | (F.substring(states["before"], at + 1, F.lit(1)) == CODE)
        lines = F.transform(texts, lambda text, at: _let(F.get(codes, at), lambda code: _line(text, at, code, in_code(at))))
        brackets = F.regexp_replace(F.array_join(codes, ""), r"[^()\[\]{}]+", "")
        return F.when(~lexis.unmatched(brackets), _let(_outermost(lines), lambda found: F.transform(found, lambda f: each(f, codes))))

    return _let(_codes(content, texts, states), of_codes)


def functions_of(content: Column) -> Column:
    """The outermost functions of a Python text, null where its brackets, strings or comments do not close or it holds U+0000."""

    def of_texts(content: Column, texts: Column) -> Column:
        end = lexis.after(F.try_element_at(texts, F.lit(-1)), F.lit(CODE), F.lit(False), "python")
        quiet = F.struct(end.alias("state"), F.lit("").alias("before"), F.lit(True).alias("quiet"))
        moving = _let(_states(texts), lambda s: F.struct(s["state"], s["before"], F.lit(False).alias("quiet")))
        states = F.when(lexis.stays_in_code(content, F.lit("python")), quiet).otherwise(moving)
        return _let(states, lambda s: F.when(s["state"] == CODE, _functions(content, texts, s)))

    plain = F.when(content.contains("\x01") | content.contains("\x02"), lexis.plain(content)).otherwise(content)
    read = _let(plain, lambda whole: _let(F.split(whole, "\n", -1), lambda texts: of_texts(whole, texts)))
    return F.when(~content.contains("\0"), read)
