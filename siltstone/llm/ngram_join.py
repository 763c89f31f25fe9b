"""Jaccard join of documents on word n-grams, by prefixes of token combinations.

Tokens are the distinct hashed shingles of a text.  In any fixed order of all
tokens, two sets that are similar enough share a token among the first few of
each (the prefix), and s tokens if both prefixes are s - 1 longer.  So rare
tokens of a prefix are indexed singly; frequent ones are dealt into m classes,
the prefix is extended by m, and pairs of tokens of one class are indexed: if
m + 1 shared tokens are all frequent, two of them are in one class.  m grows
with the size of a set, so that the pairs of a set grow no faster than its
tokens; partners of either side of a step in size meet on the step above.

The order puts first the tokens whose hash lies in a fixed share of the hash
space, by the number of documents that hold them, then all others by hash.
Only that share needs to be counted; a text with too few of them adds its first
others, singly.  Tokens that one document alone holds count in the prefix but
are never indexed.

Texts with equal sets are one class from the start.  Within an index entry not
all pairs are compared: in each round some members are pivots, every member of
another component is verified against them, and pivots leave the entry, which
is closed as soon as one component holds all that is left of it.  The number of
pivots grows by rounds, so no pair of different components remains unverified
and no link between different components is lost.  Tokens that no other indexed
set holds bound the overlap of a set with any other: pairs, and sets whose entry
has no partner within the bound, need no verification, and sets with few such
tokens, the middle of their group, are pivots first.  Tokens also set bits, and
bits of one set alone bound the overlap of a pair.

Similar sets share many entries, and a pair needs to meet in one.  Each set
brings its few smallest signatures, which similar sets mostly share, and a pair
is passed over in an entry if both sides bring a smaller one: it is met there,
or below that again, because an entry that holds both stays open until one of
them has been its pivot or one component holds both.

Defined cases: null texts and texts without words have an empty set and are
alone; texts of fewer words than a shingle have the whole sequence as their one
token; of rows that repeat a ``doc_id`` with different texts the one with the
largest set stands for the document, and all get its component; a row without
``doc_id`` is alone, with a null component; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm import words
from siltstone.llm.components import components
from siltstone.session import discard, durable

SHINGLE = 4
SIMILAR = (85, 100)  # least similarity as a fraction
COUNTED = 0.3125  # share of the hash space whose tokens are counted and come first
FREQUENT = 12  # documents from which on a token is frequent
TOKENS_PER_CLASS = 32  # of a set, for each class of frequent tokens
PIVOT_GROWTH = 16  # pivots of an index entry: 1, 16, 256, ... by rounds
SMALLEST = 8  # signatures of a set by which pairs that meet in several entries are met in one
WORDS = 8  # of 64 bits, into which the tokens of a set are thrown
_LIMIT = np.int64(int(-(2**63) + COUNTED * 2**64))


def prefix_length(n, similar=SIMILAR):
    return n - (similar[0] * n + similar[1] - 1) // similar[1] + 1


def classes(n):
    """Classes of frequent tokens for a set of n, a step function of doublings."""
    return np.maximum(1, (1 << np.log2(np.maximum(n, 1)).astype(np.int64)) // TOKENS_PER_CLASS)


def _sets(part: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text in ascending order, their texts, and where each text's begin."""
    data, at = words.raw(part)
    code, text, _ = words.shingles(words.words(data, at), size, short=True)
    code, text = words.distinct(code, text)
    return code, text, np.searchsorted(text, np.arange(len(part) + 1))


def _digests(code: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed tokens per set, the same for equal sets only."""
    out = []
    for salt in (0x51ED270B, 0xB5297A4D):
        mixed = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(words.mix(code.view(np.uint64) ^ np.uint64(salt)), out=mixed[1:])
        ends = np.searchsorted(text, np.arange(n + 1))
        out.append((mixed[ends[1:]] - mixed[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def marks(code: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The bits of each of n sets: a token sets one, so a bit of one set alone is a token of it alone."""
    out = np.zeros((n, WORDS), np.int64)
    np.bitwise_or.at(out.reshape(-1), text * WORDS + (code >> 6) % WORDS, np.int64(1) << (code & 63))
    return out


def _arrow(docs: DataFrame, columns: str, work) -> DataFrame:
    """``work(ids, texts)`` over slices of ``docs(doc_id, text)`` that gives record batches of ``columns``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, part in words.slices(batch.column(1)):
                yield from work(batch.column(0).slice(first, len(part)), part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def counted_sets(docs: DataFrame, size: int = SHINGLE, similar=SIMILAR) -> DataFrame:
    """``doc_id, n, counted, h1, h2, tag, tokens, extra``: the size of each set, its counted tokens, its digest.

    ``extra`` are the first other tokens of a set with too few counted ones, null for all others.
    """

    def work(ids, part):
        code, text, at = _sets(part, size)
        h1, h2 = _digests(code, text, len(part))
        own = code < _LIMIT
        n, counted = np.diff(at), np.bincount(text, own, minlength=len(part)).astype(np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counted)).astype(np.int32)), pa.array(code[own]))
        wanted = np.minimum(n, prefix_length(n, similar) + classes(-(-n * similar[1] // similar[0]))) - counted
        # Tokens ascend within a text, so the others follow the counted ones.
        others = [code[i : i + w] if w > 0 else None for i, w in zip(at[:-1] + counted, wanted, strict=True)]
        columns = [ids, *(pa.array(c) for c in (n, counted, h1, h2, h1.astype(np.int16))), tokens, pa.array(others, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "counted", "h1", "h2", "tag", "tokens", "extra"])

    columns = "n bigint, counted bigint, h1 bigint, h2 bigint, tag smallint, tokens array<bigint>, extra array<bigint>"
    return _arrow(docs, columns, work)


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, tag, tokens, marks``: whole sets, and the bits of each."""

    def work(ids, part):
        code, text, at = _sets(part, size)
        tag = _digests(code, text, len(part))[0].astype(np.int16)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(code))
        bits = marks(code, text, len(part))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, WORDS, dtype=np.int32)), pa.array(bits.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(tag), lists, bits], ["doc_id", "tag", "tokens", "marks"])

    return _arrow(docs, "tag smallint, tokens array<bigint>, marks array<bigint>", work)


def _pairs_within(token: np.ndarray, m: int) -> np.ndarray:
    """Signatures of all pairs of tokens of one class."""
    group = words.mix(token.view(np.uint64)) % np.uint64(m)
    order = np.lexsort((token, group))
    token, group = token[order].view(np.uint64), group[order]
    out = []
    for step in range(1, len(token)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        first, second = token[:-step][same], token[step:][same]
        out.append(words.mix(words.mix(first + np.uint64(m)) + second))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signatures_of(n: int, counted: int, held: np.ndarray, token: np.ndarray, extra: np.ndarray, similar=SIMILAR) -> np.ndarray:
    """What a set is indexed by: ``held`` documents hold each shared counted ``token``."""
    order = np.lexsort((token, held))
    held, token = held[order], token[order]
    alone = counted - len(token)  # tokens that come first and match nothing
    base = int(prefix_length(n, similar)) - alone
    if base <= 0:
        return np.zeros(0, np.uint64)
    frequent = held >= FREQUENT
    if not frequent[:base].any():
        singles = np.concatenate([token[:base], extra[: max(0, base - len(token))]])
        return words.mix(singles.view(np.uint64))
    out = []
    for m in {int(classes(n)), int(classes(-(-n * similar[1] // similar[0])))}:
        longer = base + m
        inside, often = token[:longer], frequent[:longer]
        singles = np.concatenate([inside[~often], extra[: max(0, longer - len(token))]])
        out += [words.mix(singles.view(np.uint64)), _pairs_within(inside[often], m)]
    return np.unique(np.concatenate(out))


def signatures(sets: DataFrame, similar=SIMILAR) -> DataFrame:
    """``sig, node, n`` from ``node, n, counted, shared array<struct<held, token>>, extra``."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            node, n, counted = batch.column("node"), batch.column("n").to_pylist(), batch.column("counted").to_pylist()
            shared, extra = batch.column("shared"), batch.column("extra")
            codes, of = [], []
            for i in range(len(batch)):
                own = shared[i].values
                held, token = ((own.field(k).to_numpy() for k in (0, 1)) if own is not None else (np.zeros(0, np.int64),) * 2)
                more = extra[i].values
                more = more.to_numpy() if more is not None else np.zeros(0, np.int64)
                found = signatures_of(n[i], counted[i], held, token, more, similar)
                codes.append(found)
                of.append(np.full(len(found), i))
            of = pa.array(np.concatenate(of)) if of else pa.array([], pa.int64())
            code = pa.array(np.concatenate(codes).view(np.int64)) if codes else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([code, node.take(of), batch.column("n").take(of)], ["sig", "node", "n"])

    return sets.mapInArrow(run, f"sig bigint, node {kind}, n bigint")


def _linked(pairs: DataFrame, sets: DataFrame, similar) -> DataFrame:
    """``a, b, linked`` of candidate pairs, by their whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("_i"), (F.size("ta") + F.size("tb")).alias("_s"))
    return joined.select("a", "b", (similar[1] * F.col("_i") >= similar[0] * (F.col("_s") - F.col("_i"))).alias("linked"))


def own_tokens(sets: DataFrame) -> DataFrame:
    """``node, alone``: how many of its tokens no other of the ``sets(node, tokens)`` holds, where there are any."""
    each = sets.select("node", F.explode("tokens").alias("token"))
    once = each.groupBy("token").agg(F.count("*").alias("_n"), F.min("node").alias("node")).where("_n = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def _common_bits(a: str, b: str):
    """How many bits two sets both have, whose marks are the columns ``a0, a1, ...`` and ``b0, b1, ...``."""
    return functools.reduce(operator.add, (F.bit_count(F.col(f"{a}{w}").bitwiseAND(F.col(f"{b}{w}"))) for w in range(WORDS)))


def _within(overlap, total, similar):
    """Whether sets of ``total`` tokens together can be similar with at most this overlap."""
    return (similar[0] + similar[1]) * overlap >= similar[0] * total


def link_classes(live: DataFrame, sets: DataFrame, similar=SIMILAR) -> DataFrame:
    """``node, root`` of the nodes with links, from index entries ``live(sig, node, n, common, few, rest, m0, m1, ...)``.

    ``common`` is the number of tokens that some other of the ``sets`` holds,
    ``few`` the smallest signatures of all entries of the node, ``m0`` and so on the
    bits of its set and ``rest`` its tokens beyond one for each bit.
    """
    carried = ["n", "common", "few", "rest", *(f"m{w}" for w in range(WORDS))]
    kind = live.schema["node"].dataType
    roots = live.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    failed, number, before = None, 1, None
    while True:
        rows = live.join(roots, "node", "left").select(
            "sig", "node", *carried, F.coalesce("root", "node").alias("root")
        )
        ends = rows.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min("n").alias("_least"))
        rows = rows.join(ends.where("_lo <> _hi").select("sig", "_least"), "sig")
        # The best partner is as small as the entry has, but not smaller than the overlap.
        rows = rows.where(_within(F.col("common"), F.col("n") + F.greatest("_least", "common"), similar)).drop("_least")
        rows = durable(rows)
        if before is not None:
            discard(before)
        before = rows
        if rows.isEmpty():
            discard(rows)
            return roots
        middle = F.floor(256 * (F.col("n") - F.col("common")) / F.col("n"))
        order = Window.partitionBy("sig").orderBy(middle, F.xxhash64("node"), "node")
        pivots = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= number)
        pivots = pivots.select(
            "sig", F.col("node").alias("_pivot"), F.col("n").alias("_pn"), F.col("common").alias("_pc"), F.col("root").alias("_proot"),
            F.col("few").alias("_pfew"), F.col("rest").alias("_prest"), *(F.col(f"m{w}").alias(f"_p{w}") for w in range(WORDS)),
        )
        near = _within(F.least("common", "_pc"), F.col("n") + F.col("_pn"), similar) & (F.col("root") != F.col("_proot"))
        # Bits of one set alone are tokens of it alone.
        near &= _within(F.least("rest", "_prest") + _common_bits("m", "_p"), F.col("n") + F.col("_pn"), similar)
        near &= ~F.coalesce(F.array_min(F.array_intersect("few", "_pfew")) < F.col("sig"), F.lit(False))
        pairs = rows.join(pivots, "sig").where(near).select(F.least("node", "_pivot").alias("a"), F.greatest("node", "_pivot").alias("b"))
        pairs = pairs.distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        verified = durable(_linked(pairs, sets, similar))
        missed = verified.where("NOT linked").select("a", "b")
        failed = missed if failed is None else failed.unionByName(missed)
        links = verified.where("linked").select("a", "b")
        if not links.isEmpty():
            own = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            for end in ("a", "b"):
                links = links.join(own, F.col(end) == F.col("_node"), "left")
                links = links.withColumn(end, F.coalesce("_root", end)).drop("_node", "_root")
            merged = components(links)
            kept = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left")
            kept = kept.select("node", F.coalesce("_new", "root").alias("root"))
            fresh = merged.select("node", "root").join(roots.select("node"), "node", "left_anti")
            later = durable(kept.unionByName(fresh))
            discard(roots, merged)
            roots = later
        live = rows.select("sig", "node", *carried).join(
            pivots.select("sig", F.col("_pivot").alias("node")), ["sig", "node"], "left_anti"
        )
        number *= PIVOT_GROWTH


def similar_components(docs: DataFrame, size: int = SHINGLE, similar=SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``."""
    sizes = durable(counted_sets(docs, size, similar))
    filled = sizes.where("n > 0 AND doc_id IS NOT NULL")
    # The row that stands for a document, then one document for each set.
    best = F.max(F.struct("n", "h1", "h2", "tag", "counted")).alias("best")
    chosen = filled.groupBy("doc_id").agg(best).select("doc_id", "best.*")
    sets = durable(
        chosen.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("tag").alias("tag"), F.first("counted").alias("counted"))
    )
    # A set of so few tokens that one more or less is too many links with its copies only.
    least = next(k for k in range(1, 10_000) if similar[1] * k >= similar[0] * (k + 1))
    open_sets = sets.where(F.col("n") >= least)

    tokens = sizes.select("doc_id", "tag", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    shared = tokens.join(held, "token").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("held", "token")).alias("shared"))
    extra = sizes.where("extra IS NOT NULL").select("doc_id", "tag", "extra")
    given = open_sets.join(
        shared.withColumnRenamed("doc_id", "node"), ["node", "tag"], "left"
    ).join(extra.withColumnRenamed("doc_id", "node").dropDuplicates(["node", "tag"]), ["node", "tag"], "left")
    none = F.array().cast("array<bigint>")
    given = given.where("shared IS NOT NULL OR extra IS NOT NULL").select(
        "node", "n", "counted",
        F.coalesce("shared", F.array().cast("array<struct<held:bigint,token:bigint>>")).alias("shared"),
        F.coalesce("extra", none).alias("extra"),
    )
    index = durable(signatures(given, similar))
    many = index.groupBy("sig").agg(F.count("*").alias("_n")).where("_n > 1").select("sig")
    live = durable(index.join(many, "sig", "left_semi"))
    discard(index)
    wanted = live.select("node").distinct().join(open_sets, "node").select(F.col("node").alias("doc_id"), "tag", "n")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = token_sets(texts, size).join(wanted, ["doc_id", "tag"]).where(F.size("tokens") == F.col("n"))
    whole = durable(whole.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "tokens", "marks"))
    common = F.col("n") - F.coalesce("alone", F.lit(0))
    few = live.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, SMALLEST).alias("few"))  # a set's entries at most
    entries = live.join(own_tokens(whole), "node", "left").join(few, "node")
    bits = whole.select(
        "node", *(F.col("marks")[w].alias(f"m{w}") for w in range(WORDS)),
        functools.reduce(operator.add, (F.bit_count(F.col("marks")[w]) for w in range(WORDS))).alias("_bits"),
    )
    entries = entries.join(bits, "node").withColumns({"common": common, "rest": F.col("n") - F.col("_bits")}).drop("alone", "_bits")
    roots = link_classes(entries, whole, similar)
    discard(live, whole)

    members = chosen.join(sets.select("n", "h1", "h2", "node"), ["n", "h1", "h2"]).select("doc_id", "node")
    named = members.join(roots, "node", "left").select(F.col("doc_id").alias("_id"), F.coalesce("root", "node").alias("component_id"))
    out = sizes.join(named, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
