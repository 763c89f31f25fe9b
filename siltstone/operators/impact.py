"""What is reachable from many nodes at once.

Each seed owns one bit, and a node carries one row of up to eight 64-bit words
per 512 seeds instead of one row per seed that reaches it.  A round moves the
new bits along all edges and merges them with ``bit_or``, which combines on the
map side: a node with very many incoming edges is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import CodeGraph
from siltstone.operators.ordering import with_position
from siltstone.session import durable

_WORD_BITS = 64
_MOST_WORDS = 8


def _seed_bits(graph: CodeGraph, seeds: DataFrame) -> tuple[DataFrame, int]:
    """(id, block, word, bit) of the seeds that are nodes, and words per block."""
    known = seeds.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    numbered = durable(with_position(known, "id", name="n"))
    words = max(1, min(_MOST_WORDS, -(-numbered.count() // _WORD_BITS)))
    bits = numbered.select(
        "id",
        F.floor(F.col("n") / (_WORD_BITS * words)).alias("block"),
        (F.floor(F.col("n") / _WORD_BITS) % words).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("n") % _WORD_BITS).cast("int")).alias("bit"),
    )
    return bits, words


def _reach(graph: CodeGraph, bits: DataFrame, words: int) -> DataFrame:
    """(block, id, seen0, seen1, ...): the seeds that reach the node, or are it.

    New bits of callers meet per name before they move on to the functions of
    that name, so callers times functions never appears.
    """
    plain = graph.static_edges.select("src", "dst").unionByName(graph.local_calls)
    seen, fresh = [f"seen{i}" for i in range(words)], [f"fresh{i}" for i in range(words)]
    none = F.lit(0).cast("bigint")

    def merged(columns: list[str]) -> list[Column]:
        return [F.bit_or(c).alias(c) for c in columns]

    def any_set(columns: list[str]) -> Column:
        total = F.col(columns[0])
        for c in columns[1:]:
            total = total.bitwiseOR(F.col(c))
        return total != 0

    own = [F.when(F.col("word") == i, F.col("bit")).otherwise(none) for i in range(words)]
    state = bits.select("block", "id", *[w.alias(c) for c, w in zip(seen, own)], *[w.alias(c) for c, w in zip(fresh, own)])
    while True:
        moving = state.where(any_set(fresh)).select("block", F.col("id").alias("src"), *fresh)
        along = moving.join(plain, "src").select("block", "dst", *fresh)
        named = moving.join(graph.references, "src").groupBy("block", "name").agg(*merged(fresh))
        by_name = named.join(graph.definitions, "name").select("block", "dst", *fresh)
        arriving = along.unionByName(by_name).withColumnRenamed("dst", "id").select(
            "block", "id", *[none.alias(c) for c in seen], *fresh
        )
        kept = state.select("block", "id", *seen, *[none.alias(c) for c in fresh])
        both = kept.unionByName(arriving).groupBy("block", "id").agg(*merged(seen), *merged(fresh))
        state = durable(
            both.select(
                "block",
                "id",
                *[F.col(s).bitwiseOR(F.col(f)).alias(s) for s, f in zip(seen, fresh)],
                *[F.col(f).bitwiseAND(F.bitwise_not(s)).alias(f) for s, f in zip(seen, fresh)],
            )
        )
        if state.where(any_set(fresh)).isEmpty():
            return state.select("block", "id", *seen)


def _spread_bits(rows: DataFrame, words: int) -> DataFrame:
    """One row per set bit, as (word, bit), of the columns seen0, seen1, ..."""
    one = F.lit(1).cast("bigint")

    def set_bits(i: int) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(_WORD_BITS - 1)), lambda n: F.call_function("shiftleft", one, n))
        present = F.filter(bits, lambda bit: F.col(f"seen{i}").bitwiseAND(bit) != 0)
        return F.transform(present, lambda bit: F.struct(F.lit(i).alias("word"), bit.alias("bit")))

    others = [c for c in rows.columns if not c.startswith("seen")]
    return rows.select(*others, F.inline(F.concat(*[set_bits(i) for i in range(words)])))


def reachable(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """(seed, id) for all nodes reachable from each seed, without the seed itself."""
    graph = graph.written()
    bits, words = _seed_bits(graph, seeds)
    each = _spread_bits(_reach(graph, bits, words), words)
    owner = bits.withColumnRenamed("id", "seed")
    return each.join(owner, ["block", "word", "bit"]).where("seed <> id").select("seed", "id")


def transitive_impact(graph: CodeGraph, seeds: DataFrame, issues: DataFrame) -> DataFrame:
    """Direct and transitive dependents of each seed and the issues on them.

    Seeds that are no node of the graph give no row.  ``reachable`` lists the
    dependents themselves.
    """
    graph = graph.written()
    bits, words = _seed_bits(graph, seeds)
    state = _reach(graph, bits, words)
    counts = durable(issues.groupBy(F.col("file").alias("id")).agg(F.count("*").alias("issues")))
    # Nodes that the same seeds reach are added up before the bits are spread.
    alike = (
        state.join(counts, "id", "left")
        .groupBy("block", *[f"seen{i}" for i in range(words)])
        .agg(F.count("*").alias("nodes"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))
    )
    per_bit = (
        _spread_bits(alike, words)
        .groupBy("block", "word", "bit")
        .agg(F.sum("nodes").alias("nodes"), F.sum("issues").alias("issues"))
    )
    direct = graph.successors(bits.select("id")).groupBy("id").agg(F.count("*").alias("direct"))
    own = counts.withColumnRenamed("issues", "own_issues")
    return (
        bits.join(per_bit, ["block", "word", "bit"])
        .join(direct, "id", "left")
        .join(own, "id", "left")
        .select(
            "id",
            F.coalesce("direct", F.lit(0)).cast("bigint").alias("direct_dependents"),
            (F.col("nodes") - 1).alias("transitive_dependents"),
            (F.col("issues") - F.coalesce("own_issues", F.lit(0))).cast("bigint").alias("total_issues_in_dependents"),
        )
    )
