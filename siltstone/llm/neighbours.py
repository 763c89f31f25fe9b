"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node.  A further component makes all nodes equally long,
so that the largest inner product is the smallest distance.  It is kept apart
from the others, as what it falls short of the longest vector, so that a very
long vector costs the others no precision.  First lists come
from windows of rows in the order of random hyperplane codes.  Each round of
NN-descent joins every node with its neighbours and a sample of those that have
it as a neighbour: these meet each other, and pairs that improve a list are
merged.  Nodes are dealt into blocks of neighbouring codes; a block receives
each vector that its nodes refer to once, as bytes, in one row from each block
that holds some of them: at most ``LIST + REVERSE`` vectors for each of its
nodes, however many nodes there are.  Queries, which are rows of
the table, then search the graph greedily from their own list and from the
longest vectors: the best unexpanded nodes of the pool are expanded, their neighbours scored, and the best
kept.  The pool is scored at last in double precision on the original vectors.

Bounded by parameters: lists (``LIST``), sampled reverse neighbours
(``REVERSE``), nodes of a block (``BLOCK``), blocks that one group sends vectors to
(``ANSWERED``), the pool of a query (``POOL``).  Rounds
go on until lists have settled, and each search until all of its pool is
expanded.  A node that very many
nodes refer to is sampled before the shuffle; copies of a vector beyond the
number of results can't be in any result after the first ones.

Defined cases: rows with a null id, or a vector that is null, empty, zero, of
another than the most common length, or holds null or non-finite components,
take no part; of rows that repeat a ``vec_id`` the one with the smallest vector
stands; ties go to the smaller ``vec_id``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ordering import with_position
from siltstone.session import discard, durable

LIST = 50
REVERSE = 50
TABLES = 4
BITS = 24
WINDOW = 512
BLOCK = 1024
ANSWERED = 64
ENOUGH = 0.01  # share of list entries; rounds go on until one changes fewer
FAR = 200  # rounds beyond which something is wrong; an error, never a result
EMIT = 16  # improvements of a node that one block passes on
POOL = 64
EXPANDED = 8
ENTRIES = 32  # longest vectors that every search begins from, too
SEED = 11
GRAPH = "pos bigint, ids array<bigint>, sims array<float>"
ROUND = GRAPH + ", fresh bigint"  # entries that the round has brought
POOLS = GRAPH + ", done array<bigint>"  # entries that are expanded
# What one block passes on to another, packed: for each entry its node, the neighbour, the likeness.
MESSAGE = "to_block int, pos array<bigint>, ids array<bigint>, sims array<float>"
# Vectors of block ``at`` that block ``for_block`` wants; ``part`` deals the blocks that ask.
REQUEST = "at int, part int, for_block int, wanted array<bigint>"


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def top(of: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of each ``of``, best first."""
    order = np.lexsort((ids, -sims, of))
    of, ids, sims = of[order], ids[order], sims[order]
    order = np.lexsort((-sims, ids, of))
    o, i = of[order], ids[order]
    again = np.zeros(len(of), bool)
    again[order[1:]] = (o[1:] == o[:-1]) & (i[1:] == i[:-1])
    of, ids, sims = of[~again], ids[~again], sims[~again]
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)]))
    best = rank < k
    return of[best], ids[best], sims[best]


def _graph_batch(of: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """Rows of GRAPH from entries in the order of ``of``."""
    pos, counts = np.unique(of, return_counts=True)
    columns = [pa.array(pos), _lists(ids, counts, pa.int64()), _lists(sims.astype(np.float32), counts, pa.float32())]
    return pa.RecordBatch.from_arrays(columns, ["pos", "ids", "sims"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null([]) if column.null_count else column
    counts = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), counts)


def clean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"))
    vector = "embedding"
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = sound & F.exists(vector, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows
    return rows.where(F.size(vector) == common.d).groupBy("vec_id").agg(F.min(vector).alias(vector))


class Nodes:
    """Distinct vectors: ``table(pos, node, embedding, bytes, scale, short, half, length, keys)`` and their ``members(vec_id, node)``."""

    def __init__(self, vectors: DataFrame):
        digest = [F.xxhash64("embedding"), F.xxhash64(F.lit("second"), F.col("embedding"))]
        marked = durable(vectors.select("vec_id", "embedding", digest[0].alias("_a"), digest[1].alias("_b")))
        firsts = marked.groupBy("_a", "_b").agg(F.min("vec_id").alias("node"))
        self.members = durable(marked.select("vec_id", "_a", "_b").join(firsts, ["_a", "_b"]).select("vec_id", "node"))
        one = marked.join(firsts.select(F.col("node").alias("vec_id")), "vec_id", "left_semi")
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        longest, self.count = one.agg(F.max(length), F.count("*")).first()
        coded = one.select(F.col("vec_id").alias("node"), "embedding").mapInArrow(
            _coder(float(longest or 0.0)), CODED
        )
        coded = durable(coded.withColumn("_key", F.col("keys")[0]))
        self.table = durable(with_position(coded, "_key", "node", name="pos").drop("_key"))
        discard(coded, marked)


CODED = (
    "node bigint, embedding array<float>, bytes binary, scale float, short double, half double, length double, keys array<bigint>"
)
SENT = ("bytes", "scale", "short", "half")  # what a block needs of a vector


def _coder(longest: float):
    def run(batches):
        for batch in batches:
            values, _ = _flat(batch.column(1))
            if not len(batch):
                continue
            x = values.astype(np.float64).reshape(len(batch), -1)
            length = np.sqrt((x * x).sum(1))
            # The further component is longest - short; half is longest * short, about half the squared length.
            rest = np.sqrt(np.maximum(longest**2 - length**2, 0.0))
            short = length**2 / (longest + rest)
            planes = np.random.default_rng(SEED).normal(size=(TABLES, x.shape[1], BITS))
            weight = 1 << np.arange(BITS)[::-1]
            keys = np.column_stack([(x @ p > 0) @ weight for p in planes])
            scale = np.abs(x).max(1) / 127
            data = np.rint(x / scale[:, None]).astype(np.int8)
            columns = [
                *batch.columns,
                pa.array([row.tobytes() for row in data], pa.binary()),
                pa.array(scale.astype(np.float32)),
                pa.array(short),
                pa.array(longest * short),
                pa.array(length),
                _lists(keys.ravel(), np.full(len(x), TABLES), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "embedding", *SENT, "length", "keys"])

    return run


def _vectors(bytes_: pa.Array, scale: pa.Array) -> np.ndarray:
    joined = b"".join(bytes_.to_pylist())
    return np.frombuffer(joined, np.int8).reshape(len(bytes_), -1) * scale.to_numpy()[:, None].astype(np.float32)


def _likeness(x: np.ndarray, short: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Inner products of all pairs with the further component, less the square of the longest vector (a constant).

    (longest - a)(longest - b) - longest^2 = a b - longest a - longest b holds no large number for short vectors.
    """
    own = short[..., :, None] * short[..., None, :] - half[..., :, None] - half[..., None, :]
    return (x @ np.swapaxes(x, -1, -2) + own).astype(np.float32)


def first_lists(nodes: Nodes) -> DataFrame:
    """Lists from windows of rows in the order of each table's codes."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), WINDOW):
                part = batch.slice(first, WINDOW)
                x, pos = _vectors(part.column(1), part.column(2)), part.column(0).to_numpy()
                short, half = part.column(3).to_numpy(), part.column(4).to_numpy()
                if len(x) < 2:
                    continue
                sims = _likeness(x, short, half)
                np.fill_diagonal(sims, -np.inf)
                k = min(LIST, len(x) - 1)
                best = np.argpartition(-sims, k - 1, 1)[:, :k]
                of = np.repeat(pos, k)
                yield _graph_batch(*top(of, pos[best].ravel(), np.take_along_axis(sims, best, 1).ravel(), k))

    tables = None
    for t in range(TABLES):
        key = nodes.table.select("pos", *SENT, F.col("keys")[t].alias("_key"))
        ordered = key.repartitionByRange("_key", "pos").sortWithinPartitions("_key", "pos").drop("_key")
        own = ordered.mapInArrow(run, GRAPH)
        tables = own if tables is None else tables.unionByName(own)
    return _merged(tables)


def _merged(lists: DataFrame) -> DataFrame:
    """The best ``LIST`` of all lists of a node."""

    def run(batches):
        for batch in batches:
            pos = batch.column(0).to_numpy()
            ids, row = _flat(batch.column(1))
            sims, _ = _flat(batch.column(2))
            of, ids, sims = top(pos[row], ids, sims, LIST)
            yield _graph_batch(of, ids, sims)

    grouped = lists.groupBy("pos").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("sims")).alias("sims"))
    return durable(grouped.mapInArrow(run, GRAPH))


def _block(pos: str = "pos"):
    return F.floor(F.col(pos) / BLOCK).cast("int")


def _requests(parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """What one block wants of each block."""
        wanted = np.unique(_flat(rows.column("near"))[0])
        at, counts = np.unique(wanted // BLOCK, return_counts=True)  # ascending, so blocks are runs
        asker = np.full(len(at), key[0].as_py(), np.int32)
        columns = [pa.array(at.astype(np.int32)), pa.array(asker % parts, pa.int32()), pa.array(asker), _lists(wanted, counts, pa.int64())]
        return pa.Table.from_arrays(columns, ["at", "part", "for_block", "wanted"])

    return run


def _answers(names: list[str]):
    def run(known: pa.Table, requests: pa.Table) -> pa.Table:
        """The rows of one block that others want, packed for each of them."""
        pos = known.column("pos").to_numpy()
        order = np.argsort(pos)
        wanted, row = _flat(requests.column("wanted"))
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(requests)))].astype(np.int32))
        sent = known.take(pa.array(order[np.searchsorted(pos[order], wanted)])).combine_chunks()
        columns = [pa.ListArray.from_arrays(offsets, _whole(sent.column(name))) for name in names]
        return pa.Table.from_arrays([_whole(requests.column("for_block")), *columns], ["to_block", *names])

    return run


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks or [pa.array([], whole.type)])


def delivered(asked: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """Rows of ``known`` for each block that refers to them in ``asked(block, near)``, each once.

    ``to_block`` and every column of ``known(pos, ...)`` as an array, a row for
    each pair of blocks.  A group sends to at most ``ANSWERED`` blocks, so that nodes
    that all blocks want are no large group; ``count`` is the number of nodes.
    """
    parts = max(-(-count // (BLOCK * ANSWERED)), 1)
    requests = asked.groupBy("block").applyInArrow(_requests(parts), REQUEST)
    dealt = known.withColumn("_at", _block()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    packed = T.StructType([T.StructField("to_block", T.IntegerType())])
    for field in known.schema.fields:
        packed.add(field.name, T.ArrayType(field.dataType))
    return dealt.groupBy("_at", "_part").cogroup(requests.groupBy("at", "part")).applyInArrow(_answers(known.columns), packed)


def _received(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending positions that a block has received, their vectors, and the place of each in the answers."""
    known = _flat(answers.column("pos"))[0]
    order = np.argsort(known)
    x = _vectors(_whole(answers.column("bytes")).flatten(), _whole(answers.column("scale")).flatten())
    return known[order], x[order], order


def _meetings(edges: pa.Table, vectors: pa.Table) -> pa.Table:
    """Improvements found in one block: all neighbours of a node meet each other."""
    known, x, order = _received(vectors)
    short, half = (_flat(vectors.column(c))[0][order] for c in ("short", "half"))
    bound = _flat(vectors.column("least"))[0][order].astype(np.float32)
    ids, row = _flat(edges.column("near"))
    counts = np.bincount(row, minlength=len(edges))
    width = int(counts.max(initial=0))
    grid = np.full((len(edges), width), -1)
    grid[np.arange(width) < counts[:, None]] = np.searchsorted(known, ids)
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float32))
    parts, waiting = [held], 0
    for first in range(0, len(grid), 128):
        b = grid[first : first + 128]
        here = b >= 0
        sims = _likeness(x[b], short[b], half[b])
        better = (sims > bound[b][:, :, None]) & here[:, :, None] & here[:, None, :] & (b[:, :, None] != b[:, None, :])
        i, j, k = np.nonzero(better)
        parts.append((b[i, j], b[i, k], sims[i, j, k]))
        waiting += len(i)
        if waiting > 1 << 20 or first + 128 >= len(grid):
            held = top(*(np.concatenate(c) for c in zip(*parts, strict=True)), EMIT)
            parts, waiting = [held], 0
    of, ids, sims = held
    of, ids = known[of], known[ids]  # ascending, so blocks are runs
    to, counts = np.unique(of // BLOCK, return_counts=True)
    columns = [pa.array(to.astype(np.int32)), *(_lists(c, counts, kind) for c, kind in ((of, pa.int64()), (ids, pa.int64())))]
    columns.append(_lists(sims.astype(np.float32), counts, pa.float32()))
    return pa.Table.from_arrays(columns, ["to_block", "pos", "ids", "sims"])


def _improved(lists: pa.Table, messages: pa.Table) -> pa.Table:
    """The lists of one block after all messages to it."""
    pos = lists.column("pos").to_numpy()
    ids, row = _flat(lists.column("ids"))
    sims, _ = _flat(lists.column("sims"))
    of, more, likeness = (_flat(messages.column(c))[0] for c in ("pos", "ids", "sims"))
    merged = top(np.concatenate([pos[row], of]), np.concatenate([ids, more]), np.concatenate([sims, likeness]), LIST)
    base = pos[:1] // BLOCK * BLOCK
    new = ~np.isin((merged[0] - base << 52) + merged[1], (pos[row] - base << 52) + ids)  # a block has 2^10 nodes
    fresh = np.bincount(np.unique(merged[0], return_inverse=True)[1], new).astype(np.int64)
    return pa.Table.from_batches([_graph_batch(*merged)]).append_column("fresh", pa.array(fresh))


def improve(nodes: Nodes, graph: DataFrame, number: int) -> tuple[DataFrame, float]:
    """One round of NN-descent: the new graph and the share of changed entries."""
    edges = graph.select(F.col("pos").alias("u"), F.explode("ids").alias("v"))
    order = Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(number)), "u")
    back = edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= REVERSE)
    back = back.groupBy(F.col("v").alias("pos")).agg(F.collect_list("u").alias("back"))
    near = F.array_distinct(F.concat("ids", F.coalesce("back", F.array().cast("array<bigint>"))))
    # Merged, so that no table of lists or vectors goes through the driver.
    joined = durable(graph.join(back.hint("merge"), "pos", "left").select(_block().alias("block"), near.alias("near")))
    least = F.when(F.size("sims") < LIST, F.lit(float("-inf"))).otherwise(F.array_min("sims")).alias("least")
    known = nodes.table.select("pos", *SENT).join(graph.select("pos", least).hint("merge"), "pos")
    sent = delivered(joined, known, nodes.count)
    found = joined.groupBy("block").cogroup(sent.groupBy("to_block")).applyInArrow(_meetings, MESSAGE)
    placed = graph.select(_block().alias("block"), "pos", "ids", "sims")
    later = durable(placed.groupBy("block").cogroup(found.groupBy("to_block")).applyInArrow(_improved, ROUND))
    entries, fresh = later.agg(F.sum(F.size("ids")), F.sum("fresh")).first()
    discard(joined)
    return later, (fresh or 0) / max(entries or 0, 1)


def neighbour_graph(nodes: Nodes) -> DataFrame:
    """GRAPH of all nodes."""
    graph = first_lists(nodes)
    for number in range(FAR):
        later, share = improve(nodes, graph, number)
        discard(graph)
        graph = later
        if share < ENOUGH:
            return graph
    raise RuntimeError(f"neighbour lists have not settled in {FAR} rounds")


def _expand(wanted: pa.Table, vectors: pa.Table) -> pa.Table:
    """Pools of one block of queries after their candidates are scored."""
    pos = wanted.column("pos").to_numpy()
    known, x, _ = _received(vectors)
    own = x[np.searchsorted(known, pos)]  # the further component is for rows, not for queries
    ids, row = _flat(wanted.column("fresh"))
    sims = np.einsum("ij,ij->i", own[row], x[np.searchsorted(known, ids)]) if len(ids) else np.zeros(0, np.float32)
    old, old_row = _flat(wanted.column("ids"))
    old_sims, _ = _flat(wanted.column("sims"))
    of, ids, sims = top(
        np.concatenate([pos[old_row], pos[row]]), np.concatenate([old, ids]), np.concatenate([old_sims, sims]).astype(np.float32), POOL
    )
    order = np.argsort(pos)
    done = _whole(wanted.column("done")).take(pa.array(order[np.searchsorted(pos[order], np.unique(of))]))
    return pa.Table.from_batches([_graph_batch(of, ids, sims)]).append_column("done", done)


def _scored(nodes: Nodes, wanted: DataFrame) -> DataFrame:
    """Pools after the ``fresh`` candidates of ``wanted(pos, ids, sims, done, fresh)`` are scored, block by block."""
    wanted = durable(wanted.select(_block().alias("block"), "pos", "ids", "sims", "done", "fresh"))
    asked = wanted.select("block", F.array_append("fresh", F.col("pos")).alias("near"))
    sent = delivered(asked, nodes.table.select("pos", "bytes", "scale"), nodes.count)
    moved = durable(wanted.groupBy("block").cogroup(sent.groupBy("to_block")).applyInArrow(_expand, POOLS))
    discard(wanted)
    return moved


def search(nodes: Nodes, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """GRAPH of pools of the nodes in ``queries(pos)``, by greedy search of the graph.

    The search begins from the list of the query itself and from a few of the
    longest vectors, where the largest inner products are if lengths differ.
    """
    none, own = F.array().cast("array<bigint>"), F.array("pos")
    longest = nodes.table.orderBy(F.desc("length"), "pos").limit(ENTRIES)
    entries = F.array(*(F.lit(r.pos).cast("bigint") for r in longest.select("pos").collect()))
    start = queries.select("pos").join(graph.select("pos", "ids").hint("merge"), "pos", "left")
    first = F.array_except(F.array_union(F.coalesce("ids", none), entries), own)
    empty = none.alias("ids"), F.array().cast("array<float>").alias("sims"), none.alias("done")
    pools = _scored(nodes, start.select("pos", *empty, first.alias("fresh")))
    finished = None
    for _ in range(FAR):
        chosen = F.slice(F.array_except("ids", "done"), 1, EXPANDED).alias("chosen")
        state = pools.select("pos", "ids", "sims", "done", chosen)
        settled = state.where(F.size("chosen") == 0).select("pos", "ids", "sims")
        finished = settled if finished is None else finished.unionByName(settled)
        state = state.where(F.size("chosen") > 0)
        if state.isEmpty():
            return finished
        reached = state.select("pos", F.explode("chosen").alias("_at")).join(
            graph.select(F.col("pos").alias("_at"), F.col("ids").alias("_next")), "_at"
        )
        reached = reached.groupBy("pos").agg(F.array_distinct(F.flatten(F.collect_list("_next"))).alias("_next"))
        fresh = F.array_except(F.array_except(F.coalesce("_next", none), "ids"), own).alias("fresh")
        done = F.concat("done", "chosen").alias("done")
        pools = _scored(nodes, state.join(reached, "pos", "left").select("pos", "ids", "sims", done, fresh))
    raise RuntimeError(f"searches have not ended in {FAR} rounds")


def nearest_rows(rows: DataFrame, is_query, results: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the best rows for each row that meets the condition ``is_query`` on ``vec_id``."""
    vectors = clean_vectors(rows, key, vector)
    nodes = Nodes(vectors)
    graph = neighbour_graph(nodes)
    asked = durable(nodes.members.where(is_query).select(F.col("vec_id").alias("query_id"), "node"))
    queries = asked.select("node").distinct().join(nodes.table.select("node", "pos"), "node")
    pools = search(nodes, graph, queries.select("pos"))
    # Each query's own node is a candidate too, for its copies.
    pairs = pools.select("pos", F.explode("ids").alias("to")).unionByName(queries.select("pos", F.col("pos").alias("to")))
    own = nodes.table.select("pos", F.col("node").alias("query"), F.col("embedding").alias("_q"))
    other = nodes.table.select(F.col("pos").alias("to"), F.col("node"), F.col("embedding").alias("_v"))
    product = F.aggregate(
        F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = pairs.distinct().join(own, "pos").join(other, "to").select("query", "node", product.alias("score"))
    few = Window.partitionBy("node").orderBy("vec_id")
    copies = nodes.members.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= results + 1).drop("_n")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = scored.join(copies, "node").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= results + 1)
    listed = durable(listed.select("query", "vec_id", "score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(listed, F.col("node") == F.col("query")).where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= results)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
