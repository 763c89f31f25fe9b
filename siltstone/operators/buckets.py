"""Top-k search over a written index of vectors in buckets.

The index keeps each vector under a short code: on which side of some
orthogonal planes through the mean it lies.  A bucket of more than a bounded
number of rows is dealt into slices.  A query goes to buckets, not to rows, in
the order of the least distance that any row of the bucket can have: the squares
of its distances to the planes that part it from the bucket add up to it.

Exact search looks into the nearest buckets first and then into every bucket
whose bound is not above the k-th distance found.  Approximate search stops
when the buckets hold a share of all rows, and says so in a column.  Either way
hits are ranked by their true distances.  Rows and the queries that ask for
them meet sorted by bucket and slice: a task holds one slice of rows and lets
the queries pass by, so no group is too large and no row is copied.

Defined cases are those of ``vectors.nearest``: vectors that are null or hold
a component that is null, not finite or beyond its limit take no part, nor do
those of another length than the index; equal distances rank by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.vectors import _comparable
from siltstone.session import durable

BITS = 8
SLICE_ROWS = 1 << 15
FIRST_SHARE = 0.02  # of all rows, that exact search looks at before it has a bound
SHARE = 0.6  # of all rows, that approximate search looks at; evenly spread vectors need as much, grouped ones a tenth
QUERY_CHUNK = 256


@dataclass
class Index:
    """A written index; what is held here does not grow with the rows."""

    rows: DataFrame  # bucket, slice, id, vector
    planes: np.ndarray
    centre: np.ndarray
    sizes: np.ndarray  # rows of each bucket
    metric: str

    @property
    def slices(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // SLICE_ROWS))


def _vectors(column: pa.Array, d: int, metric: str) -> np.ndarray:
    own = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    if metric == "cosine":
        length = np.linalg.norm(own, axis=1, keepdims=True)
        own = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    return own


def build_index(corpus: DataFrame, *, metric: str = "l2sq", bits: int = BITS, seed: int = 5) -> Index:
    """Index ``corpus(id, vector)``; it is written once below the shared folder.

    The length of the vectors is that of most; more planes make smaller buckets.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    good = corpus.select("id", "vector").where(_comparable() & (F.size("vector") > 0))
    usual = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = usual.d if usual else 1
    good = good.where(F.size("vector") == d)
    bits = min(bits, d)
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, bits)))
    kinds = f"id {corpus.schema['id'].dataType.simpleString()}, vector array<double>"

    def sums(batches):
        total, n = np.zeros(d), 0
        for batch in batches:
            own = _vectors(batch.column(0), d, metric)
            total, n = total + own.sum(axis=0), n + len(own)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], ["total", "n"])

    parts = good.select("vector").mapInArrow(sums, "total array<double>, n bigint")
    added = parts.select(F.posexplode("total").alias("i", "x"), "n").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    centre = np.zeros(d)
    for r in added:
        centre[r.i] = r.x / max(r.n, 1)

    def coded(batches):
        for batch in batches:
            own = _vectors(batch.column(1), d, metric)
            code = ((own - centre) @ turned > 0) @ (1 << np.arange(bits))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), d).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), batch.column(0), lists], ["bucket", "id", "vector"])

    dealt = durable(good.mapInArrow(coded, f"bucket int, {kinds}"))
    sizes = np.zeros(1 << bits, np.int64)
    for r in dealt.groupBy("bucket").count().collect():  # a row for each bucket
        sizes[r.bucket] = r["count"]
    count = F.array(*(F.lit(int(n)) for n in np.maximum(1, -(-sizes // SLICE_ROWS))))
    sliced = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.element_at(count, F.col("bucket") + 1)).cast("int"))
    written = durable(sliced.select("bucket", "slice", "id", "vector").sortWithinPartitions("bucket", "slice"))
    return Index(written, turned, centre, sizes, metric)


def _probes(index: Index, queries: DataFrame, choose) -> DataFrame:
    """``bucket, slice, query_id, vector``: each query once for each slice that it asks.

    ``choose(bounds, order, extra)`` gives a matrix of queries and buckets: which
    are asked, from the bounds and the buckets in their order.
    """
    d, bits = index.planes.shape
    kinds = queries.select("query_id").schema.simpleString().removeprefix("struct<").removesuffix(">")
    other = np.array([[(b >> j) & 1 for j in range(bits)] for b in range(1 << bits)], bool)
    planes, centre, metric, slices = index.planes, index.centre, index.metric, index.slices
    extra = "reach" in queries.columns

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), QUERY_CHUNK):
                part = batch.slice(first, QUERY_CHUNK)
                own = _vectors(part.column("vector"), d, metric)
                away = (own - centre) @ planes
                apart = (away > 0)[:, None, :] != other[None]
                bounds = (apart * (away**2)[:, None, :]).sum(axis=2)
                asked = choose(bounds, part.column("reach").to_numpy(zero_copy_only=False) if extra else None)
                query, bucket = np.nonzero(asked)
                times = slices[bucket]
                query, bucket = np.repeat(query, times), np.repeat(bucket, times)
                piece = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(own[query].ravel()), d).cast(pa.list_(pa.float64()))
                ids = part.column("query_id").take(pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(piece.astype(np.int32)), ids, lists], ["bucket", "slice", "query_id", "vector"])

    return queries.mapInArrow(run, f"bucket int, slice int, {kinds}, vector array<double>")


def _met(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance``: up to k hits of each query in each slice."""
    d = index.planes.shape[0]
    kinds = ", ".join(frame.select(c).schema.simpleString().removeprefix("struct<").removesuffix(">") for frame, c in ((probes, "query_id"), (index.rows, "id")))
    half = 0.5 if index.metric == "cosine" else 1.0
    rows = index.rows.withColumn("_role", F.lit(0))
    both = rows.unionByName(probes.withColumn("_role", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "_role")

    def run(batches):
        place, held, ids, matrix = None, [], None, None
        for batch in batches:
            role = batch.column("_role").to_numpy()
            key = batch.column("bucket").to_numpy().astype(np.int64) << 32 | batch.column("slice").to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.r_[0, cuts].astype(int), np.r_[cuts, len(batch)].astype(int)):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    if key[a] != place:
                        place, held, matrix = key[a], [], None
                    held.append((part.column("id"), part.column("vector")))
                    continue
                if key[a] != place:
                    continue  # no row is in this slice
                if matrix is None:
                    ids = pa.concat_arrays([h[0] for h in held])
                    matrix = np.concatenate([h[1].flatten().to_numpy().reshape(-1, d) for h in held])
                    order = pa.compute.rank(ids, tiebreaker="first").to_numpy()
                for c in range(0, len(part), QUERY_CHUNK):
                    asked = part.slice(c, QUERY_CHUNK)
                    own = asked.column("vector").flatten().to_numpy().reshape(-1, d)
                    query, row, distance = _nearest(own, matrix, order, k)
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("query_id").take(pa.array(query)), ids.take(pa.array(row)), pa.array(distance * half)], ["query_id", "id", "distance"]
                    )

    return both.mapInArrow(run, f"{kinds}, distance double")


def _nearest(own: np.ndarray, matrix: np.ndarray, order: np.ndarray, k: int):
    """The k nearest rows of each query by true distance, ties by order of id."""
    squares, lengths = (matrix**2).sum(axis=1), (own**2).sum(axis=1)
    rough = lengths[:, None] + squares - 2 * own @ matrix.T
    if len(matrix) > k:
        # Products round, so all that could be among the first k are measured again.
        slack = 1e-12 * (lengths[:, None] + squares.max())
        query, row = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack)
    else:
        query, row = np.nonzero(np.ones_like(rough, bool))
    distance = np.empty(len(query))
    for a in range(0, len(query), 1 << 16):
        distance[a : a + (1 << 16)] = ((own[query[a : a + (1 << 16)]] - matrix[row[a : a + (1 << 16)]]) ** 2).sum(axis=1)
    first = np.lexsort((order[row], distance, query))
    query, row, distance = query[first], row[first], distance[first]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], distance[keep]


def _within_share(sizes: np.ndarray, share: float):
    wanted = share * sizes.sum()

    def choose(bounds, _reach):
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        asked = np.zeros(bounds.shape, bool)
        np.put_along_axis(asked, order, (before < wanted) & (sizes[order] > 0), axis=1)
        return asked

    return choose


def search(index: Index, queries: DataFrame, k: int, *, share: float | None = None) -> DataFrame:
    """``query_id, rank, id, distance, approximate`` of the k nearest rows of each ``queries(query_id, vector)``.

    Exact without ``share``, approximate with it.
    """
    queries = queries.select("query_id", "vector").where(_comparable() & (F.size("vector") == index.planes.shape[0]))
    sizes = index.sizes
    first = _within_share(sizes, share if share is not None else FIRST_SHARE)
    found = _met(index, _probes(index, queries, first), k)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    if share is None:
        found = durable(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n"))
        doubled = 2.0 if index.metric == "cosine" else 1.0
        reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance") * doubled).otherwise(float("inf")).alias("reach"))
        open_ = queries.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))

        def rest(bounds, reach):
            # A little more than the bound, for its rounding; what was looked at before is left out.
            return (bounds <= reach[:, None] * (1 + 1e-9)) & (sizes > 0) & ~first(bounds, None)

        found = found.unionByName(_met(index, _probes(index, open_, rest), k))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance", F.lit(share is not None).alias("approximate"))
