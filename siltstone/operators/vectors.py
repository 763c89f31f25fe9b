"""Exact nearest neighbours, and the collections they search.

No pair of query and row ever becomes a Spark row: a task compares a batch of
rows with a block of queries and hands on at most k hits per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ordering import with_position
from siltstone.schemas import ISSUE_ORDER
from siltstone.session import durable

# Queries up to this number and size travel to every executor; beyond either,
# queries and rows meet in a grid of bounded groups.
SHIPPED_QUERIES = 8192
SHIPPED_BYTES = 64 << 20
GRID_QUERIES = 4096
GRID_BYTES = 32 << 20
_QUERY_CHUNK = 256
_ROW_CHUNK = 4096
_PAIR_CHUNK = 1 << 16
_PAIRS_HELD = 1 << 20
# Components beyond this have squares that double precision can't add up.
LARGEST = 1e150
_LEAST_SLACK = 1e-37  # below this, single precision has no rounding in proportion


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64) if len(vectors) else np.zeros((0, 1))


class _Nearest:
    """The k nearest rows seen so far for a block of queries.

    A distance is ``base - factor * score``, where the score of a pair is one
    product: the rows carry half their squared length as a further component.
    """

    def __init__(self, queries: pd.DataFrame, k: int, metric: str):
        self.k, self.metric = k, metric
        self.ids = queries["query_id"].to_numpy()
        self.scope = queries["scope"].to_numpy() if "scope" in queries else None
        self.vectors = self._scaled(_matrix(queries["vector"]))
        self.norms = (self.vectors**2).sum(axis=1)
        self.base, self.factor = (np.ones(len(self.ids)), 1.0) if metric == "cosine" else (self.norms, 2.0)
        self.wide = np.hstack([self.vectors, np.full((len(self.vectors), 1), float(metric != "cosine"))])
        with np.errstate(over="ignore"):
            self.single = self.wide.astype(np.float32)
        self.worst = np.full(len(self.ids), np.inf)
        self.best = pd.DataFrame({"q": np.array([], dtype=np.int64), "distance": [], "id": []})

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        if self.metric != "cosine" or not len(vectors):
            return vectors
        lengths = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)

    def _exact(self, q: np.ndarray, c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for i in range(0, len(q), _PAIR_CHUNK):
            part = slice(i, i + _PAIR_CHUNK)
            a, b = self.vectors[q[part]], rows[c[part]]
            out[part] = 1 - (a * b).sum(axis=1) if self.metric == "cosine" else ((a - b) ** 2).sum(axis=1)
        return out

    def add(self, batch: pd.DataFrame) -> None:
        if not len(self.ids) or not len(batch):
            return
        rows = self._scaled(_matrix(batch["vector"]))
        norms = (rows**2).sum(axis=1)
        # Rows of like length together: the longest of a chunk sets its slack.
        order = np.argsort(norms, kind="stable")
        for start in range(0, len(order), _ROW_CHUNK):
            chunk = order[start : start + _ROW_CHUNK]
            self._add(batch.iloc[chunk], rows[chunk], norms[chunk])

    def _scores(self, part: slice, wide: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Scores in single precision, in double where that overflows."""
        with np.errstate(over="ignore", invalid="ignore"):
            scores = self.single[part] @ single.T
            if np.isfinite(scores.sum()) or np.isfinite(scores).all():
                return scores
        return self.wide[part] @ wide.T

    def _add(self, batch: pd.DataFrame, rows: np.ndarray, norms: np.ndarray) -> None:
        wide = np.hstack([rows, -norms[:, None] / 2.0])
        with np.errstate(over="ignore"):
            single = wide.astype(np.float32)
        scope = batch["scope"].to_numpy() if self.scope is not None else None
        # Single precision finds the candidates; the slack covers its rounding,
        # so that no row of the exact answer is missed.
        unit = np.float64(np.finfo(np.float32).eps) * (rows.shape[1] + 9)
        slacks = unit * (np.sqrt(self.norms) + np.sqrt(norms.max())) ** 2 + _LEAST_SLACK
        hits = []
        for start in range(0, len(self.ids), _QUERY_CHUNK):
            part = slice(start, start + _QUERY_CHUNK)
            scores, slack, worst = self._scores(part, wide, single), slacks[part], self.worst[part]
            allowed = None
            if scope is not None:
                asked = self.scope[part, None]
                allowed = pd.isna(asked) | (asked == scope[None, :])
            if scores.shape[1] > self.k and np.isinf(worst).any():
                most = scores if allowed is None else np.where(allowed, scores, -np.inf)
                kth = np.partition(most, -self.k, axis=1)[:, -self.k].astype(np.float64)
                worst = np.minimum(worst, self.base[part] - self.factor * (kth - slack))
            with np.errstate(over="ignore"):
                least = ((self.base[part] - worst) / self.factor - slack).astype(scores.dtype)
            near = scores >= np.nextafter(least, scores.dtype.type(-np.inf))[:, None]
            found = np.flatnonzero(near if allowed is None else near & allowed)
            hits.append(np.stack(np.divmod(found, scores.shape[1])) + np.array([[start], [0]]))
            if sum(h.shape[1] for h in hits) > _PAIRS_HELD:  # ties leave more candidates than hits
                self._keep(hits, batch, rows)
                hits = []
        self._keep(hits, batch, rows)

    def _keep(self, hits: list[np.ndarray], batch: pd.DataFrame, rows: np.ndarray) -> None:
        q, c = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
        if not len(q):
            return
        found = pd.DataFrame({"q": q, "distance": self._exact(q, c, rows), "id": batch["id"].to_numpy()[c]})
        if "ids" in batch:
            found["ids"] = batch["ids"].to_numpy()[c]
        found = found[found["distance"].to_numpy() <= self.worst[q]]
        self.best = self._best(pd.concat([self.best, found], ignore_index=True) if len(self.best) else found)
        kept = self.best.groupby("q")["distance"].agg(["size", "last"])
        full = kept[kept["size"] >= self.k]
        self.worst[full.index.to_numpy(dtype=np.int64)] = full["last"].to_numpy()

    def _best(self, found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["q", "distance", "id"], kind="stable").groupby("q", sort=False).head(self.k)

    def result(self, columns: list[str]) -> pd.DataFrame:
        q = self.best["q"].to_numpy(dtype=np.int64)
        if not len(q):
            return pd.DataFrame({c: self.ids[:0] if c == "query_id" else np.array([], dtype=object) for c in columns})
        found = {"query_id": self.ids[q]} | {c: self.best[c].to_numpy() for c in columns if c != "query_id"}
        return pd.DataFrame(found, columns=columns)


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ]
    if "ids" in corpus.columns:
        fields.append(T.StructField("ids", corpus.schema["ids"].dataType))
    return T.StructType(fields)


def _shipped(queries: pd.DataFrame, corpus: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    shared, columns = corpus.sparkSession.sparkContext.broadcast(queries), schema.names

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _Nearest(shared.value, k, metric)
        for batch in batches:
            nearest.add(batch)
        yield nearest.result(columns)

    return corpus.mapInPandas(search, schema)


def _pieces(rows: int, most: int, wanted: int) -> int:
    """Into how many parts rows are cut: no part beyond ``most`` rows, and as many as wanted where parts stay long."""
    return max(1, -(-rows // most), min(wanted, rows // GRID_QUERIES))


def _grid(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, schema: T.StructType, dimensions: int
) -> DataFrame:
    """Blocks of queries against slices of rows; both sides of a cell are bounded.

    Rows are copied once per block and queries once per slice, so both are as
    large as a task may hold, or smaller only as long as cores would be idle.
    """
    most = max(1, GRID_BYTES // (8 * max(1, dimensions)))
    wanted = math.ceil(math.sqrt(4 * corpus.sparkSession.sparkContext.defaultParallelism))
    blocks, slices = _pieces(queries.count(), most, wanted), _pieces(corpus.count(), most, wanted)
    columns = schema.names

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), numbers(slices).alias("slice")
    )
    right = corpus.select(
        "*", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), numbers(blocks).alias("block")
    )
    # More partitions than cells, so that few cells share one.
    left, right = (side.repartition(4 * blocks * slices, "block", "slice") for side in (left, right))

    def search(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nearest = _Nearest(block, k, metric)
        nearest.add(rows)
        return nearest.result(columns)

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(search, schema)


def _comparable() -> F.Column:
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.col("vector").isNotNull() & F.coalesce(sound, F.lit(False))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _gathered(corpus: DataFrame, vectors: DataFrame, k: int, scoped: list[str]) -> DataFrame:
    """``id, ids, vector``: rows that share a vector as one, with the k smallest ids.

    All of them are equally far from any query and ties rank by id, so no other
    row of the vector can be among k nearest.
    """
    first = Window.partitionBy("vec_id", *scoped).orderBy("id")
    kept = corpus.select("id", "vec_id", *scoped).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"])
    members = kept.groupBy("vec_id", *scoped).agg(listed.alias("ids"))
    return durable(members.join(vectors, "vec_id").select(F.get("ids", F.lit(0)).alias("id"), "ids", "vector", *scoped))


def _searched(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, shipped_queries: int, gathered: bool, scoped: list[str]
) -> DataFrame:
    shared = ["ids"] if gathered else []
    queries = queries.select("query_id", "vector", *scoped).where(_comparable())
    corpus = corpus.select("id", "vector", *shared, *scoped).where(_comparable())
    schema = _hit_schema(queries, corpus)
    few = queries.limit(shipped_queries + 1).toPandas()
    dimensions = len(few["vector"].iloc[0]) if len(few) else 0
    if len(few) <= shipped_queries and len(few) * dimensions * 8 <= SHIPPED_BYTES:
        found = _shipped(few, corpus, k, metric, schema)
    else:
        found = _grid(queries, corpus, k, metric, schema, dimensions)
    hits = _ranked(found, k)
    if shared:
        hits = _ranked(hits.select("query_id", F.explode("ids").alias("id"), "distance"), k)
    return hits.select("query_id", "rank", "id", "distance")


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    metric: str = "l2sq",
    shipped_queries: int = SHIPPED_QUERIES,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Exact k nearest rows of each query: (query_id, rank, id, distance).

    ``queries`` has ``query_id`` and ``vector``, ``corpus`` has ``id`` and
    ``vector``.  If both have a column ``scope``, a query whose scope is not
    null sees only rows of the same scope.  Equal distances rank by id.
    Vectors that are null or hold a null, NaN or infinite component, or one
    beyond ``LARGEST``, take no part on either side.  Filter
    ``corpus`` beforehand to search a part of it.

    Where many rows share vectors, either side can have ``vec_id`` instead of
    ``vector`` and ``vectors`` the columns ``vec_id`` and ``vector``: every
    vector is then compared once, however many rows hold it.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    scoped = ["scope"] if "scope" in queries.columns and "scope" in corpus.columns else []
    gathered = vectors is not None and "vector" not in corpus.columns
    if vectors is not None:
        vectors = vectors.select("vec_id", "vector").where(_comparable())
        if gathered:
            corpus = _gathered(corpus, vectors, k, scoped)
        if "vector" not in queries.columns:
            if scoped:
                queries = queries.select("query_id", "vec_id", *scoped).join(vectors, "vec_id")
            else:
                asked = queries.select("query_id", "vec_id")
                searched = vectors.join(asked.select("vec_id").distinct(), "vec_id", "left_semi")
                searched = searched.withColumnRenamed("vec_id", "query_id")
                hits = _searched(searched, corpus, k, metric, shipped_queries, gathered, scoped)
                hits = hits.drop("rank").withColumnRenamed("query_id", "vec_id")
                return _ranked(asked.join(hits, "vec_id"), k).select("query_id", "rank", "id", "distance")
    return _searched(queries, corpus, k, metric, shipped_queries, gathered, scoped)


def nearest_batch(
    queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "l2sq", vectors: DataFrame | None = None
) -> DataFrame:
    """Several searches per query (``query_id``, ``sub``, ``vector``) in one job.

    The hits of all searches are kept, repeats included.  ``vectors`` as in
    ``nearest``.
    """
    types = {name: queries.schema[name].dataType for name in ("query_id", "sub")}
    key = F.concat_ws("|", F.col("sub").cast("string"), F.col("query_id").cast("string"))
    of = "vector" if "vector" in queries.columns else "vec_id"
    hits = nearest(queries.select(key.alias("query_id"), of), corpus, k, metric=metric, vectors=vectors)
    sub, query_id = F.substring_index("query_id", "|", 1), F.regexp_replace("query_id", r"^[^|]*\|", "")
    return hits.select(
        query_id.cast(types["query_id"]).alias("query_id"),
        sub.cast(types["sub"]).alias("sub"),
        "rank",
        "id",
        "distance",
    )


def where_equal(corpus: DataFrame, **filters) -> DataFrame:
    """Rows that equal every given value; a value of None asks nothing."""
    for column, value in filters.items():
        if value is not None:
            corpus = corpus.where(F.col(column) == F.lit(value))
    return corpus


def search_code(queries: DataFrame, collection: DataFrame, k: int = 3, *, metric: str = "l2sq", **filters) -> DataFrame:
    """Hits with document and metadata from a code collection."""
    return _with_documents(nearest(queries, _searchable(where_equal(collection, **filters)), k, metric=metric), collection)


def search_issues(queries: DataFrame, collection: DataFrame, k: int = 5, *, metric: str = "l2sq", **filters) -> DataFrame:
    """Hits with document and metadata from an issue collection."""
    return _with_documents(nearest(queries, _searchable(where_equal(collection, **filters)), k, metric=metric), collection)


def _searchable(collection: DataFrame) -> DataFrame:
    return collection.select("id", F.col("embedding").alias("vector"))


def _with_documents(hits: DataFrame, collection: DataFrame) -> DataFrame:
    metadata = [c for c in collection.columns if c not in ("id", "document", "embedding")]
    return hits.join(collection.select("id", "document", F.struct(*metadata).alias("metadata")), "id").select(
        "query_id", "rank", "id", "document", "metadata", "distance"
    )


def by_id(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the given ids."""
    return collection.join(ids.select("id").distinct(), "id", "left_semi")


def code_rows(functions: DataFrame) -> DataFrame:
    """Rows of a code collection; ids end with the position in function order."""
    shown = F.coalesce("class_name", F.lit("None"))
    return with_position(functions, "func_id", "file", "start_line", name="position").select(
        F.concat_ws("::", "file", shown, "function", F.col("position").cast("string")).alias("id"),
        F.col("code").alias("document"),
        "func_id",
        "file",
        F.coalesce("class_name", F.lit("")).alias("class_name"),
        "function",
        "start_line",
        "end_line",
        "parameters",
        "function_length",
        "nesting_depth",
        "has_docstring",
        "calls",
        "imports",
        "parent_file",
    )


def issue_rows(issues: DataFrame) -> DataFrame:
    """Rows of an issue collection; ids end with the position in issue order."""
    shown = F.coalesce("class_name", F.lit(""))
    position = F.concat(F.lit("issue"), F.col("position").cast("string"))
    used = ("file", "class_name", "function", "category", "issue", "severity", "lines", "explanation", "suggestion")
    return with_position(issues.select(*ISSUE_ORDER, *used), *ISSUE_ORDER, name="position").select(
        F.concat_ws("::", "file", shown, "function", position).alias("id"),
        F.concat_ws(" ", "explanation", "suggestion").alias("document"),
        "func_id",
        "file",
        shown.alias("class_name"),
        "function",
        "category",
        "issue",
        "severity",
        "lines",
    )


def metadata_json(rows: DataFrame) -> DataFrame:
    """Arrays as JSON text, for stores that hold scalars only."""
    arrays = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name != "embedding"]
    return rows.withColumns({name: F.to_json(name) for name in arrays})


def with_embedding(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Attach vectors held in a table (``key``, ``embedding``)."""
    return rows.join(vectors.select(key, "embedding"), key)


def hashing_embed(rows: DataFrame, text: str = "document", dimensions: int = 256) -> DataFrame:
    """Deterministic bag-of-words vectors from Spark ML, without a model."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    counted = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(
        rows.withColumn("_words", F.array_remove(words, ""))
    )
    scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def model_embed(rows: DataFrame, make_predict, text: str = "document", batch_size: int = 256) -> DataFrame:
    """Vectors from a user's model, loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf

    embed = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return rows.withColumn("embedding", embed(text))
