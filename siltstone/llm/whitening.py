"""Whitening of vectors by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed.  All that is asked of the table is its product
with a few columns at a time: each task centres its vectors, multiplies, and
hands on one partial sum per entry of the result, which Spark adds up.  A round
of the method takes the Ritz pairs of the subspace, locks those at the front
whose residuals are down to the rounding of doubles, solves the projected
correction equations of the others side by side by some steps of MINRES, where
a step is one product for all, and adds the corrections to the subspace, which
is thinned when it is full.  A pair is locked only behind all larger ones, and
some more pairs than asked for are carried so that close ones part.

Entries become whole numbers, ``floor(scale * c) + shift``, so sums are exact.

Defined cases: a null vector, one with null or non-finite entries, an empty one
and one of another length than most (of equally frequent lengths the longest)
takes no part and has no rows; repeated rows and null keys are rows like others;
other columns are not read; directions without variance have no component, so
there can be fewer than asked for; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import durable

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
GUARDS = 4  # pairs carried beyond those asked for
INNER_STEPS = 5  # of MINRES in a round
SUBSPACE = 6  # times the pairs carried, then it is thinned to twice their number
EPSILON = np.finfo(np.float64).eps
TOLERANCE = 32 * EPSILON  # of a residual, relative to the largest eigenvalue, times the root of the dimension

Product = Callable[[np.ndarray], np.ndarray]


# ---------------------------------------------------------------- the table


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """``key, x array<bigint>`` of the rows whose vector takes part."""
    value = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) != float("inf"))
    good = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where(F.forall("_v", finite) & (F.size("_v") > 0))
    lengths = good.groupBy(F.size("_v").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    good = good.where(F.size("_v") == (usual.length if usual else 0))
    x = F.transform("_v", lambda c: F.floor(value(c) * scale).cast("bigint") + shift)
    return good.select(F.col("_key").alias(key), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(table: DataFrame, shape: tuple[int, int], partial: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all tasks of a matrix that each makes of its vectors."""

    def run(batches):
        sums = np.zeros(shape)
        for batch in batches:
            sums += partial(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "value"])

    cells = table.select("x").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1])
    for r in cells.collect():  # dimension times columns, however many rows there are
        out[r["at"]] = r["value"]
    return out.reshape(shape)


# ---------------------------------------------------------------- the method


def minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column, after some steps of MINRES side by side."""
    length = lambda a: np.sqrt((a * a).sum(axis=0))
    divided = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
    x = np.zeros_like(right)
    beta = length(right)
    phi, before, own = beta, np.zeros_like(right), divided(right, beta)
    beta = np.zeros_like(beta)
    cosine, sine = [-np.ones_like(beta)] * 2, [np.zeros_like(beta)] * 2
    directions = [np.zeros_like(right)] * 2
    for _ in range(steps):
        next_ = product(own) - beta * before
        alpha = (own * next_).sum(axis=0)
        next_ = next_ - alpha * own
        new_beta = length(next_)
        new_beta = np.where(new_beta > 16 * EPSILON * (np.abs(alpha) + beta), new_beta, 0.0)  # nothing new is left
        # The next column of the tridiagonal matrix, turned by the two rotations before it.
        far = sine[0] * beta
        near = -cosine[0] * beta
        middle = cosine[1] * near + sine[1] * alpha
        bottom = sine[1] * near - cosine[1] * alpha
        size = np.sqrt(bottom**2 + new_beta**2)
        c, s = divided(bottom, size), divided(new_beta, size)
        direction = divided(own - middle * directions[1] - far * directions[0], size)
        x = x + (c * phi) * direction
        phi = s * phi
        cosine, sine = [cosine[1], c], [sine[1], s]
        directions = [directions[1], direction]
        before, own, beta = own, divided(next_, new_beta), new_beta
        if not new_beta.any():
            break
    return x


def _new_directions(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the vectors add to a basis."""
    out = basis
    for column in vectors.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, column / left])
    return out[:, basis.shape[1] :]


def leading_pairs(product: Product, d: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of a symmetric product without negative eigenvalues."""
    k = min(k, d)
    carried = min(d, k + GUARDS)
    most = min(d, SUBSPACE * carried)
    fresh = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = _new_directions(fresh.standard_normal((d, carried)), locked)
    image = product(basis)
    before, stalled = np.inf, 0
    while True:
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        residual = ritz_image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        largest = max(np.r_[values, theta], default=0.0)
        good = TOLERANCE * np.sqrt(d) * largest
        front = 0
        while front < len(theta) and len(values) + front < k and size[front] <= good:
            front += 1
        if front:
            locked, values = np.column_stack([locked, ritz[:, :front]]), np.r_[values, theta[:front]]
            ritz, ritz_image, theta, residual, size = ritz[:, front:], ritz_image[:, front:], theta[front:], residual[:, front:], size[front:]
            before, stalled = np.inf, 0
        if len(values) >= k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        stalled = stalled + 1 if front == 0 and size[0] > before / 2 else 0
        before = min(before, size[0])
        if stalled > 12:
            raise RuntimeError(f"a residual stays at {size[0] / largest:.1e} of the largest eigenvalue")
        basis, image = ritz, ritz_image
        if basis.shape[1] + carried > most and basis.shape[1] > 2 * carried:
            basis, image = basis[:, : 2 * carried], image[:, : 2 * carried]
        open_ = np.flatnonzero(size[:carried] > good)[: carried]
        shift, fixed = theta[open_], np.column_stack([locked, ritz[:, :carried]])

        def projected(v: np.ndarray) -> np.ndarray:
            return v - fixed @ (fixed.T @ v)

        def shifted(v: np.ndarray, shift=shift) -> np.ndarray:
            inside = projected(v)
            return projected(product(inside) - inside * shift)

        full = np.column_stack([locked, basis])
        # Beyond the carried pairs nothing may be left to correct them with; then the subspace itself is enough.
        corrections = minres(shifted, -projected(residual[:, open_]), INNER_STEPS) if fixed.shape[1] < d else residual[:, :0]
        added = _new_directions(np.column_stack([corrections, residual[:, open_]]), full)[:, :carried]
        if not added.shape[1]:
            added = _new_directions(fresh.standard_normal((d, carried)), full)
        if added.shape[1]:
            basis, image = np.column_stack([basis, added]), np.column_stack([image, product(added)])
        else:  # the whole space: products once more, so that their rounding does not pile up
            basis = _new_directions(basis, locked)
            image = product(basis)


# ---------------------------------------------------------------- the operator


@dataclass
class Whitening:
    """What a table's whitening is made of; small, whatever the number of rows."""

    vectors: DataFrame  # key, x
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    directions: np.ndarray  # unit eigenvectors, a column each
    trace: float
    identity_error: float


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    vectors = durable(whole_vectors(rows, key, vector))
    d = len((vectors.select("x").first() or [[]])[0])
    if not d:
        return Whitening(vectors, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    counted = vectors.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    n, sums = counted.n, [counted[f"s{i}"] for i in range(d)]
    mean = np.array([s / n for s in sums])

    def product(columns: np.ndarray) -> np.ndarray:
        def partial(x):
            centred = x - mean
            return centred.T @ (centred @ columns)

        return _added(vectors, columns.shape, partial, d) / n

    trace = float(_added(vectors, (1, d), lambda x: ((x - mean) ** 2).sum(axis=0)[None], d).sum() / n)
    if not trace:
        return Whitening(vectors, n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    values, directions = leading_pairs(product, d, components)
    varied = values > d * EPSILON * values.max()
    values, directions = values[varied], directions[:, varied]
    k = len(values)
    to_white = directions / np.sqrt(values)

    def moments(x):
        white = (x - mean) @ to_white
        return np.column_stack([white.T @ white, white.sum(axis=0)])

    sums_of = _added(vectors, (k, k + 1), moments, d) / n
    covariance = sums_of[:, :k] - np.outer(sums_of[:, k], sums_of[:, k])
    return Whitening(vectors, n, sums, values, directions, trace, float(np.abs(covariance - np.eye(k)).max()))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    The deviation is exact, and an error where it does not fit a bigint.
    """
    own = fit(rows, key, vector, components)
    total = F.array(*(F.lit(s).cast("bigint") for s in own.sums)) if own.sums else F.array().cast("array<bigint>")
    mean = F.array(*(F.lit(s / own.n) for s in own.sums)) if own.sums else F.array().cast("array<double>")
    off = F.zip_with("x", total, lambda a, s: F.lit(own.n).cast("bigint") * a - s)
    deviation = F.aggregate(off, F.lit(0).cast("bigint"), lambda sum_, a: sum_ + a * a)
    centred = own.vectors.select(key, deviation.alias("deviation"), F.zip_with("x", mean, lambda a, m: a.cast("double") - m).alias("_c"))

    def projected(k: int) -> Column:
        axis = F.array(*(F.lit(float(v)) for v in own.directions[:, k] / np.sqrt(own.values[k])))
        return F.aggregate(F.zip_with("_c", axis, lambda a, v: a * v), F.lit(0.0), lambda sum_, a: sum_ + a)

    each = [
        F.struct(F.lit(k + 1).alias("component"), projected(k).alias("whitened"), F.lit(float(e / own.trace)).alias("explained"))
        for k, e in enumerate(own.values)
    ]
    kinds = "array<struct<component:int,whitened:double,explained:double>>"
    out = centred.select(key, "deviation", F.explode(F.array(*each) if each else F.array().cast(kinds)).alias("_p"))
    return out.select(
        key, "_p.component", F.lit(own.n).cast("bigint").alias("n"), "deviation", "_p.whitened", "_p.explained",
        F.lit(own.identity_error).alias("identity_error"),
    )
