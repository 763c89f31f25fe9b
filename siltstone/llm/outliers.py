"""Quality rules with robust multivariate outliers per language and source.

Plain counts of a text give base rules and a vector of transformed statistics.
Per language and source the minimum-covariance-determinant estimate of centre
and scatter is approached by concentration steps from two starts: rows are
ranked by their Mahalanobis distance, the nearest three quarters give the next
estimate, until a step makes the determinant no smaller, and the estimate of the
smallest determinant counts.  A text whose squared distance exceeds a
chi-square bound is rejected.

Groups of any size are judged alike: the estimate of a group is drawn towards
that of its language, and that of a language towards that of all rows, as if
``PRIOR_ROWS`` rows of the wider estimate were added to it.

A step is one job for all groups together: sums and products per group, start
and bin of distance (bins of equal ratio, so their number does not grow with the
rows), pre-aggregated before the shuffle, so a group that holds a third of all
rows is no special case; the bins of a group, some hundreds of rows, then give
its next estimate.  The bin in which the three quarters end counts by
the share of it that is needed.  Statistics are whole thousandths, so sums are
exact and reruns agree.

Defined cases: a null text has no words; null language and null source are
values of their own; a group or language without rows that pass the base rules
takes the wider estimate; a table with fewer than ``LEAST`` such rows altogether
has no estimate and is judged by the base rules alone; repeated rows each count;
an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm import textstats, words
from siltstone.session import discard, durable

MIN_WORDS = 50
COVERAGE = 0.75  # share of a group that an estimate rests on
LEAST = 30  # rows that pass, five for each statistic, for an estimate of all rows
PRIOR_ROWS = 60  # of the wider estimate in that of a group, ten for each statistic
SETTLED = 0.01  # a step that lowers the logarithm of the determinant by less is the last
CERTAINTY = 0.999  # of the chi-square bound
UNIT = 1000  # statistics are kept in thousandths
BINS_PER_DOUBLING = 16
MAX_BROADCAST_GROUPS = 5_000
SALTS = 64
STATISTICS = ("length", "word_length", "symbols", "duplicates", "repeats", "variety")
# Smallest standard deviation that counts, in place of a smaller one only, so
# that a statistic that is nearly always the same does not reject for a trifle:
# beside rows that have none, about a fortieth of symbols to words, a fifth of
# duplicate lines or a tenth of repeated words is let pass.
FLOORS = (0.1, 0.1, 0.25, 0.34, 0.146, 0.01)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
DIM = len(STATISTICS)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the counts of each text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            for first, part in words.slices(batch.column(batch.num_columns - 1)):
                own = textstats.counts(part)[0]
                columns = [c.slice(first, len(part)) for c in batch.columns[:-1]]
                columns += [pa.array(getattr(own, c).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS])

    picked = docs.select(*keep, F.col("text").alias("_text"))
    return picked.mapInArrow(run, schema + "".join(f", {c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _statistics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log1p("n_words"),
        F.col("word_chars") / n,
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(20 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(10 * F.col("n_repeat_words") / n),
        # Distinct words grow as a power of all words; the power is what counts.
        F.log1p("n_distinct") / F.log1p(n),
    )
    return [F.round(v * UNIT).cast("bigint").alias(name) for v, name in zip(values, STATISTICS, strict=True)]


def chi_square(p: float, freedom: int) -> float:
    """The p-quantile of the chi-square distribution, by bisection of the incomplete gamma series."""

    def below(x: float) -> float:
        a, x = freedom / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 500.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def consistency() -> float:
    """Factor that makes the scatter of the nearest share of normal rows that of all."""
    q = chi_square(COVERAGE, DIM)
    low, high = 0.0, 1.0
    # Share of chi-square with two more degrees of freedom below q, found by bisecting its quantile.
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, DIM + 2) < q else (low, middle)
    return COVERAGE / max(low, 1e-6)


PARAMETERS = "_group string, _start int, centre array<double>, scatter array<double>, inverse array<double>, log_det double"


def _floored(scatter: np.ndarray) -> np.ndarray:
    """``scatter`` with the floor's variance in each direction that has less, and as it is in all others."""
    unit = np.outer(FLOORS, FLOORS)
    own, directions = np.linalg.eigh(scatter / unit)
    return (directions * np.maximum(own, 1.0)) @ directions.T * unit


def _estimate(sums: dict, scale: float) -> tuple:
    """Centre, scatter, its inverse and the logarithm of its determinant, from sums over rows."""
    n = float(sums["n"])
    centre = np.array([float(sums[f"s{i}"]) for i in range(DIM)]) / n
    scatter = np.empty((DIM, DIM))
    for i, j in PAIRS:
        scatter[i, j] = scatter[j, i] = float(sums[f"p{i}_{j}"]) / n - centre[i] * centre[j]
    scatter = _floored(scale * scatter / UNIT**2)
    inverse, log_det = np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])
    return (centre / UNIT).tolist(), scatter.ravel().tolist(), inverse, log_det


def _of_all_rows(sums: DataFrame) -> DataFrame:
    """Parameters of start 1, from one row of sums per group."""

    def run(frames):
        for frame in frames:
            rows = [(row["_group"], 1, *_estimate(row, 1.0)) for row in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=["_group", "_start", "centre", "scatter", "inverse", "log_det"])

    return sums.mapInPandas(run, PARAMETERS)


# Text of expressions, which each step uses again: built of columns they would cost more than small steps do.
def _sums() -> list[Column]:
    single = [F.expr(f"sum({c}) AS s{i}") for i, c in enumerate(STATISTICS)]
    # Decimals: products of thousandths may exceed 64 bits over very many rows.
    double = [F.expr(f"sum(CAST({STATISTICS[i]} * {STATISTICS[j]} AS decimal(20,0))) AS p{i}_{j}") for i, j in PAIRS]
    return [F.expr("count(*) AS n"), *single, *double]


NAMES = ["n", *(f"s{i}" for i in range(DIM)), *(f"p{i}_{j}" for i, j in PAIRS)]


def _with(rows: DataFrame, parameters: DataFrame, groups: int) -> DataFrame:
    """Rows with the parameters of their group, whatever the size of the group."""
    if groups <= MAX_BROADCAST_GROUPS:
        return rows.join(F.broadcast(parameters), "_group")
    salted = parameters.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("*"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["_group", "_salt"]).drop("_salt")


def squared_distance() -> Column:
    off = [f"({c} / {UNIT} - centre[{i}])" for i, c in enumerate(STATISTICS)]
    return F.expr(" + ".join(f"{1 if i == j else 2} * {off[i]} * {off[j]} * inverse[{i * DIM + j}]" for i, j in PAIRS))


def _quartiles(vectors: DataFrame) -> DataFrame:
    """``_group, q array<array<bigint>>``: lower quartile, median and upper quartile of each statistic, from exact counts."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(c).alias("_v")) for i, c in enumerate(STATISTICS))))
    counts = vectors.select("_group", each.alias("_e")).groupBy("_group", "_e._i", "_e._v").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_group", "_i")
    placed = counts.withColumn("_to", F.sum("_n").over(whole.orderBy("_v"))).withColumn("_all", F.sum("_n").over(whole))
    cuts = [F.min(F.when(F.col("_to") >= share * F.col("_all"), F.col("_v"))) for share in (0.25, 0.5, 0.75)]
    of = placed.groupBy("_group", "_i").agg(F.array(*cuts).alias("_q"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_q")))  # one entry for each statistic
    return of.groupBy("_group").agg(F.transform(ordered, lambda e: e["_q"]).alias("q"))


def _middles(vectors: DataFrame) -> DataFrame:
    """Parameters of a start at the medians, with the spread of the quartiles."""
    spread = [
        F.greatest((F.col("q")[i][2] - F.col("q")[i][0]) / (1.349 * UNIT), F.lit(FLOORS[i])) for i in range(DIM)
    ]
    zero = F.lit(0.0)
    square = lambda own: F.array(*(own(spread[i]) if i == j else zero for i in range(DIM) for j in range(DIM)))
    return _quartiles(vectors).select(
        "_group",
        F.lit(2).alias("_start"),
        F.array(*(F.col("q")[i][1] / UNIT for i in range(DIM))).alias("centre"),
        square(lambda x: x * x).alias("scatter"),
        square(lambda x: 1 / (x * x)).alias("inverse"),
        zero.alias("log_det"),
    )


def _step(vectors: DataFrame, current: DataFrame, groups: int, scale: float) -> DataFrame:
    """The next estimate per group and start, from the nearest rows, and whether it is ``moving`` still."""
    placed = _with(vectors, current.select("_group", "_start", "centre", "inverse", "log_det"), groups).withColumn(
        "_bin", F.round(F.log2(squared_distance() + 1e-6) * BINS_PER_DOUBLING).cast("int")
    )
    binned = placed.groupBy("_group", "_start", "_bin").agg(*_sums(), F.max("log_det").alias("_before"))
    products = {f"p{i}_{j}": F.col(f"p{i}_{j}").cast("double") for i, j in PAIRS}

    def nearest(bins: pd.DataFrame) -> pd.DataFrame:
        # Bins are few, and always added in the same order.
        bins = bins.sort_values("_bin")
        n = bins["n"].to_numpy(float)
        needed = COVERAGE * n.sum()
        share = np.clip((needed - (np.cumsum(n) - n)) / n, 0.0, 1.0)
        first = bins.iloc[0]
        centre, scatter, inverse, log_det = _estimate((bins[NAMES].mul(share, axis=0)).sum().to_dict(), scale)
        moving = log_det < float(first["_before"]) - SETTLED
        row = (first["_group"], int(first["_start"]), centre, scatter, inverse, log_det, moving)
        return pd.DataFrame([row], columns=["_group", "_start", "centre", "scatter", "inverse", "log_det", "moving"])

    return binned.withColumns(products).groupBy("_group", "_start").applyInPandas(nearest, PARAMETERS + ", moving boolean")


def robust_estimates(vectors: DataFrame, groups: int) -> DataFrame:
    """``_group, rows, centre, scatter`` of the rows ``vectors(_group, <STATISTICS>)``."""
    whole = durable(vectors.groupBy("_group").agg(*_sums()))
    # Starts: all rows, and the rows near the coordinate-wise medians.
    starts = durable(_of_all_rows(whole).unionByName(_middles(vectors)).withColumn("log_det", F.lit(float("inf"))))
    scale = consistency()
    steps, moving = [], starts
    while True:
        steps.append(durable(_step(vectors, moving, groups, scale)))
        moving = steps[-1].where("moving")
        if moving.isEmpty():
            break
    # The smallest determinant of all steps and both starts.
    found = functools.reduce(DataFrame.unionByName, (s.withColumn("_at", F.lit(i)) for i, s in enumerate(steps)))
    best = F.min_by(F.struct("centre", "scatter"), F.struct("log_det", "_start", "_at")).alias("best")
    chosen = found.groupBy("_group").agg(best).select("_group", "best.centre", "best.scatter")
    estimates = durable(chosen.join(whole.select("_group", F.col("n").alias("rows")), "_group"))
    discard(starts, whole, *steps)
    return estimates


ALL = "all"  # the group of all rows


def _wider(lang: str) -> Column:
    """The group of all rows of a language; the name is never that of a smaller group, which begins with a brace."""
    return F.concat(F.lit("lang "), F.to_json(F.struct(lang)))


def _drawn(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """``own(_group, <key>)`` with ``rows, centre, scatter`` drawn towards those of ``wider``, by the rows of its own."""
    # A group without rows has no centre of its own and takes the wider one.
    share = F.coalesce(F.col("rows"), F.lit(0)) / (F.coalesce(F.col("rows"), F.lit(0)) + PRIOR_ROWS)
    mixed = {
        c: F.when(F.col(c).isNull(), F.col(f"_{c}")).otherwise(
            F.zip_with(c, f"_{c}", lambda x, y: share * x + (1 - share) * y)
        )
        for c in ("centre", "scatter")
    }
    around = wider.select(F.col("_group").alias(key), F.col("centre").alias("_centre"), F.col("scatter").alias("_scatter"))
    return own.join(around, key).withColumns(mixed).drop("_centre", "_scatter", key)


def _inverted(estimates: DataFrame) -> DataFrame:
    """``_group, centre, inverse`` of ``estimates(_group, centre, scatter)``."""

    def run(frames):
        for frame in frames:
            inverse = [np.linalg.inv(np.reshape(s, (DIM, DIM))).ravel().tolist() for s in frame["scatter"]]
            yield frame[["_group", "centre"]].assign(inverse=inverse)

    return estimates.select("_group", "centre", "scatter").mapInPandas(run, "_group string, centre array<double>, inverse array<double>")


def group_estimates(vectors: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """``_group, centre, inverse`` of all groups of ``sizes(_group, _lang)``; none if too few rows pass altogether."""
    levels = vectors.withColumn("_group", F.explode(F.array("_group", "_lang", F.lit(ALL)))).drop("_lang")
    found = robust_estimates(levels, groups)
    top = found.where((F.col("_group") == ALL) & (F.col("rows") >= LEAST))
    langs = sizes.select(F.col("_lang").alias("_group"), F.lit(ALL).alias("_top")).distinct()
    langs = _drawn(langs.join(found, "_group", "left"), top, "_top")
    own = _drawn(sizes.select("_group", "_lang").join(found, "_group", "left"), langs, "_lang")
    return durable(_inverted(own))


def judge(docs: DataFrame, certainty: float = CERTAINTY) -> DataFrame:
    """``doc_id, lang, source``, the counts, ``base_failed``, ``distance`` (squared, null without estimate) and ``kept``."""
    group = F.to_json(F.struct("lang", "source"))
    table = durable(
        text_counts(docs)
        .withColumn("base_failed", base_failed())
        .withColumns({"_group": group, "_lang": _wider("lang")})
        .select("*", *_statistics())
    )
    sizes = durable(table.select("_group", "_lang").distinct())
    groups = sizes.count()
    vectors = table.where(~F.col("base_failed")).select("_group", "_lang", *STATISTICS)
    estimates = group_estimates(vectors, sizes, groups)
    if groups <= MAX_BROADCAST_GROUPS:
        judged = table.join(F.broadcast(estimates), "_group", "left")
    else:
        known = estimates.select("_group")
        judged = _with(table, estimates, groups).unionByName(
            table.join(known, "_group", "left_anti"), allowMissingColumns=True
        )
    distance = squared_distance()
    near = F.coalesce(distance <= chi_square(certainty, DIM), F.lit(True))
    return judged.select(
        "doc_id", "lang", "source", *COUNTS, "base_failed", distance.alias("distance"), (~F.col("base_failed") & near).alias("kept")
    )
