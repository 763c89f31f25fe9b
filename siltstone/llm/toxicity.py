"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens of labelled texts, and their beginnings, since languages inflect and
compound, are counted by class, once a text.  With a symmetric Dirichlet prior
each has a log-odds ratio; the score of a token is the best lower confidence
bound of itself and its beginnings where that is above zero, and
all other tokens lower the running sum.  One linear scan per text finds every
maximal-scoring segment.  By extreme-value theory the score of the best segment
in n tokens of harmless text exceeds x with probability 1 - exp(-K n e^(-lambda x));
lambda is solved from the token scores of harmless texts and K is fitted to
their best segments.  A logistic curve over the calibrated score of the best
passage and the mass of all significant ones gives the probability.

K and the curve are fitted on texts whose tokens did not go into their scores
(two halves, each scored by the other).  Only the labels go into fitting, at
most ``MAX_LABELLED`` rows of them, which bounds the model too; every text is
scored whole.

Defined cases: null and empty texts have no passage and the score of such;
labels without a class are left out; with no toxic or no harmless label all
scores are 0; rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import labelled, words

MAX_LABELLED = 40_000  # labelled rows used for fitting
BEGINNINGS = (5, 6, 7, 8)  # bytes
LEAST_TOXIC = 4  # toxic texts that hold a token which may score; fewer can't pass the bound
PRIOR = 0.5  # pseudo-count of each bucket and class
CONFIDENCE = 3.0  # standard errors below the log-odds ratio
DRIFT = 0.08  # taken off at every other token
SIGNIFICANT = 0.01  # chance of a passage in harmless text of the same length
CERTAIN = -2.0  # least calibrated score: harmless texts nearly always have this much
IMPOSSIBLE = 30.0  # and the most that counts
STEP, STEPS = 0.25, 64  # of token scores, when their distribution is taken
FILTER = (1 << 22) - 1  # bits of a hash that tell most unknown tokens from those of the model
EULER = 0.5772156649


class Scores:
    """The tokens that score, ascending, and their scores."""

    def __init__(self, known: np.ndarray, value: np.ndarray):
        self.known, self.value = known, value
        self.maybe = np.zeros(FILTER + 1, bool)
        self.maybe[known & np.uint64(FILTER)] = True

    def __reduce__(self):
        return Scores, (self.known, self.value)  # the table is made where it is used


@dataclass
class Tokens:
    hashes: np.ndarray  # a row for whole tokens and one for each beginning
    text: np.ndarray
    counts: np.ndarray

    def scores(self, scored: Scores) -> np.ndarray:
        out = np.full(self.hashes.shape, -DRIFT)
        if len(scored.known):
            # One look into a table leaves few tokens to search for, however large the model is.
            row, column = np.nonzero(scored.maybe[self.hashes & np.uint64(FILTER)])
            own = self.hashes[row, column]
            at = np.minimum(np.searchsorted(scored.known, own), len(scored.known) - 1)
            out[row, column] = np.where(scored.known[at] == own, scored.value[at], -DRIFT)
        return out.max(axis=0)


def tokens(part: pa.Array) -> Tokens:
    data, at = words.raw(part)
    found = words.words(data, at, between=words.NOT_ALPHANUMERIC)
    rows = [found.hash]
    for size, begun in zip(BEGINNINGS, words.with_beginnings(data, found, BEGINNINGS), strict=True):
        longer = found.end - found.start > size
        # A token that is no longer than its beginning counts as a whole only.
        rows.append(np.where(longer, words.mix(begun + np.uint64(size)), found.hash))
    return Tokens(np.array(rows), found.text, found.counts(len(part)))


def candidates(texts: DataFrame) -> np.ndarray:
    """Hashes of tokens and beginnings that enough toxic ``texts(text)`` hold, ascending."""

    def run(batches):
        for batch in batches:
            for _, part in words.slices(batch.column(0)):
                own = tokens(part)
                code, _ = words.distinct(own.hashes.ravel(), np.tile(own.text, len(own.hashes)))
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["token", "n"])

    held = texts.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    often = held.where(F.col("n") >= LEAST_TOXIC).select("token")  # of a bounded number of texts
    return np.sort(often.toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def token_counts(texts: DataFrame, known: np.ndarray) -> np.ndarray:
    """Texts of ``texts(text, half, label)`` that hold each token: half, label, token."""
    size = len(known) + 1

    def run(batches):
        total = np.zeros(4 * size, np.int64)
        for batch in batches:
            group = np.asarray(batch.column(1)) * 2 + np.asarray(batch.column(2))
            for first, part in words.slices(batch.column(0)):
                own = tokens(part)
                at = np.minimum(np.searchsorted(known, own.hashes), len(known) - 1)
                at = np.where(known[at] == own.hashes, at, len(known))
                place = np.unique(own.text.astype(np.int64) * size + at)
                total += np.bincount(group[first + place // size] * size + place % size, minlength=4 * size)
                # The last place holds the number of texts.
                whole = np.bincount(group[first : first + len(part)], minlength=4)
                total[size - 1 :: size] = total[size - 1 :: size] - np.bincount(
                    group[first + place[place % size == size - 1] // size], minlength=4
                ) + whole
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    rows = texts.select("text", "half", "label").mapInArrow(run, "place bigint, n bigint")
    found = rows.groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # four rows for each of the known tokens at most
    out = np.zeros(4 * size)
    out[found["place"]] = found["n"]
    return out.reshape(2, 2, size)


def token_scores(known: np.ndarray, toxic: np.ndarray, harmless: np.ndarray) -> Scores:
    """The tokens that score and their scores, from the texts that hold them (all texts last)."""
    a, b = toxic + PRIOR, harmless + PRIOR
    ratio = np.log(a / a[-1]) - np.log(b / b[-1])
    bound = (ratio - CONFIDENCE * np.sqrt(1 / a + 1 / b))[:-1]
    return Scores(known[bound > 0], bound[bound > 0])


def decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda at which the expectation of e^(lambda s) is 1 in harmless text."""
    if not counts[values > 0].sum():
        return 1.0
    share = counts / counts.sum()
    if share @ values >= 0:
        return 1e-3
    low, high = 0.0, 1.0
    while share @ np.exp(high * values) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * values) < 1 else (low, middle)
    return max(low, 1e-3)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past the last, score), in linear time.

    Each positive token opens a candidate; it is joined with the nearest earlier
    candidate that starts from a lower sum, if it also ends higher than that one.
    """
    sums = np.concatenate([[0.0], np.cumsum(score)])
    held: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    before_of: list[int] = []  # the nearest earlier candidate with a lower sum before it
    for i in np.flatnonzero(score > 0).tolist():
        first, end, low, high = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = before_of[j]
            if j < 0 or held[j][3] >= high:
                held.append((first, end, low, high))
                before_of.append(j)
                break
            first, low = held[j][0], held[j][2]
            del held[j:], before_of[j:]
    return [(a, b, high - low) for a, b, low, high in held]


@dataclass
class Model:
    scores: Scores
    decay: float
    log_k: float
    curve: tuple[float, ...]  # intercept, calibrated score, mass of significant passages

    def calibrated(self, score, n) -> np.ndarray:
        """Score of a best segment in units in which harmless texts follow one Gumbel law."""
        raw = self.decay * score - self.log_k - np.log(np.maximum(n, 1))
        return np.where(np.asarray(score) > 0, np.clip(raw, CERTAIN, IMPOSSIBLE), CERTAIN)

    def bound(self, n: int) -> float:
        """The score from which on a segment of a text of n tokens is significant."""
        return (self.log_k + math.log(max(n, 1)) - math.log(-math.log1p(-SIGNIFICANT))) / self.decay

    def mass(self, totals: list[float], n: int) -> float:
        """What the segments of a text of n tokens score beyond the bound of significance, together."""
        bound = self.bound(n)
        return math.log1p(sum(max(t - bound, 0.0) for t in totals))

    def chances(self, totals: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of segments, each in a harmless text of n tokens."""
        return -np.expm1(-np.exp(np.minimum(-self.calibrated(totals, n), 50)))

    def probability(self, best: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * best + c * mass, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a lightly damped logistic regression, intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grade = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grade)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored(texts: DataFrame, halves: list[Scores]) -> DataFrame:
    """``label, totals, n, seen`` of ``texts(text, label, half)``, each by the scores of the other half.

    ``seen`` counts the positive token scores in steps of ``STEP``.
    """

    names, whole = ["label", "totals", "n", "seen"], pa.int64()

    def run(batches):
        for batch in batches:
            label, half = (np.asarray(batch.column(i)) for i in (1, 2))
            for first, part in words.slices(batch.column(0)):
                own = tokens(part)
                ends, both = np.cumsum(own.counts), [own.scores(s) for s in halves]
                rows = []
                for i, (end, n) in enumerate(zip(ends.tolist(), own.counts.tolist(), strict=True)):
                    score = both[1 - half[first + i]][end - n : end]
                    totals = [t for _, _, t in segments(score)]
                    steps = np.minimum(score[score > 0] / STEP, STEPS - 1).astype(np.int64)
                    rows.append((int(label[first + i]), totals, n, np.bincount(steps, minlength=STEPS).tolist()))
                columns = [
                    pa.array(list(c), kind)
                    for c, kind in zip(zip(*rows, strict=True), (whole, pa.list_(pa.float64()), whole, pa.list_(whole)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("text", "label", "half").mapInArrow(run, "label bigint, totals array<double>, n bigint, seen array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from ``labels(doc_id, <label>)``; the caller has left out what must not be learnt."""
    clean = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("bigint").alias("label")).distinct()
    sample = labelled.sample_ids(clean, max_labelled, "toxicity")
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("bigint")
    texts = labelled.texts_of(docs, sample).select("text", "label", half.alias("half")).repartition(
        docs.sparkSession.sparkContext.defaultParallelism
    )
    known = candidates(texts.where("label = 1"))
    counts = token_counts(texts, known) if len(known) else np.zeros((2, 2, 1))
    both = counts.sum(axis=0)
    model = Model(token_scores(known, both[1], both[0]), 1.0, 0.0, (-40.0, 0.0, 0.0))
    if not len(known) or not both[0, -1]:
        return model
    # At most max_labelled rows.
    rows = _scored(texts, [token_scores(known, toxic, harmless) for harmless, toxic in counts]).toPandas()
    label, n = (rows[c].to_numpy(float) for c in ("label", "n"))
    top = np.array([max(t, default=0.0) for t in rows["totals"]])
    seen = np.stack(rows["seen"].to_numpy())[label == 0].sum(axis=0)
    values = np.r_[-DRIFT, (np.arange(STEPS) + 0.5) * STEP]
    model.decay = decay(values, np.r_[max(n[label == 0].sum() - seen.sum(), 1), seen])
    harmless = (label == 0) & (top > 0)
    if harmless.any():
        model.log_k = float((model.decay * top - np.log(np.maximum(n, 1)))[harmless].mean() - EULER)
    best = model.calibrated(top, n)
    mass = np.array([model.mass(t, k) for t, k in zip(rows["totals"], n, strict=True)])
    model.curve = tuple(float(v) for v in logistic(np.column_stack([best, mass]), label))
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` of each row; a passage has its first token, length, score and chance."""
    schema = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    passage = pa.struct([("first", pa.int32()), ("tokens", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])
    given = docs.sparkSession.sparkContext.broadcast(model)  # its tokens come from a bounded number of texts

    def run(batches):
        own_model = given.value
        for batch in batches:
            for first, part in words.slices(batch.column(1)):
                own = tokens(part)
                score = own.scores(own_model.scores)
                some = np.flatnonzero(np.bincount(own.text, score > 0, minlength=len(part)))
                ends = np.cumsum(own.counts)
                top, mass = np.zeros(len(part)), np.zeros(len(part))
                place, spans = [], []
                for i in some.tolist():
                    n = int(own.counts[i])
                    each = segments(score[ends[i] - n : ends[i]])
                    totals = [t for _, _, t in each]
                    top[i], mass[i] = max(totals), own_model.mass(totals, n)
                    # Calibration is the same order as the score, so the bound finds the significant ones; rounding has the last word below.
                    least = own_model.bound(n) - 1e-6
                    far = [s for s in each if s[2] >= least]
                    spans += far
                    place += [i] * len(far)
                best = own_model.calibrated(top, own.counts)
                place, totals = np.array(place, np.int64), np.array([t for _, _, t in spans])
                chance = own_model.chances(totals, own.counts[place])
                found = [[] for _ in range(len(part))]
                for i, (a, b, total), p in zip(place.tolist(), spans, chance.tolist(), strict=True):
                    if p <= SIGNIFICANT:
                        found[i].append({"first": a, "tokens": b - a, "score": total, "chance": p})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array(own_model.probability(best, mass)),
                        pa.array(found, pa.list_(passage)),
                    ],
                    ["doc_id", "score", "passages"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {schema}, score double, "
        "passages array<struct<first: int, tokens: int, score: double, chance: double>>",
    )
