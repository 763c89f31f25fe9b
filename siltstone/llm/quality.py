"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learnt from.  The
share of positives in the unlabelled text is estimated first: of the scores of
a plain positive-against-unlabelled model, the upper tail of the unlabelled
text over that of the positives is at least that share, and nearly equals it
where few negatives are left.  Then a small network minimises the non-negative
unbiased risk, prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)); where the second term goes below zero, its gradient is turned,
so that the network cannot gain by fitting single unlabelled rows.

Only the fit uses bounded samples (``MAX_POSITIVE``, ``MAX_UNLABELLED`` rows, a
fixed choice by hash); every text is scored whole.

Defined cases: null and empty texts have the score of a text without any byte;
labels without a class are left out; with no positive label every score is 0.5;
rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import labelled, textstats, words

MAX_POSITIVE = 5_000
MAX_UNLABELLED = 10_000
HIDDEN = 16
ROUNDS = 250
RATE = 0.015
DAMPING = 1e-4
TOLERATED = 0.0  # how far below zero the negative risk may go
SEED = 7
SURENESS = 0.1  # chance with which the bounds of the prior may fail


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    """One hidden layer over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.scale, -8, 8)

    def probability_of(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(x) @ self.weights[2] + self.weights[3])

    def probability(self, features: np.ndarray) -> np.ndarray:
        return self.probability_of(self.standard(features)) if self.weights else np.full(len(features), 0.5)

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of a sum over rows whose outputs have these slopes."""
        h = self.hidden(x)
        slope = slope.astype(np.float32)
        back = slope[:, None] * self.weights[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ slope, np.array(slope.sum())]


def _train(centre, scale, step) -> Network:
    """Adam over the gradient that ``step(network)`` gives for the whole sample."""
    random = np.random.default_rng(SEED)
    net = Network(centre, scale)
    width = len(centre)
    net.weights = [
        random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())
    ]
    net.weights = [w.astype(np.float32) for w in net.weights]
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, ROUNDS + 1):
        grads = step(net)
        for i, g in enumerate(grads):
            g = g + DAMPING * net.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled rows, from the scores of both in a model not fitted to them."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    slack = np.sqrt(np.log(4 / SURENESS) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def fit_features(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network, float]:
    """The network and the class prior it was fitted with."""
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    centre, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.clip((x - centre) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))

    def plain(rows_p, rows_u):
        def step(net):
            a, b = net.probability_of(rows_p), net.probability_of(rows_u)
            one, two = net.gradient(rows_p, (a - 1) / len(rows_p)), net.gradient(rows_u, b / len(rows_u))
            return [(x + y) / 2 for x, y in zip(one, two, strict=True)]

        return step

    first = _train(centre, scale, plain(p[::2], u[::2]))
    prior = class_prior(first.probability_of(p[1::2]), first.probability_of(u[1::2]))

    def non_negative(net):
        a, b = net.probability_of(p), net.probability_of(u)
        risk = -np.log1p(-np.minimum(b, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(a, 1 - 1e-12)).mean()
        minus_u, minus_p = net.gradient(u, b / len(u)), net.gradient(p, -prior * a / len(p))
        negative = [x + y for x, y in zip(minus_u, minus_p, strict=True)]
        if risk < -TOLERATED:
            return [-g for g in negative]
        plus = net.gradient(p, prior * (a - 1) / len(p))
        return [x + y for x, y in zip(plus, negative, strict=True)]

    return _train(centre, scale, non_negative), prior


def _features(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, part in words.slices(batch.column(0)):
                rows = pa.array(textstats.features(part).ravel(), pa.float32())
                lists = pa.FixedSizeListArray.from_arrays(rows, textstats.FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(part)), lists], ["positive", "features"])

    return texts.select("text", "positive").mapInArrow(run, "positive boolean, features array<float>")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    learnable=None,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> tuple[Network, float]:
    """A network from ``labels(doc_id, <label>)``; ``learnable`` is a condition on documents for the unlabelled rows."""
    trusted = labels.where(F.col(label) == 1).select("doc_id").distinct()
    web = docs.select("doc_id") if learnable is None else docs.where(learnable).select("doc_id")
    chosen = [
        labelled.sample_ids(trusted, max_positive, "positive").withColumn("positive", F.lit(True)),
        labelled.sample_ids(web, max_unlabelled, "unlabelled").withColumn("positive", F.lit(False)),
    ]
    texts = labelled.texts_of(docs, chosen[0].unionByName(chosen[1]))
    rows = _features(texts.repartition(docs.sparkSession.sparkContext.defaultParallelism))
    # At most max_positive + max_unlabelled rows of FEATURES numbers; ordered, so that fits repeat.
    rows = rows.toPandas()
    if not len(rows) or not rows["positive"].any():
        return Network(np.zeros(textstats.FEATURES), np.ones(textstats.FEATURES)), 0.5
    matrix, positive = np.stack(rows["features"].to_numpy()), rows["positive"].to_numpy(bool)
    order = np.lexsort(matrix.T)
    matrix, positive = matrix[order], positive[order]
    return fit_features(matrix[positive], matrix[~positive])


def score_texts(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the ``score`` of each row."""
    given = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        own = given.value
        for batch in batches:
            for first, part in words.slices(batch.column(at)):
                score = pa.array(own.probability(textstats.features(part)).astype(np.float64))
                kept = [c.slice(first, len(part)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, score], [*keep, "score"])

    columns = keep if "text" in keep else (*keep, "text")
    return docs.select(*columns).mapInArrow(run, f"{schema}, score double")
