"""Bounded samples of rows for fitting, and folds of documents by their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def sample_ids(rows: DataFrame, limit: int, seed: str) -> DataFrame:
    """At most ``limit`` rows with a ``doc_id``, the first in the order of a hash of it.

    Every row is considered, so the sample does not depend on files or tasks.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return rows.where("doc_id IS NOT NULL").orderBy(order, *rows.columns).limit(limit)


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The texts of a sample: its rows are few by construction, so they go to the documents."""
    own = sample.select(F.col("doc_id").alias("_id"), *(c for c in sample.columns if c != "doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).drop("_id")
