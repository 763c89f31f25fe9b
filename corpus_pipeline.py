"""A training corpus in five stages, each one operator over all that its predecessor kept.

Low-quality documents go, lines that many documents share go, one document of
each group of near duplicates stays (the one of the smallest id), sources are
mixed to target weights by repeating documents, and the mix is encoded.

Defined cases: null and empty texts are scored, split, mixed and encoded like
others (they are no one's near duplicates); rows without ``doc_id`` go through
every stage on their own; of rows that repeat a ``doc_id`` all stay or go
together where near duplicates go, so equal rows of one id both stay; ties need
no rule but that the smallest id of a group stays; an empty table gives an empty
table; further columns, whatever their names, are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import labelled, line_dedup, mixing, ngram_join, quality
from siltstone.llm.queries import THRESHOLD, coded_digests
from siltstone.plans.fixture import table
from siltstone.session import discard, durable


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough; the labels outside the held-out fold are learnt from."""
    learnable = labelled.fold(F.col("doc_id"), 5) != 0
    labels = table(spark, sf_dir, "labels").where(learnable)
    network, _ = quality.fit(docs, labels, learnable=learnable)
    # Columns travel under names that no table has, so that none can be called as the score is.
    inner = {c: c if c == "text" else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    scored = quality.score_texts(docs.select(*(F.col(c).alias(i) for c, i in inner.items())), network, tuple(inner.values()))
    return scored.where(F.col("score") >= THRESHOLD).select(*(F.col(i).alias(c) for c, i in inner.items()))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_shared_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; documents without words or id stay."""
    groups = ngram_join.similar_components(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of the mix."""
    return coded_digests(docs).drop("mismatches")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the encoding


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
