"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import (
    content, labelled, lexical, line_dedup, mixing, neighbours, ngram_join, outliers, pieces, quality, token_counts, toxicity, warc, whitening,
)
from siltstone.plans.fixture import table
from siltstone.session import run_folder

THRESHOLD = 0.3  # scores from here on count as label 1
TOKEN_LIMIT = 2048  # a document of more tokens is over the limit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public vocabulary file, which every executor has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark, sf_dir):
    return outliers.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op3_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnable = labelled.fold(F.col("doc_id"), 5) != 0
    network, _ = quality.fit(docs, labels.where(learnable), learnable=learnable)
    return quality.score_texts(docs, network).select(
        "doc_id",
        (labelled.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_html_extraction(spark, sf_dir):
    texts = content.extract_content(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(labelled.fold(F.col("doc_id"), 4) != 2))
    return toxicity.score_texts(docs, model).select(
        "doc_id",
        (labelled.fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query
def op6_warc(spark, sf_dir):
    warc.register(spark)
    rows = warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html", extra=("url",))
    revisit = F.col("first").isNotNull()
    folder = run_folder(spark, "warc")
    rows.select(
        F.concat(F.lit("urn:page:"), F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("urn:page:"), F.col("first")).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.col("bytes").cast("bigint").alias("payload_bytes"),
        F.col("_payload").cast("binary").alias("payload"),
    ).write.format("warc").mode("append").save(folder)
    records = spark.read.format("warc").option("payload", "false").option("verify", "true").load(folder)
    number = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).cast("bigint")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


@query
def op7_mix_sources(spark, sf_dir):
    sizes = mixing.document_sizes(table(spark, sf_dir, "documents"))
    return mixing.with_copies(sizes, sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def coded_digests(docs: DataFrame) -> DataFrame:
    coded = pieces.encode_texts(docs, vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "mismatches",
    )


@query
def op9_sentencepiece(spark, sf_dir):
    return coded_digests(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
