"""Mixing of sources to target weights by repeating whole documents.

Only built-in column functions are used.  Tokens are summed per source, the
sums give a rate of repetition, and each document is taken floor(rate) times
plus once more with the probability of the fraction, decided by a hash of its
id, so that reruns agree and no document needs to know another.

The sources in code point order (null last) weigh 1, 2, 3 and again; they
share all tokens by weight.  A target stops at ``MAX_RATE`` times its source,
and the excess is shared among the others by weight until none is above.

Defined cases: a null text has no words; null is a source of its own; a source
without words has target 0 and gives no copies; rows with one ``doc_id`` (null
included) have the same fate; an empty table gives an empty table; further
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordering import with_position
from siltstone.session import durable

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"
BROADCAST_SOURCES = 10_000  # more sources than this meet their documents by a salted shuffle
SALTS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def unit_hash(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the id: 52 bits of SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> tuple[DataFrame, int]:
    """``source, source_size, target`` of each source in ``sizes(source, size)``, and their number.

    Only the number of sources and sums over them come to the driver; a round
    is one aggregate over the small table of sources.
    """
    totals = durable(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    named = with_position(totals.where("source IS NOT NULL"), "source")
    count = totals.count()
    unnamed = totals.where("source IS NULL").withColumn("position", F.lit(count - 1).cast("bigint"))
    turn = F.pmod(F.col("position"), F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*(F.lit(int(w)).cast("bigint") for w in weights)), turn)
    sources = durable(named.unionByName(unnamed).withColumn("weight", weight).drop("position"))
    most = F.col("source_size") * max_rate
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    above, level, known = F.lit(False), 0.0, -1
    while True:
        held, share, full = sources.agg(
            F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        rest, share = whole - (held or 0), share or 0
        if full == known or not share:
            break
        known, level = full, rest / share
        # Exact: rest * weight / share > most, in whole numbers.
        over = F.lit(rest).cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
        above = over > most.cast("decimal(19,0)") * F.lit(share).cast("decimal(19,0)")
    target = F.when(above, most.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target")), count


def with_copies(rows: DataFrame, sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``rows`` (with doc_id and source) with ``source_size``, ``target`` and ``copies``.

    ``sizes(source, size)`` holds the words of each row and may be a narrower,
    written form of ``rows``.
    """
    targets, count = source_targets(sizes, weights, max_rate)
    targets = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if count <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(targets), same)
    else:  # one source may hold a third of all documents
        salted = targets.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
        left = rows.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        joined = left.join(salted, same & (F.col("_deal") == F.col("_salt"))).drop("_deal", "_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(unit_hash(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("bigint")).drop("_source")


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of all documents, written once."""
    return durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: every column of ``docs``, each row as often as it is taken."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    taken = with_copies(rows, document_sizes(docs), weights, max_rate, seed).where("copies > 0")
    times = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return taken.select("_row", F.explode(times).alias("_copy")).select("_row.*")
