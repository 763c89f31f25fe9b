"""Removal of lines that many documents share, decided by bitmaps of kept lines.

Only built-in column functions are used.  Hashes of line keys are range
partitioned together with the document, so that a key held by a large part of
all documents spans many partitions, and sorted by document and position within
it.  Each partition streams its rows once and passes on the first occurrence of
a key in a document; counts per key are pre-aggregated from these.

A key is the line without white space (space, U+0009 to U+000D) at both ends
and with A-Z in lower case.  Defined cases: a null text is an empty one; an
empty text is one empty line; rows with one ``doc_id`` are one document when
documents are counted, but each row has its own bitmap; a row without
``doc_id`` holds no keys and keeps all lines; an empty table gives an empty
table; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import durable

MIN_CHARS = 20  # shorter keys are never dropped
MIN_DOCS = 3  # a key found in fewer documents stays
BLANKS = " \t\n\x0b\x0c\r"
WORD = 64  # lines per word of a bitmap
KEY = ("_h1", "_h2")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    folded = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    # lower() changes letters beyond A-Z too, so it serves plain ASCII only.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(folded)


def _identity(text: Column) -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a key of enough code points: hashes, document, text identity, position."""
    # In a step of its own, so that the whole text is hashed once, not for each line.
    whole = docs.where("doc_id IS NOT NULL").select("doc_id", _identity(F.col("text")).alias("_text"), lines_of(F.col("text")).alias("_lines"))
    split = whole.select("doc_id", "_text", F.posexplode("_lines").alias("pos", "line"))
    keyed = split.select("doc_id", "_text", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("_h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("_h2"), "doc_id", "_text", "pos"
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the rows that lose lines: ``doc_id, _text, n_dropped, keep``.

    ``keep`` maps the number of a run of 64 lines to its bits, the lowest bit
    for its first line.  Runs that keep all lines are left out, and so are
    rows that do.
    """
    rows = durable(line_rows(docs, min_chars))
    ordered = rows.repartitionByRange(*KEY, "doc_id").sortWithinPartitions(*KEY, "doc_id", "_text", "pos")
    inside = Window.partitionBy(*KEY, "doc_id").orderBy("_text", "pos")
    first = ordered.withColumn("_n", F.row_number().over(inside)).where("_n = 1")
    shared = first.groupBy(*KEY).agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_last"))
    shared = durable(shared.where(F.col("_docs") >= min_docs).drop("_docs"))
    dropped = rows.join(shared, list(KEY)).where(F.col("doc_id") < F.col("_last"))
    run = F.floor(F.col("pos") / WORD).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % WORD))
    runs = dropped.groupBy("doc_id", "_text", run.alias("run")).agg(bits.alias("bits"))
    return runs.groupBy("doc_id", "_text").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("run", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The text with the lines whose bit is set; all of it where ``keep`` is null."""

    def stays(_, i):
        bits = F.coalesce(F.try_element_at(keep, F.floor(i / WORD).cast("int")), F.lit(-1).cast("bigint"))
        return F.call_function("shiftrightunsigned", bits, i % WORD).bitwiseAND(F.lit(1).cast("bigint")) == 1

    whole = F.coalesce(text, F.lit(""))
    return F.when(keep.isNull(), whole).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text that stays, and ``n_lines`` (before) and ``n_dropped`` at the end.

    Existing columns of these two names are replaced.
    """
    found = keep_bitmaps(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_doc"), "_text", "keep", F.col("n_dropped").alias("_dropped")
    )
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_own", _identity(F.col("_row.text")))
    # Bitmaps are small and distinct, so they are the hashed side and the texts stream by unsorted.
    joined = rows.join(
        found.hint("shuffle_hash"), (F.col("_row.doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_text")), "left"
    )
    text = F.col("_row.text")
    columns = [
        kept_text(text, F.col("keep")).alias(c) if c == "text" else F.col("_row")[c].alias(c)
        for c in docs.columns
        if c not in ("n_lines", "n_dropped")
    ]
    return joined.select(
        *columns,
        F.size(lines_of(text)).cast("bigint").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )
