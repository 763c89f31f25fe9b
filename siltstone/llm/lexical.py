"""Ranked lexical search of many items at once, with their common parts evaluated once.

A term is a run of ASCII letters, digits and bytes beyond ASCII, only A-Z lower-cased.
A document's score for an item is a sum over the item's terms, so what items
have in common can be summed once for all of them.  Shared term sets are mined
among the items: terms that occur in the same items are one leaf, and two
neighbours in the common order of leaves (frequent first) that stay neighbours
in two items or more become one node, round by round, until no two do.  The
result is a graph of nodes in which each item is the sum of a few.

The documents are read once for a block of items: each becomes its number of
terms and its postings among the block's terms, from which the statistics of
the corpus are counted by Spark.  Then each task makes the accumulators of its
documents, a leaf after its terms, a node after its two parts and an item after
its nodes, slice by slice, and hands on its best documents of each item; the
best of all tasks are the result.  No row stands for a pair of item and document.

Items are dealt into blocks of a bounded number of terms, so that what is sent
to the tasks is bounded however many items there are.  Terms are told apart by
64-bit hashes.

Defined cases: null and empty texts have no terms, match nothing and count
nowhere; an item without terms has no rows; rows of one ``item_id`` are one item
with the terms of all; a null id is an id like others, last in ties; each row
of the documents is a document, whatever repeats; equal scores go by ascending
``doc_id``; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import words
from siltstone.session import discard, durable

BEST = 10
BLOCK_TERMS = 1 << 18  # terms of a block's items, each as often as items hold it
CELLS = 1 << 21  # accumulators that a task has at a time


# ---------------------------------------------------------------- terms of items and documents


def _terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and their texts."""
    data, at = words.raw(part)
    found = words.words(data, at, between=words.NOT_ALPHANUMERIC)
    return found.hash.view(np.int64), found.text


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item, terms``: the distinct terms of each item that has any."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, part in words.slices(batch.column(1)):
                code, of = words.distinct(_terms(part)[0].view(np.uint64), _terms(part)[1])
                ids = batch.column(0).slice(first, len(part)).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([ids, pa.array(code)], ["item", "term"])

    each = items.select(key, text).mapInArrow(run, f"item {kind}, term bigint")
    return each.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def postings(docs: DataFrame, vocabulary: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc, n, terms, counts`` of each document with a term: how many it has, and which of the sorted ``vocabulary`` how often."""
    kind = docs.schema[key].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        wanted = shipped.value
        for batch in batches:
            for first, part in words.slices(batch.column(1)):
                code, of = _terms(part)
                n = np.bincount(of, minlength=len(part))
                at = np.searchsorted(wanted, code)
                hit = wanted[np.minimum(at, len(wanted) - 1)] == code if len(wanted) else np.zeros(len(code), bool)
                pair, count = np.unique(of[hit] * (len(wanted) + 1) + at[hit], return_counts=True)
                of, term = np.divmod(pair, len(wanted) + 1)
                some = np.flatnonzero(n)
                ends = pa.array(np.searchsorted(of, np.r_[some, len(part)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32))) for values in (term, count)]
                ids = batch.column(0).slice(first, len(part)).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[some]), *lists], ["doc", "n", "terms", "counts"])

    return docs.select(key, text).mapInArrow(run, f"doc {kind}, n bigint, terms array<int>, counts array<int>")


# ---------------------------------------------------------------- common parts of items


@dataclass
class Plan:
    """How a block's items are summed: leaves by term, nodes by two earlier ones, items by nodes."""

    leaf_of: np.ndarray  # of each term
    leaves: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # nodes, and the two parts of each
    nodes: int
    parts: np.ndarray  # nodes of all items, one item after another
    begins: np.ndarray  # where each item's begin

    def additions(self) -> int:
        """Sums per document, where the items alone would need one for each of their terms."""
        return len(self.leaf_of) + sum(len(own) for own, _, _ in self.levels) + len(self.parts)


def shared_sets(items: list[np.ndarray], terms: int) -> Plan:
    """Mine what the items, given by the numbers of their terms, have in common."""
    holders: list[list[int]] = [[] for _ in range(terms)]
    for i, own in enumerate(items):
        for term in own.tolist():
            holders[term].append(i)
    leaf_of_set: dict[tuple[int, ...], int] = {}
    by_frequency = sorted(range(terms), key=lambda t: (-len(holders[t]), holders[t]))
    leaf_of = np.zeros(terms, np.int64)
    for term in by_frequency:
        leaf_of[term] = leaf_of_set.setdefault(tuple(holders[term]), len(leaf_of_set))
    # Leaves are numbered by falling frequency, so that what is common to many items stands together in each.
    sequences = [np.unique(leaf_of[own]).tolist() for own in items]
    nodes, parts_of, depth = len(leaf_of_set), {}, {}
    while True:
        pairs = Counter(pair for own in sequences for pair in zip(own, own[1:]))
        common = {pair for pair, count in pairs.items() if count > 1}
        if not common:
            break
        made: dict[tuple[int, int], int] = {}
        for own in sequences:
            # Of neighbouring pairs the more frequent goes first, the left one of equals.
            taken = [False] * len(own)
            chosen = []
            for i in sorted((i for i in range(len(own) - 1) if (own[i], own[i + 1]) in common), key=lambda i: (-pairs[own[i], own[i + 1]], i)):
                if not taken[i] and not taken[i + 1]:
                    taken[i] = taken[i + 1] = True
                    chosen.append(i)
            for i in sorted(chosen, reverse=True):
                pair = (own[i], own[i + 1])
                if pair not in made:
                    made[pair] = nodes
                    parts_of[nodes] = pair
                    depth[nodes] = 1 + max(depth.get(p, 0) for p in pair)
                    nodes += 1
                own[i : i + 2] = [made[pair]]
    levels = []
    for level in range(1, max(depth.values(), default=0) + 1):
        own = [k for k in depth if depth[k] == level]
        both = np.array([parts_of[k] for k in own], np.int64)
        levels.append((np.array(own, np.int64), both[:, 0], both[:, 1]))
    sizes = [len(own) for own in sequences]
    flat = np.array([k for own in sequences for k in own], np.int64)
    return Plan(leaf_of, len(leaf_of_set), levels, nodes, flat, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64))


# ---------------------------------------------------------------- scores


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _scores(plan: Plan, weight: np.ndarray, total: int, documents: int, n: np.ndarray, of: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores of items (rows) and documents (columns), in whole numbers throughout."""
    m = 100 - 90 + (90 * n * documents) // total
    partial = weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[of]))
    sums = np.zeros((plan.nodes, len(n)), np.int64)
    np.add.at(sums, (plan.leaf_of[term], of), partial)
    for own, left, right in plan.levels:
        sums[own] = sums[left] + sums[right]
    return np.add.reduceat(sums[plan.parts], plan.begins, axis=0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place and score of the k best columns of each row (all that tie with the last are kept)."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        item, at = np.nonzero((scores >= np.maximum(least, 1)[:, None]))
    else:
        item, at = np.nonzero(scores > 0)
    order = np.lexsort((ids[at], -scores[item, at], item))
    item, at = item[order], at[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return item[rank < k], at[rank < k], scores[item, at][rank < k]


def _search_block(docs: DataFrame, block: list, best: int, text: str, key: str) -> DataFrame:
    """``item, doc, score`` of the best documents of a block's items in each task."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in block]))
    held = durable(postings(docs, vocabulary, text, key))
    stats = held.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
        frequency[r.term] = r["count"]
    weight = np.array([term_weight(stats.documents, int(f)) for f in frequency], np.int64)
    plan = shared_sets([np.searchsorted(vocabulary, np.array(r.terms, np.int64)) for r in block], len(vocabulary))
    kind, doc_kind = "int", held.schema["doc"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast((plan, weight, stats.total, stats.documents))
    width = max(1, CELLS // max(1, plan.nodes + len(plan.parts)))

    def run(batches):
        plan, weight, total, documents = shipped.value
        item, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            for first in range(0, len(batch), width):
                part = batch.slice(first, width)
                n = part.column("n").to_numpy()
                size = part.column("terms").value_lengths().to_numpy()
                of = np.repeat(np.arange(len(n)), size)
                term, count = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                found = _scores(plan, weight, total, documents, n, of, term, count)
                # Ids of any type are ranked here by their order; null is last.
                order = np.argsort(_places(part.column("doc")), kind="stable")
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n))
                new_item, at, new_score = _best(found, place, best)
                own = part.column("doc").take(pa.array(at))
                ids = own if ids is None else pa.concat_arrays([ids, own])
                item, score = np.r_[item, new_item], np.r_[score, new_score]
                if len(item) > 4 * best * len(plan.begins):
                    item, score, ids = _trimmed(item, score, ids, best)
        if ids is not None and len(item):
            item, score, ids = _trimmed(item, score, ids, best)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(score)], ["item", "doc", "score"])

    return held.mapInArrow(run, f"item {kind}, doc {doc_kind}, score bigint")


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order; null is last and equals share a place."""
    order = ids.dictionary_encode()
    ranks = pa.compute.rank(order.dictionary, sort_keys="ascending", tiebreaker="dense")
    return pa.compute.fill_null(ranks.take(order.indices), len(ids) + 1).to_numpy().astype(np.int64)


def _trimmed(item: np.ndarray, score: np.ndarray, ids: pa.Array, best: int):
    order = np.lexsort((_places(ids), -score, item))
    item, score = item[order], score[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < best
    return item[keep], score[keep], ids.take(pa.array(order[keep]))


def search(docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``best`` documents of each item."""
    wanted = durable(item_terms(items, text, item_key))
    held = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(held / BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for k in range(blocks):
        block = wanted.where(block_of == k).orderBy("item").collect()  # bounded by the number of blocks
        if not block:
            continue
        own = _search_block(docs, block, best, text, doc_key)
        names = docs.sparkSession.createDataFrame([(i, r.item) for i, r in enumerate(block)], f"item int, _id {wanted.schema['item'].dataType.simpleString()}")
        in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        own = own.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= best)
        own = own.join(F.broadcast(names), "item")  # a row for each item of the block
        own = own.select(F.col("_id").alias(item_key), "rank", F.col("doc").alias(doc_key), "score")
        found = own if found is None else found.unionByName(own)
    discard(wanted)
    if found is None:
        kinds = (wanted.schema["item"].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString())
        return docs.sparkSession.createDataFrame([], f"{item_key} {kinds[0]}, rank int, {doc_key} {kinds[1]}, score bigint")
    return found
