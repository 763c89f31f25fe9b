"""Token counts against the libraries, and ranked search against brute force."""

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pytest
from conftest import SMALLEST
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import lexical, oracles, queries, token_counts
from siltstone.plans.fixture import table

WORDS = queries.vocabulary("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n", "a\x1cb\x00\x07", "It's 'tis WE'LL 12345 ½²", "<|endoftext|>x<|startoftext|> <|END <|endoftext|", "ΣΑΣ İstanbul",
    "ä ̈ 가", "日本語テキスト", "foo\x85bar\xa0baz　q", "''''s", "🙂👨‍👩‍👧", "﻿", "é" * 3000, "xY" * 30_000, "▁a▁▁b  c",
]


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(own.encode(text))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    path = queries.vocabulary(name)
    signs = random.Random(3)
    ranges = [(32, 127), (0x80, 0x300), (0x300, 0xD800), (0xE000, 0x30000), (32, 33)]
    made = ["".join(chr(signs.randrange(*signs.choice(ranges))) for _ in range(50)) for _ in range(300)]
    texts = ODD + made + [r.text for r in table(spark, SMALLEST, "documents").collect()]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "two words", 0, 0), (0, "again", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, n_bytes int").repartition(3)
    counted = token_counts.count_tokens(frame, path)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"]
    count = library(path)
    wanted = sorted(((i, len((t or "").encode()), count(t or "")) for i, t, _, _ in rows), key=str)
    assert sorted(map(tuple, counted.collect()), key=str) == wanted
    assert token_counts.count_tokens(frame.limit(0), path).collect() == []


def test_proof_holds_and_leaves_out_what_merges_otherwise():
    stated = token_counts.WordVocabulary(WORDS)
    proven = stated.proven()
    count = library(WORDS)
    assert 30_000 < len(proven) < len(stated.vocabulary)
    # Every string that can stand as a word of small letters is one token of the library if and only if it is proven.
    plain = [v.removesuffix("</w>") for v in stated.vocabulary if re.fullmatch("[a-z]+</w>", v)]
    assert all((count(p) == 1) == (p in proven) for p in plain)


def test_long_and_short_merges_agree():
    stated = token_counts.WordVocabulary(WORDS)
    letters = random.Random(5)
    for size in (1, 2, 17, 48, 49, 300):
        symbols = stated.symbols("".join(letters.choice("etaoinsh") for _ in range(size)))
        agenda = token_counts.merged_length(symbols + [" "] * 49, stated.ranks) - 49  # long enough for the agenda
        assert agenda == token_counts._short_merged_length(symbols, stated.ranks)


# ---------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    documents, total = len(bags), sum(sum(b.values()) for _, b in bags)
    frequency = Counter(t for _, b in bags for t in b)
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms_of(t))
    rows = []
    for item, terms in merged.items():
        scored = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * documents // total
            score = sum(
                floor(1000 * log((2 * documents + 2) / (2 * frequency[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if t in bag
            )
            scored.append((-score, doc is None, doc or 0, doc, score))
        ranked = [s for s in sorted(scored, key=lambda s: s[:3]) if s[4] > 0][:best]
        rows += [(item, k + 1, s[3], s[4]) for k, s in enumerate(ranked)]
    return sorted(rows, key=str)


DOCS = [(i, " ".join(random.Random(i).choices("the cat Sat on a MAT with größe two-fold x_y z9".split(), k=1 + i % 40))) for i in range(300)]
DOCS += [(None, "cat mat"), (300, None), (301, ""), (302, "..."), (303, "cat " * 50_000 + "sat"), (7, "repeated id cat"), (900, "mat cat"), (901, "mat cat")]
ITEMS = [(1, "the cat sat"), (2, "The CAT sat on a mat"), (3, "größe GRÖSSE x y"), (4, None), (5, "unknown words"), (None, "cat mat"), (2, "z9"),
         (6, "--"), (7, "cat sat on a mat with the fold"), (8, "the the two")]


@pytest.mark.parametrize("cells, terms", [(lexical.CELLS, lexical.BLOCK_TERMS), (50, 6)])
def test_search_equals_brute_force(spark, monkeypatch, cells, terms):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)  # several blocks of items
    docs = spark.createDataFrame([(*d, 5, 6) for d in DOCS], "doc_id bigint, text string, score int, item int").repartition(4)
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], "item_id bigint, text string, doc_id int")
    found = lexical.search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(DOCS, ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALLEST}/{name}.parquet'")
    found = queries.op12_lexical_search(spark, SMALLEST)
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(oracles.ORACLES["op12_lexical_search"]).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12), st.integers(0, 2**32))
def test_common_parts_give_the_same_sums(sets, seed):
    own = np.unique(np.array([t for s in sets for t in s]))
    items = [np.searchsorted(own, np.array(sorted(s))) for s in sets]
    plan = lexical.shared_sets(items, len(own))
    partial = np.random.default_rng(seed).integers(0, 10**10, size=len(own))
    sums = np.zeros((plan.nodes, 1), np.int64)
    np.add.at(sums, (plan.leaf_of, 0), partial)
    for nodes, left, right in plan.levels:
        sums[nodes] = sums[left] + sums[right]
    got = np.add.reduceat(sums[plan.parts], plan.begins, axis=0)[:, 0]
    assert got.tolist() == [int(partial[i].sum()) for i in items]


def test_common_parts_are_summed_once():
    common = list(range(40))
    items = [np.array(common + [40 + i]) for i in range(50)]
    plan = lexical.shared_sets(items, 90)
    assert plan.leaves == 51 and plan.additions() <= 90 + 2 * 50  # not 50 * 41
