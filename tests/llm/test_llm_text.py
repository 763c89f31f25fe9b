"""Operators on texts against brute force, on texts chosen for their edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import (
    labelled,
    line_dedup,
    mixing,
    ngram_join,
    outliers,
    pieces,
    quality,
    queries,
    textstats,
    toxicity,
    words,
)
from siltstone.llm.oracles import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Further columns whose names the operators use themselves.
CLASHING = ("n", "h1", "h2", "tag", "pos", "line", "size", "copies", "keep", "n_lines", "score", "_row")


def odd_texts():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É x", "Straße", "İI", " ", "a\x0bb", "#*", "<|>"]
    base = [" ".join(random.choices(vocabulary, k=n)) for n in (3, 4, 5, 40, 90, 300)]
    shared = "A shared line that is longer than twenty signs"
    texts = [None, "", " ", "\n", "\n\n", "one", "a b c", "A B C", " \t\x0b\x0c\r", "x" * 500_000, "ab " * 30_000]
    texts += base + base[:3] + [base[5].upper(), base[5] + " tail", base[4] + "\n" + shared]
    for i in range(14):
        own = base[5].split()
        for _ in range(i % 7):
            own[random.randrange(len(own))] = f"n{random.randrange(99)}"
        texts.append(" ".join(own))
    texts += [f"{shared} \n  {shared.lower()}\t\nown {i}" for i in range(4)]
    texts += ["#### symbols *** $$$ | | <b> & " * 12, "dup\ndup\n\n\ndup\nx y z x y z"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "B", "a"][i % 4], None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(docs, sql):
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    cursor = connection.execute(sql)
    return [c[0] for c in cursor.description], sorted(cursor.fetchall())


def rows_of(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


# -- words -------------------------------------------------------------------


def test_words_lines_and_shingles():
    texts = [t or "" for t in odd_texts()]
    for first, part in words.slices(pa.array(texts), limit=4096):
        data, at = words.raw(part)
        found = words.words(data, at, fold=False)
        wanted = [(i, w) for i, t in enumerate(part.to_pylist()) for w in WORD.findall(t)]
        got = [(int(t), bytes(data[s:e]).decode()) for t, s, e in zip(found.text, found.start, found.end, strict=True)]
        assert got == wanted
        by_hash = defaultdict(set)
        for h, (_, w) in zip(found.hash.tolist(), wanted, strict=True):
            by_hash[h].add(w)
        assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({w for _, w in wanted})
        own = words.lines(data, at)
        cut = [(i, x) for i, t in enumerate(part.to_pylist()) for x in t.split("\n")]
        assert [(int(t), bytes(data[s:e]).decode()) for t, s, e in zip(own.text, own.start, own.end, strict=True)] == cut


# -- line dedup ------------------------------------------------------------------


def test_line_dedup_equals_sql(docs, clashing):
    columns, wanted = duck(docs, ORACLES["op10_line_dedup"])
    for frame in (docs, clashing):
        kept = line_dedup.drop_shared_lines(frame)
        found = kept.select("doc_id", F.col("n_lines").cast("bigint"), "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
        assert rows_of(found, columns) == wanted
    assert "own copies" in {r.copies for r in kept.collect()}
    assert sum(r[columns.index("n_dropped")] for r in wanted) >= 6


def test_line_dedup_plans_hold_no_python(docs):
    kept = line_dedup.drop_shared_lines(docs)
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_nothing_and_of_repeated_rows(spark, empty):
    assert line_dedup.drop_shared_lines(empty).collect() == []
    line = "the same line in every one of these"
    rows = [(1, line), (1, line), (1, f"{line}\nx"), (2, line), (None, line)]
    kept = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.n_dropped for r in kept.collect()} == {0}  # two documents hold it, whatever the rows
    rows.append((3, f"a\n{line}\n{line}"))
    kept = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in kept) == sorted(
        [(1, "", 1), (1, "", 1), (1, "x", 1), (2, "", 1), (0, line, 0), (3, f"a\n{line}\n{line}", 0)]
    )


# -- mixing ----------------------------------------------------------------------


def test_mixing_equals_sql(docs, clashing):
    columns, wanted = duck(docs, ORACLES["op7_mix_sources"])
    sizes = mixing.document_sizes(docs)
    found = mixing.with_copies(sizes, sizes).withColumn("taken", F.col("size") * F.col("copies"))
    assert rows_of(found, columns) == wanted
    mix = mixing.mix_sources(clashing)
    assert mix.columns == clashing.columns
    copies = Counter(r.doc_id for r in mix.collect())
    taken = {r[columns.index("doc_id")]: r for r in wanted}
    for doc_id, row in taken.items():
        size, total = row[columns.index("size")], row[columns.index("taken")]
        assert copies[doc_id] * size == total <= 3 * size


def test_mixing_without_broadcast_and_of_nothing(docs, empty, monkeypatch):
    sizes = mixing.document_sizes(docs)
    wanted = rows_of(mixing.with_copies(sizes, sizes), ("doc_id", "copies", "target"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.with_copies(sizes, sizes), ("doc_id", "copies", "target")) == wanted
    assert mixing.mix_sources(empty).collect() == []


# -- n-gram join -----------------------------------------------------------------


def sets_of(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        out.append(frozenset(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(texts):
    sets = sets_of(texts)
    root = list(range(len(sets)))
    changed = True
    pairs = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


def test_ngram_join_equals_brute_force(docs, clashing):
    wanted = brute_components(odd_texts())
    assert len({r for _, _, r in wanted}) < len(wanted) - 10
    for frame in (docs, clashing):
        assert rows_of(ngram_join.similar_components(frame), ("doc_id", "n_shingles", "component_id")) == wanted


@pytest.mark.parametrize("frequent", [2, 5])
def test_chains_of_copies(spark, monkeypatch, frequent):
    """Many copies whose likeness is near the bound, with tokens that count as frequent."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    random.seed(frequent)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(70):
        own = list(base)
        for k in range(i % 5):
            own[(i * 7 + k * 31) % 150] = f"e{i}_{k}"
        texts.append(" ".join(own[: 150 - i % 9]))
    texts += [" ".join(f"c{i}" for i in range(n)) for n in range(1, 24)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    assert rows_of(ngram_join.similar_components(frame), ("doc_id", "n_shingles", "component_id")) == brute_components(texts)


def test_ngram_join_of_nothing_and_of_repeated_ids(spark, empty):
    assert ngram_join.similar_components(empty).collect() == []
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, "x"), (2, text), (None, text), (7, None)]
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found.collect() if r.doc_id)
    assert got == [(2, 37, 2), (5, 1, 2), (5, 37, 2), (5, 37, 2), (7, 0, 7)]
    assert [r.component_id for r in found.collect() if r.doc_id is None] == [None]


# -- quality rules -----------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_counts_equal_brute_force(docs, clashing):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    wanted = [(i, *brute_counts(t)) for i, t in enumerate(odd_texts())]
    for frame in (docs, clashing):
        judged = outliers.judge(frame)
        assert rows_of(judged, columns) == wanted
        for r in judged.collect():
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed)  # groups of so few rows have no estimate


def test_outliers_of_a_group(spark, empty):
    random.seed(1)
    def plain(i):
        return " ".join(random.choice(["alpha", "be", "gammas", "delta", "eta"]) + str(random.randrange(400)) for _ in range(150 + i % 90))
    good = [(i, plain(i), "en", "s" if i % 2 else None) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{random.randrange(500)}***###" for _ in range(200)), "en", "s") for i in range(20)]
    judged = outliers.judge(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string"))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert kept == set(range(300))
    assert outliers.judge(empty).collect() == []


def plain_text(i, lines=10):
    own = random.Random(i)
    word = lambda: own.choice(["alpha", "be", "gammas", "delta", "eta"]) + str(own.randrange(4000))
    return "\n".join(" ".join(word() for _ in range(15 + i % 9)) for _ in range(lines))


def test_outliers_of_small_groups_and_of_any(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    junk = lambda i: " ".join(f"w{i + k}***###" for k in range(200))
    # Groups of 20, 40 and 99 rows, three rows of another language, and in each a planted text.
    sizes = {("en", "a"): 20, ("en", "b"): 40, ("en", "c"): 99, ("en", None): 5, ("xx", "a"): 3, (None, None): 2}
    good, bad = [], []
    for g, (group, size) in enumerate(sizes.items()):
        good += [(1000 * g + i, plain_text(1000 * g + i), *group) for i in range(size)]
        bad.append((1000 * g + 999, junk(1000 * g), *group))
    judged = outliers.judge(spark.createDataFrame(good + bad, schema)).cache()
    assert judged.where("distance is null").count() == 0
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert not kept & {b[0] for b in bad}
    assert len(kept) >= 0.97 * len(good)


def brute_estimate(x, starts=40):
    """Centre and scatter of the smallest determinant, by exact steps of concentration from many random starts."""
    own = np.random.default_rng(5)
    best = None
    for _ in range(starts):
        held, before = own.choice(len(x), outliers.DIM + 4, replace=False), np.inf
        while True:
            centre = x[held].mean(0)
            scatter = outliers._floored(np.cov(x[held].T, bias=True) * outliers.consistency())
            det = np.linalg.slogdet(scatter)[1]
            if det >= before - 1e-9 and len(held) > outliers.DIM + 4:
                break
            before = det if len(held) > outliers.DIM + 4 else np.inf
            off = x - centre
            distance = np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)
            held = np.argsort(distance, kind="stable")[: int(np.ceil(outliers.COVERAGE * len(x)))]
        if best is None or det < best[0]:
            best = det, centre, np.linalg.inv(scatter)
    off = x - best[1]
    return best[0], np.einsum("ij,jk,ik->i", off, best[2], off)


def test_estimate_equals_brute_force(spark):
    own = random.Random(8)
    junk = lambda i: " ".join(f"{'long' * (i % 5)}w{own.randrange(300)}{'#*' * (i % 3)}" for _ in range(150))
    rows = [(i, plain_text(i, 6 + i % 9), "en", "s") for i in range(340)] + [(400 + i, junk(i), "en", "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    judged = outliers.judge(frame).select("*", *outliers._statistics()).orderBy("doc_id").toPandas()
    assert not judged["base_failed"].any()
    x = judged[list(outliers.STATISTICS)].to_numpy(float) / outliers.UNIT
    distance = brute_estimate(x)[1]
    bound = outliers.chi_square(outliers.CERTAINTY, outliers.DIM)
    clear = np.abs(np.log(distance / bound)) > 0.1
    assert clear.mean() > 0.95 and 0.05 < (distance > bound).mean() < 0.3
    assert (judged["kept"].to_numpy() == (distance <= bound))[clear].all()
    assert np.median(np.abs(np.log(judged["distance"] / distance))) < 0.05
    again = outliers.judge(frame.repartition(7)).orderBy("doc_id").toPandas()
    assert (again["distance"] == judged["distance"]).all()


def test_a_row_more_or_less_changes_a_verdict_little(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    wide = [(i, plain_text(i), "en", "wide") for i in range(200)]
    probe = (5000, plain_text(5000).replace("a", "a#"), "en", "small")
    found = []
    for size in (0, 29, 30):
        small = [(1000 + i, plain_text(1000 + i), "en", "small") for i in range(size)]
        judged = outliers.judge(spark.createDataFrame([*wide, *small, probe], schema))
        found.append(judged.where("doc_id = 5000").collect()[0].distance)
    assert max(found[1:]) / min(found[1:]) < 1.2 and None not in found


def test_quartiles_are_exact(spark):
    values = [7, 1, 1, 1, 9, 5, 5, 2]
    frame = spark.createDataFrame([("g", *([v] * outliers.DIM)) for v in values], ["_group", *outliers.STATISTICS])
    assert outliers._quartiles(frame).collect()[0].q == [[1, 2, 5]] * outliers.DIM


def test_duplicate_lines_or_repeated_words_alone_reject(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    good = [(i, plain_text(i), "en", "s") for i in range(200)]
    duplicates = plain_text(500).replace("\n", "\nzz\n")  # every second line the same, no three words twice
    own = plain_text(501).split()
    repeats = "\n".join(" ".join([*own[k : k + 12], "al", "be", "ga"]) for k in range(0, 144, 12))
    bad = [(1000, duplicates, "en", "s"), (1001, repeats, "en", "s")]
    judged = outliers.judge(spark.createDataFrame(good + bad, schema)).cache()
    rows = {r.doc_id: r for r in judged.where("doc_id >= 1000").collect()}
    assert (rows[1000].n_repeat_words, rows[1001].n_dup_lines) == (0, 0)
    assert not rows[1000].base_failed and not rows[1001].base_failed
    assert not rows[1000].kept and not rows[1001].kept
    assert judged.where("kept").count() >= 0.97 * len(good)


def test_chi_square():
    assert abs(outliers.chi_square(0.95, 6) - 12.5916) < 1e-3 and abs(outliers.chi_square(0.5, 2) - 1.3863) < 1e-3


# -- classifiers -------------------------------------------------------------------

# The smallest tables hold about thirty toxic labels, too few to learn the words of four languages from.
@pytest.mark.parametrize(
    ("name", "sf", "label", "least"),
    [("op3_quality_classifier", "sf0.01", "quality", 0.93), ("op5_toxicity", "sf0.1", "toxic", 0.97)],
)
def test_held_out_accuracy(spark, name, sf, label, least):
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    scored = queries.QUERIES[name](spark, folder).cache()
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_without_labels_and_on_odd_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    network, prior = quality.fit(docs, none)
    assert prior == 0.5 and {r.score for r in quality.score_texts(docs, network).collect()} == {0.5}
    model = toxicity.fit(docs, none)
    assert all(r.score < 1e-9 and r.passages == [] for r in toxicity.score_texts(docs, model).collect())
    some = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    some = some.unionByName(some).unionByName(none.unionByName(spark.createDataFrame([(None, None, None)], none.schema)))
    network, _ = quality.fit(docs, some)
    scored = quality.score_texts(docs, network)
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score_texts(docs, toxicity.fit(docs, some)).count() == docs.count()
    assert quality.score_texts(empty, network).collect() == [] and toxicity.score_texts(empty, model).collect() == []


def test_segments_are_the_maximal_ones():
    def brute(score):
        """Peel the best segment off again and again, by the definition."""
        if not len(score) or max(score) <= 0:
            return []
        best = max(
            ((i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)),
            key=lambda s: (round(sum(score[s[0] : s[1]]), 9), -(s[1] - s[0]), -s[0]),
        )
        i, j = best
        return sorted(brute(score[:i]) + [best] + [(a + j, b + j) for a, b in brute(score[j:])])

    random.seed(5)
    for _ in range(60):
        score = [random.choice([-3.0, -1.5, -0.7, 0.9, 2.1, 3.3]) for _ in range(random.randrange(14))]
        assert [(a, b) for a, b, _ in sorted(toxicity.segments(np.array(score)))] == brute(score)


def test_the_sample_is_bounded_and_fixed(docs):
    ids = docs.select("doc_id")
    one = [r.doc_id for r in labelled.sample_ids(ids, 7, "x").collect()]
    assert len(one) == 7 and one == [r.doc_id for r in labelled.sample_ids(ids.repartition(3), 7, "x").collect()]


def test_features_tell_texts_apart():
    f = textstats.features(pa.array(["plain words here", "PLAIN!! WORDS!!", ""]).cast(pa.large_string()))
    assert f.shape == (3, textstats.FEATURES) and np.isfinite(f).all() and (f[0] != f[1]).any() and (f[2] == 0).all()


# -- SentencePiece -------------------------------------------------------------------


def test_encoding_equals_the_library(docs, clashing, empty):
    own = pieces.MergeEncoder(queries.vocabulary())
    random.seed(2)
    signs = "ab ▁\n.é🙂<s>0x ​\t日"
    texts = [t or "" for t in odd_texts() if len(t or "") < 100_000]
    texts += ["".join(random.choices(signs, k=random.randrange(60))) for _ in range(800)]
    packed, wrong = own.encode(texts)
    wanted = own.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == wanted and not any(wrong)
    for segment in ("▁hello", "▁▁▁a", "▁", "▁" + "z" * 90, "▁x́y"):
        assert own.merge(segment) == np.frombuffer(own.merge_all([segment])[0], "<u4").tolist()
    for frame in (docs, clashing):
        rows = {r.doc_id: r for r in queries.coded_digests(frame).collect()}
        for i, t in enumerate(odd_texts()):
            ids = own.library.encode(t or "", add_bos=True, add_eos=True)
            assert rows[i].n_tokens == len(ids) and rows[i].mismatches == 0
            assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert rows[i].decoded_sha256 == hashlib.sha256(own.library.decode(ids).encode()).hexdigest()
    assert queries.coded_digests(empty).collect() == []
