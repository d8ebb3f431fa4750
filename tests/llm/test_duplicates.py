"""Exact and near copies, components, decontamination and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import op04_exact_dedup as exact
from quern.llm import op08_decontaminate as leaks
from quern.llm import op09_ngram_join as near
from quern.llm.components import connected_components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions, most", [(1, 10**6), (64, 10**6), (64, 0)])
def test_exact_groups(spark, monkeypatch, keep, partitions, most):
    monkeypatch.setattr(exact, "BROADCAST_PARTS", most)
    rows = [(k, "hot text") for k in range(60)] + [(100, None), (101, ""), (102, "a" * 50_000), (103, "a" * 50_000), (104, "a" * 49_999 + "b"), (105, "É"), (106, "é"), (7, "hot text"), (200, "once"), (None, "once"), *[(None, "no names")] * 80]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit(1), "part": F.lit("x")})
    got = exact.exact_groups(df, keep=keep, partitions=partitions, passing=["part"]).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = max if keep == "largest" else min
    want = Counter((i, best((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] and r["keep_part"] == "x" for r in kept)


def test_exact_groups_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B")], "doc_id long, text string")
    got = exact.exact_groups(df, normalise=lambda c: F.regexp_replace(F.lower(c), r"\s+", " "))
    assert {r["keep_id"] for r in got.collect()} == {1}
    assert exact.exact_groups(df.filter("false")).isEmpty()
    with pytest.raises(ValueError):
        exact.exact_groups(df, keep="some")


def test_exact_is_native(spark, sf_dir):
    plan = exact.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (5, 5), (100, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows, threshold):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    reps = {}
    for i in sorted(sets):
        if sets[i]:
            parent[top(i)] = top(reps.setdefault(sets[i], i))
    links = Counter()
    for a in reps:
        for b in reps:
            if a != b and len(a & b) / len(a | b) >= threshold:
                links[a] += 1
                x, y = sorted((top(reps[a]), top(reps[b])))
                parent[y] = x
    return {i: (top(i), links[s], reps.get(s, i), sum(sets[j] == s for j, _ in rows) if s else 1) for i, s in sets.items()}


def corpus(seed, groups=6, size=9):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], [rnd.choice(vocabulary) for _ in range(30)]
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 160))] + passage
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((rnd.randrange(10_000) * 100 + len(rows), " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(3, None), (4, ""), (5, "..."), (6, "one two"), (7, "One, TWO"), (8, "one"), (9, "x " * 30_000), (10, "x " * 29_000)]


@pytest.mark.parametrize("block_rows, ball", [(1024, 64), (4, 3)])
def test_join_equals_brute_force(spark, monkeypatch, block_rows, ball):
    monkeypatch.setattr(near, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(near, "BALL", ball)
    rows = corpus(1, groups=3) + [(50_000_000 + i, t) for i, t in corpus(7, groups=1, size=30)[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(0), "keys": F.lit(0)})
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["n_copies"]) for r in near.ngram_join(df, trees=40, recall=0.99999999).collect()}
    assert got == brute_join(rows, 0.8)


def test_join_recall_at_production_setting(spark):
    rows = corpus(2, groups=20)
    got = {r["doc_id"]: r["n_links"] for r in near.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: x[1] for i, x in brute_join(rows, 0.8).items()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values())


def test_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_copies"]) for r in near.ngram_join(df).collect()) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]
    assert near.ngram_join(df.filter("false")).isEmpty()
    words = " ".join(f"w{k}" for k in range(60))
    for kind in ("int", "string"):
        pair = spark.createDataFrame([("5", words), ("6", words + " end")], "doc_id string, text string").select(F.col("doc_id").cast(kind), "text")
        assert {(str(r["class_id"]), r["n_links"]) for r in near.ngram_join(pair).collect()} == {("5", 1)}
    assert near.shortest_prefix(0.8, 12, 5, 0.999) == 3
    with pytest.raises(ValueError):
        near.shortest_prefix(0.1, 2, 6, 0.999)


def test_prefixes_are_shortened_until_the_recall(spark):
    import numpy as np

    sizes = np.ones((3, 12, 3))
    sizes[1, :8] = 1000  # eight crowded tries
    sizes[2] = 1000
    kept = near.shortened(sizes, 3, 0.8, 0.999)
    missed = (1 - 0.8 ** (3.0 + kept)).prod(axis=1)
    assert (missed <= 0.001).all() and (missed > 0.0004).all()
    assert kept[1, 8:].max() == 0 and kept[1, :8].sum() == 10  # the sparse tries are asked first
    full = near.shortened(np.ones((1, 23, 4)), 3, 0.8, 0.999)
    assert (full == 3).all()  # enough tries at full length


def test_balls_count_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "BALL", 8)
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[: 3 * k], f"x{k}", *base[3 * k + 1 :]])) for k in range(90)]  # any two differ in two words of 300
    got = [(r["class_id"], r["n_links"]) for r in near.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(0, 89)] * 90


def brute_leaks(docs, items, width, slop):
    out = []
    listed = [(i, words(t)) for i, t in items]
    for t in docs:
        w = words(t)
        hit, got, close = [False] * len(w), set(), set()
        for i, own in listed:
            for a in range(max(1, len(own) - width + 1) if own else 0):
                window = own[a : a + width]
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        got.add(i)
                        hit[s : s + len(window)] = [True] * len(window)
                if any(set(window) <= set(w[s : s + len(window) + slop]) for s in range(len(w))):
                    close.add(i)
        out.append((len(w), sum(hit), sorted(got), sorted(close)))
    return out


@pytest.mark.parametrize("limit, block, cell", [(1 << 20, 1 << 20, 15), (0, 100, 5)])
def test_contamination_equals_brute_force(spark, limit, block, cell):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("abcdÉ") + rnd.choice(["", "x", ",", "."]) for _ in range(n))
    docs = [None, "", "...", *(text(rnd.randrange(60)) for _ in range(40)), "a b " * 3_000]
    items = [("0", None), ("1", ""), *((str(k), text(rnd.randrange(1, 9))) for k in range(2, 12)), ("10", "a")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame([*items, (None, "a")], "item_id string, text string")
    found = leaks.find_contamination(df, bench, width=4, slop=2, vocabulary_bytes=limit, block_bytes=block, cell_bits=cell).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"], r["near_items"]) for r in found}
    want = brute_leaks(docs[:-1], items, 4, 2)
    assert [got[k] for k in range(len(want))] == want
    passed = leaks.find_contamination(df, bench, width=4, slop=2, passing=["items"]).collect()
    assert {r["doc_id"]: (r["spans"], r["items"], r["near_items"], r["keep_items"]) for r in passed} == {r["doc_id"]: (r["spans"], r["items"], r["near_items"], 1) for r in found}
    exact = leaks.find_contamination(df, bench, width=4, slop=None, vocabulary_bytes=limit, block_bytes=block, cell_bits=cell).collect()
    assert {r["doc_id"]: (r["spans"], r["items"], r["near_items"]) for r in exact} == {r["doc_id"]: (r["spans"], r["items"], []) for r in found}
    empty = leaks.find_contamination(df, bench.filter("false")).collect()
    assert len(empty) == len(docs) and not any(r["spans"] or r["items"] for r in empty)
    assert leaks.find_contamination(df.filter("false"), bench).isEmpty()


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    block = leaks.Block([b"aa bb aa longerthansixteenbytesA longerthansixteenbytesB cc bb"])
    monkeypatch.setattr(leaks.Block, "word_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    terms, cells, begin, places = leaks._lists(block, np.arange(7), None, 15)
    assert {t: places[a:b].tolist() for t, a, b in zip(terms, begin, begin[1:])} == {b"aa": [0, 2], b"bb": [1, 6], b"longerthansixteenbytesa": [3], b"longerthansixteenbytesb": [4], b"cc": [5]}


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    kept = stages["language_id"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert kept.columns == list(docs[0])
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(ids) > 0.98 * len(docs)
    left = [d for d in docs if d["doc_id"] in ids]
    last = {}
    for d in left:
        last[d["text"]] = max(d["doc_id"], last.get(d["text"], -1))
    left = [d for d in left if last[d["text"]] == d["doc_id"]]
    classes = brute_join([(d["doc_id"], d["text"]) for d in left], 0.8)
    left = [d for d in left if classes[d["doc_id"]][0] == d["doc_id"]]
    dirty = brute_leaks([d["text"] for d in left], bench, 10, 0)
    want = {d["doc_id"] for d, x in zip(left, dirty) if not x[1]}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert all(r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest() for r in rows for d in left if d["doc_id"] == r["doc_id"])


def test_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "q w e r t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
    text = "the and of this with that house over there again and again"
    df = spark.createDataFrame([(1, text, "en", "s", 1, "a"), (1, text, "en", "s", 1, "a"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "b"), (4, "der die und das nicht von mit", "de", "s", 1, "c")], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.filter("false"), str(tmp_path)).isEmpty(), name
        out = stage(spark, df, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == df.columns
        n = out.count()
        assert {"language_id": 3, "exact_dedup": 3, "decontamination": 5, "byte_bpe": 5}.get(name, n) == n


def test_null_identifiers_are_joined(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (None, b), (10, b + " end"), (9, "other words"), (None, c), (None, None), (9, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["copy_id"], r["n_copies"]) for r in near.ngram_join(df).collect())
    want = {(None, None, 1, None, 1): 2, (None, 10, 1, None, 2): 2, (10, 10, 1, 10, 1): 1, (9, 9, 0, 9, 2): 2, (None, None, 0, None, 1): 2}
    assert got == want
    kept = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, df, "").collect()]
    assert len(kept) == 6 and sum(t in (a, a + " end") for _, t in kept) == 1  # of the class without identifiers either
    assert Counter(x for x in kept if x[1] not in (a, a + " end")) == {(10, b + " end"): 1, (9, "other words"): 2, (None, c): 1, (None, None): 1}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_items_without_identifier_count(spark, limit):
    df = spark.createDataFrame([(1, "x a b c d y"), (2, "p q r s"), (3, "b a d c"), (4, "none")], "doc_id int, text string")
    bench = spark.createDataFrame([(None, "a b c d"), ("7", "p q r s"), (None, "p q r s"), (None, None)], "item_id string, text string")
    found = {r["doc_id"]: ([tuple(x) for x in r["spans"]], r["items"], r["near_items"]) for r in leaks.find_contamination(df, bench, width=4, slop=2, vocabulary_bytes=limit).collect()}
    assert found == {1: ([(1, 5)], [], []), 2: ([(0, 4)], ["7"], ["7"]), 3: ([], [], []), 4: ([], [], [])}


def test_a_task_may_read_any_number_of_blocks(spark):
    """More blocks than a fixed share of a place's bits could number, all in one task."""
    n = 9000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 999, F.concat(F.lit("w x y z "), F.col("id"))).otherwise("two words").alias("text")).coalesce(1)
    bench = spark.createDataFrame([("a", "w x y z"), ("b", "nowhere at all")], "item_id string, text string")
    found = {r["doc_id"]: (r["n_words"], r["items"]) for r in leaks.find_contamination(df, bench, width=4, slop=2, block_bytes=4, cell_bits=5).collect()}
    assert found == {k: (5, ["a"]) if k % 1000 == 999 else (2, []) for k in range(n)}
