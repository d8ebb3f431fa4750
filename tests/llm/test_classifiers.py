"""Language ID and toxicity: held-out accuracy, folds and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import op06_language as language
from quern.llm import op07_toxicity as toxicity
from quern.llm.queries import QUERIES


def test_held_out_languages(spark, sf_dir):
    got = QUERIES["op6_language_id"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and all(r["accepted"] for r in rows if r["score"] >= 0.9)


def test_odd_languages(spark):
    rows = [(1, "der die und das nicht", "de"), (2, "the and of this with", "en"), (3, None, "en"), (4, "12 !?", "en"), (5, "the one", None), (6, "the " * 100_000, "en"), (7, "", "de")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language.train(df, F.lit(True))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in (3, 4, 7)] == ["und"] * 3 and not any(got[k]["accepted"] or got[k]["score"] for k in (3, 4, 7))
    assert language.identify(df, model).count() == 14
    assert language.train(df.filter("false"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.filter("false"), model).isEmpty()


def test_long_texts_are_read_whole():
    model = language.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(1 << language.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2))
    texts = [b"some words", b"more of them", b"", b"x"]
    together, alone = model.logits(texts), np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(together, alone)


def test_rejection_is_calibrated():
    rnd = random.Random(1)
    make = lambda lang: " ".join(rnd.choice(["the", "and", "of", "house"] if lang == "en" else ["der", "und", "von", "haus"]) for _ in range(rnd.randrange(1, 12)))
    labels = [rnd.choice(["en", "de"]) for _ in range(600)]
    texts = [make(x if rnd.random() < 0.8 else "en").encode() for x in labels]
    model = language.fit(texts, labels)
    p = model.probabilities(texts)
    right = np.array([model.languages[k] for k in p.argmax(axis=1)]) == np.array(labels)
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.08


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic, clean = [r["score"] for r in held if r["toxic"] == 1], [r["score"] for r in held if r["toxic"] == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.95 and sum((r["predicted"] == r["toxic"]) for r in held) >= 0.95 * len(held)


def test_risk_slope_is_the_slope():
    rng = np.random.default_rng(1)
    toxic, score = np.arange(12) < 4, rng.normal(size=12) + 1

    def risk(s):
        l = lambda x: np.logaddexp(0, -x)  # noqa: E731, E741
        return 0.3 * l(s[toxic]).mean() + l(-s[~toxic]).mean() - 0.3 * l(-s[toxic]).mean()

    numeric = [(risk(score + 1e-6 * e) - risk(score - 1e-6 * e)) / 2e-6 for e in np.eye(12)]
    assert np.allclose(toxicity.risk_slope(score, toxic, 0.3), numeric, atol=1e-5)
    over = np.where(toxic, 5.0, -9.0)  # the corrected risk is negative: step back
    assert (toxicity.risk_slope(over, toxic, 0.3)[~toxic] <= 0).all()


def test_odd_toxicity(spark):
    texts = [(k, f"you idiot fool number {k}" if k % 4 == 0 else f"a calm word about thing {k}") for k in range(80)]
    df = spark.createDataFrame([*texts, (90, None), (91, ""), (92, "word " * 100_000), (0, "again")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, 1 if k % 8 == 0 else 0) for k in range(40)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.lit(True))
    got = toxicity.score_texts(df, model).collect()
    assert len(got) == 84 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[76] > by[77] and by[90] == by[91]
    assert toxicity.train(df, labels.filter("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score_texts(df, None).collect()} == {0.0}
    assert toxicity.score_texts(df.filter("false"), model).isEmpty()


@pytest.mark.parametrize("texts", [[b"", b"a", b"bad word bad", b"zzz " * 3000]])
def test_summaries_do_not_depend_on_blocks(texts):
    model = toxicity.fit(texts * 4, np.array([False, False, True, False] * 4), 0.2)
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]))


def test_languages_equal_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)

    def plain(text):
        marks = [0, *(int(language._MARK[b + 32 if 0x41 <= b <= 0x5A else b]) for b in text.encode()), 0]
        total, n = np.zeros(len(model.languages)), 0
        for size in language.SIZES:
            for p in range(len(marks) - size + 1):
                h = marks[p]
                for m in marks[p + 1 : p + size]:
                    h = (h * 0x01000193 + m) % 2**32
                h = ((h ^ (size * 0x9E37)) * 0x9E3779B1) % 2**32
                h = ((h ^ (h >> 15)) * 0x85EBCA77) % 2**32
                total += model.scores[h >> (32 - language.BUCKET_BITS)]
                n += 1
        e = (total / n + model.bias) / model.temperature
        e = np.exp(e - e.max())
        return model.languages[int(e.argmax())], e.max() / e.sum()

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]] or "") > 4000:
            continue  # the plain loop is slow
        want = plain(texts[r["doc_id"]]) if any(c.isalpha() for c in texts[r["doc_id"]] or "") else ("und", 0)
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-4


def test_toxicity_equals_a_plain_loop(spark):
    import re

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    known = {}

    def strength(word):
        if word not in known:
            whole, begin = toxicity.word_buckets(toxicity.blocks([word]).__next__()[1])
            known[word] = (model.weights[whole[0]] + model.weights[begin[0]], int(begin[0]))
        return known[word]

    def plain(text):
        words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        high = [strength(w) for w in words if strength(w)[0] > model.level]
        x = [np.log1p(len(high)), min(8, len({b for _, b in high})), np.log1p(sum(float(s) for s, _ in high)), np.log1p(200 * len(high) / max(1, len(words))), np.log1p(len(words)), len(high) >= 2]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.summary_weights)) + model.bias
        return 1 / (1 + np.exp(-z))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op7_toxicity"](spark, folder).collect():
        assert abs(r["score"] - plain(texts[r["doc_id"]])) < 1e-4


def test_only_long_texts_are_learned_from(spark):
    long = {"en": "the house of this and that " * 4000, "de": "das haus und nicht der wagen " * 4000}
    df = spark.createDataFrame([(k, f"{long[x]} {k}", x, int(x == "de")) for k, x in enumerate(["en", "de"] * 8)], "doc_id long, text string, lang string, toxic int")
    model = language.train(df, F.lit(True))
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in language.identify(df, model).collect()} == {(0, "en"), (1, "de")}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(df, toxicity.train(df, df, F.lit(True), prior=0.1)).collect()}
    assert min(scores[k] for k in range(1, 16, 2)) > max(scores[k] for k in range(0, 16, 2))


def _repeated(spark, sf_dir, times, doc_id):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.lit(doc_id).cast("long"))
    return docs.crossJoin(spark.range(times).select(F.col("id").alias("copy"))).drop("copy")


@pytest.mark.parametrize("doc_id", [3, None])
def test_one_identifier_and_copies_leave_the_sample_of_languages_as_it_is(spark, sf_dir, doc_id):
    from quern.llm import op06_language

    once, often = (op06_language.train(_repeated(spark, sf_dir, n, doc_id), F.lit(True)) for n in (1, 12))
    assert once.languages == often.languages and (once.scores == often.scores).all() and once.temperature == often.temperature
    same = spark.createDataFrame([(1, "one text in a language", "en")] * 3000 + [(2, "noch ein Text", "de")], "doc_id long, text string, lang string")
    assert op06_language.train(same, F.lit(True)).languages == ["de", "en"]


def test_one_identifier_and_copies_leave_the_sample_of_toxic_texts_as_it_is(spark):
    from quern.llm import op07_toxicity

    rows = [(3, f"bad words {k} vile awful") for k in range(40)] + [(100 + k, f"good words {k} kind nice") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (100, 0), (101, 0)], "doc_id long, toxic int")
    often = df.crossJoin(spark.range(100).select(F.col("id").alias("copy"))).drop("copy")
    once, many = (op07_toxicity.train(x, labels, F.lit(True)) for x in (df, often))
    assert (once.weights == many.weights).all() and once.bias == many.bias


def test_samples_are_bounded_in_bytes(spark):
    from quern.llm import sample

    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("kind"), F.xxhash64("id").alias("dice"), F.repeat(F.lit("x"), 100).alias("text")).persist()
    found = sample.gather(rows.select("dice", "text"), rows.select("kind", "dice"), lambda texts: [(list(t),) for t in texts], ("int",), 30_000)
    assert 45 < len(found) <= 30_000 // 464 and {r[0] for r in found} == {"0", "1", "2"}
    rows.unpersist()
