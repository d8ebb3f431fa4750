import math
import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import text as texts
from quern.operators import search


@pytest.fixture(scope="module")
def statutes(spark):
    s = spark.createDataFrame([(1, "Civil Code", "An act on civil things", "code", "civil")], "id long, short_title string, official_title string, kind string, domain string")
    p = spark.createDataFrame([(1, 1, "5", "Waiver of rights", "A waiver contrary to public policy is void.", "in_force"), (2, 1, "6", None, "Rights may be waived; a waiver needs intent.", "in_force")], "id long, statute_id long, provision_no string, heading string, body string, status string")
    return p, s


def test_pages(statutes):
    page = search.search_statute(*statutes, "waiver", threshold=0, limit=1)
    meta = page.meta.first()
    assert (meta["status"], meta["total"], meta["count"], meta["has_more"], meta["next_offset"]) == ("ok", 2, 1, True, 1)
    assert page.rows.first()["citation"] == "Civil Code, 5 (Waiver of rights)"
    assert search.search_statute(*statutes, "waiver", domain="tax", threshold=0).rows.isEmpty()
    gated = search.search_statute(*statutes, "waiver", threshold=0.99).meta.first()
    assert (gated["status"], gated["total"], gated["has_more"], gated["next_offset"]) == ("insufficient_corpus_coverage", 2, False, None)
    none = search.search_statute(*statutes, "zzzznomatch").meta.first()
    assert (none["total"], none["next_offset"]) == (0, None)
    assert search.search_statute(*statutes, "...").meta.first()["total"] == 0


def test_query_is_checked(statutes):
    with pytest.raises(ValueError):
        search.search_statute(*statutes, "")
    with pytest.raises(ValueError):
        search.search_statute(*statutes, "x" * 301)


def test_score_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "Alphá gamma"), (3, "delta"), (4, ""), (5, "epsilon zeta eta theta"), (6, None)], "id long, body string")
    corpus = search.Corpus(docs, "id", ("body",), "body")
    got = {r["id"]: r["bm25"] for r in search.scored(corpus, "alpha ALPHA").collect()}
    mean, idf = 10 / 6, math.log((6 - 2 + 0.5) / (2 + 0.5))
    for k, length in ((1, 3), (2, 2)):
        assert got[k] == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean)))
    by_postings = {r["id"]: r["bm25"] for r in search.scored_by_postings(search.postings(corpus), search.corpus_stats(corpus), "alpha ALPHA").collect()}
    assert by_postings == pytest.approx(got)


def test_index_is_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 7} common text") for k in range(50)], "id long, body string")
    corpus = search.Corpus(docs, "id", ("body",), "body")
    search.write_index(corpus, str(tmp_path))
    rows, stats = spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/stats")
    assert {r["id"] for r in search.scored_by_postings(rows, stats, "word3 common").collect()} == {k for k in range(50) if k % 7 == 3}


@pytest.mark.parametrize("bm25, body, query, low, high", [(8.0, "a b", "a b", 0.7, 1), (1.0, "a x", "a b c d e", 0, 0.4), (100.0, "a b", "a b", 0.9, 1)])
def test_confidence(spark, bm25, body, query, low, high):
    row = spark.createDataFrame([(bm25, body)], "s double, b string").select(search.confidence(F.col("s"), F.col("b"), F.col("b"), query).alias("c")).first()
    assert low <= row["c"] <= high


def test_snippet(spark):
    body = "x" * 100 + " needle " + "y" * 300
    got = spark.createDataFrame([(body,)], "b string").select(search.snippet(F.col("b"), "Needle").alias("s")).first()[0]
    at = body.index("needle")
    assert got == "…" + body[at - 80 : at + 160] + "…"


def test_cases_and_issuances(spark):
    cases = spark.createDataFrame([(1, "G.R. No. 1", "A v. B", "sc", "2020-01-01", "J", "En Banc")], "id long, citation string, title string, court string, promulgation_date string, ponente string, division string")
    passages = spark.createDataFrame([(1, 1, None, "On piercing the corporate veil.")], "id long, case_id long, heading string, body string")
    assert search.search_jurisprudence(passages, cases, "piercing the corporate veil", threshold=0).rows.count() == 1
    assert search.search_jurisprudence(passages, cases, "piercing", court="ca", threshold=0).rows.isEmpty()
    issuances = spark.createDataFrame([(1, "BIR", "RMC", "RMC 1-2023", "t", "2023-01-01")], "id long, agency string, issuance_type string, reference_no string, title string, issue_date string")
    parts = spark.createDataFrame([(1, 1, None, "withholding of tax")], "id long, issuance_id long, heading string, body string")
    assert search.search_issuance(parts, issuances, "tax", threshold=0).rows.count() == 1
    assert search.search_issuance(parts, issuances, "tax", agency="SSS", threshold=0).rows.isEmpty()


def _fts5_tokens(rows):
    """Tokens of each text as the standard library's SQLite splits them."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(rows))
    out = [[] for _ in rows]
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        out[doc].append(term)
    return out


def test_tokens_equal_unicode61(spark):
    """On letters, marks, digits, symbols and private-use characters that Unicode 6.1 knew."""
    rng = random.Random(61)
    old = [c for c in map(chr, [*range(1, 0x250), *range(0x370, 0x500), *range(0x5D0, 0x5EB), *range(0x904, 0x93A), *range(0x1E00, 0x1FFF), *range(0x2010, 0x2060), *range(0x2100, 0x2180), *range(0x4E00, 0x4E40), *range(0xE000, 0xE010)]) if unicodedata.category(c) not in ("Cn", "Cs") and c not in "\u037f\u061c"]
    marks = list(map(chr, range(0x300, 0x340)))
    rows = ["re\u0301sume\u0301", "tiếng Việt", "a\ue000b", "Ǣ Ά ЙЁ İstanbul ſ ς µ ß ẞ", "\u0301x \u0301 y\u0301", "", "A-B_c.d", "e\u0301\u0323x", "o\u0305p o\u0338p"]
    rows += ["".join(rng.choice([*old, *marks, *"abcé ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["x" + c + "Y" for c in old + marks]
    got = spark.createDataFrame(list(enumerate(rows)), "id long, t string").select("id", texts.tokens(F.col("t")).alias("w")).collect()
    got = [r["w"] for r in sorted(got, key=lambda r: r["id"])]
    assert [(t, g, w) for t, g, w in zip(rows, got, _fts5_tokens(rows), strict=True) if g != w][:10] == []


def test_query_terms_fold_as_texts_do(spark):
    for q in ["Résumé re\u0301sume\u0301", "tiếng ỹ", "ΆΣ ς", "a-b c.d", "İx ſ"]:
        row = spark.createDataFrame([(q,)], "q string").select(texts.terms_of(F.col("q")).alias("t")).first()
        assert row["t"] == [texts.fold_term(t) for t in texts.query_terms(q)]


@pytest.fixture(scope="module")
def varied(spark):
    """Documents of many lengths in which two words are frequent to different degrees."""
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", *(f"w{i}" for i in range(20))], weights=[rng.random() * 6, rng.random() * 3, 1, *[1] * 20], k=rng.randint(3, 60))), f"s{k % 4}") for k in range(3000)]
    return search.Corpus(spark.createDataFrame(rows, "id long, body string, source string").persist(), "id", ("body",), "body")


@pytest.mark.parametrize("asked", ["alpha beta", "alpha", "gamma w3 alpha", "beta beta w1"])
def test_top_from_the_index_equals_scoring_all(varied, tmp_path, monkeypatch, asked):
    monkeypatch.setattr(search, "PROBE_ROWS", 60)
    index = search.write_index(varied, str(tmp_path), 6)
    for limit, offset, filters in ((10, 0, None), (50, 30, None), (5, 0, {"source": "s2"})):
        want = [(r["id"], round(r["bm25"], 9)) for r in search.search(varied, asked, filters=filters, limit=limit, offset=offset, threshold=0).rows.select("id", "bm25").collect()]
        got = [(r["id"], round(r["bm25"], 9)) for r in search.search_stored(varied, index, asked, filters=filters, limit=limit, offset=offset, threshold=0).select("id", "bm25").collect()]
        assert got == want and want


def test_tiers_that_cannot_reach_the_page_are_not_read(varied, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PROBE_ROWS", 200)
    index = search.write_index(varied, str(tmp_path))
    weights, cuts = search.needed_tiers(index, "alpha beta", 10)
    every = index.postings.filter(F.col("term").isin("alpha", "beta")).count()
    assert index.postings.filter(search._tiers_from(cuts)).count() < 0.6 * every
    plan = index.postings.filter(search._tiers_from(cuts))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "GreaterThanOrEqual(tier" in plan


def test_words_that_no_passage_has(varied, tmp_path):
    index = search.write_index(varied, str(tmp_path))
    for asked in ("nowhere", "alpha nowhere", "..."):
        assert search.top_by_index(index, asked).isEmpty()


def test_a_table_of_requests(spark, varied, tmp_path):
    index = search.write_index(varied, str(tmp_path))
    asked = [("a", "alpha beta", 5, None), ("b", "Alpha", None, "s1"), ("c", "w1 gamma beta", 50, "s3"), ("d", "nowhere alpha", 5, None), ("e", "...", 5, None), ("f", None, 5, None), ("g", "w2 w2 w3", 0, None), (None, "beta", 2, None)]
    requests = spark.createDataFrame(asked + asked[:2], "request_id string, query string, limit int, only string")
    got = {}
    for r in search.answer_requests(index, requests, varied.passages, {"only": "source"}).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["id"], round(r["bm25"], 9)))
    want = {}
    for name, q, limit, only in asked:
        if name and q and limit != 0:
            rows = search.search(varied, q, filters={"source": only}, limit=limit, threshold=0).rows.select("id", "bm25").collect()
            want |= {name: [(r["id"], round(r["bm25"], 9)) for r in rows]} if rows else {}
    assert got == want


def test_requests_rank_by_nine_digits(spark):
    """Passages whose scores differ by less than the ranks' digits go by identifier."""
    from quern.operators import search

    postings = spark.createDataFrame([("x", 1, 7, 1, 5, 1.0), ("x", 1, 8, 1, 5, 1.0 + 2e-11), ("x", 1, 9, 1, 5, 1.1)], "term string, tier int, id long, tf long, length int, gain double")
    index = search.Index(postings, spark.createDataFrame([("x", 1, 3, 1.1)], "term string, tier int, n long, gain double"), spark.createDataFrame([(100, 5.0)], "n_docs long, mean_length double"))
    found = search.answer_requests(index, spark.createDataFrame([("r", "x", 10)], "request_id string, query string, limit int"), digits=9)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [9, 7, 8]


def test_terms_are_counted_without_a_shuffle(spark):
    rows = [(k, f"Word word w{k}") for k in range(600)] + [(1000, None), (1001, "..."), (None, "x x")]
    plain = search.postings(search.Corpus(spark.createDataFrame(rows, "id long, body string"), "id", ("body",), "body"))
    got = {(r["id"], r["term"], r["length"], r["tf"]) for r in plain.collect()}
    assert got == {(k, "word", 3, 2) for k in range(600)} | {(k, f"w{k}", 3, 1) for k in range(600)} | {(None, "x", 2, 2)} and plain.count() == len(got)
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString()
    again = search.postings(search.Corpus(spark.createDataFrame([("a", "x y"), ("a", "y z"), ("a", "x")], "id string, body string"), "id", ("body",), "body"))
    assert {(r["id"], r["term"], r["length"], r["tf"]) for r in again.collect()} == {("a", "x", 2, 1), ("a", "y", 2, 2), ("a", "z", 2, 1), ("a", "x", 1, 1)}
