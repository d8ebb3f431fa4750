"""Spelling variants against SQL and a brute-force loop."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import op13_spelling as spelling
from quern.llm.queries import ORACLES, QUERIES


def brute(docs, every=97):
    counts = Counter()
    for doc, text in docs:
        for run in spelling.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % every else "".join(c for k, c in enumerate(run) if k != h % len(run))] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters}
        near = sorted((x for x in edits - {w} if x in words), key=lambda x: (-words[x], x))
        form = near[0] if near and words[near[0]] >= 2 * n else None
        out[w] = (n, len(near), form, words.get(form))
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return {w: (*v, root(w)) for w, v in out.items()}


def rows(df):
    found = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found}
    assert len(out) == len(found)
    return out


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {w: v for w, *v in con.sql(f"SELECT word, n, n_near, form, form_n, root FROM ({ORACLES['op13_spelling']})").fetchall()}
    assert {w: list(v) for w, v in rows(QUERIES["op13_spelling"](spark, sf_dir)).items()} == want
    assert any(v[2] for v in want.values())


@pytest.mark.parametrize("crowd", [0, 3, 32])
def test_equals_brute_force_for_any_crowd(spark, crowd):
    """Few letters, so that signatures are crowded, letters repeat and ties are many."""
    rng = random.Random(crowd)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 7))) for _ in range(400)]
    docs = [(k, " ".join(rng.choices(words, k=200)) + ". ABCDE abcde") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.spelling_variants(df, spelling.drop_letter(7), crowd=crowd)) == brute(docs, 7)


def test_chains_of_forms_end_at_their_roots(spark):
    chain = ["a" * 5 + "b" * k for k in range(12)]  # each one edit from the next, counts doubling
    docs = [(1, " ".join(" ".join([w] * (3 << k)) for k, w in enumerate(chain)))]
    found = rows(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {v[4] for v in found.values()} == {chain[-1]}
    assert found[chain[0]] == (3, 1, chain[1], 6, chain[-1])


def test_ties_go_to_the_least_word(spark):
    docs = [(1, "words " * 3 + "wordz wordy wordÿ " * 6)]
    found = rows(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found["words"] == (3, 3, "wordy", 6, "wordy")
    assert found["wordy"][2] is None


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs = [(None, "Straße naïve NAÏVE naïve"), (1, None), (1, ""), (2, "naïve × naïve"), (2, "naïve × naïve")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert rows(spelling.spelling_variants(df, spelling.drop_letter())) == brute(docs)
    assert spelling.spelling_variants(df.filter(F.lit(False)), spelling.drop_letter()).count() == 0


def test_long_texts_are_read_in_windows(spark, monkeypatch):
    text = "letters and words, " * 400 + "x" * 500
    monkeypatch.setattr(spelling, "WINDOW_CHARS", 50)
    parts = list(spelling._windows(text))
    assert len(parts) > 100 and "".join(parts) == text
    assert sum((Counter(spelling.RUN.findall(p)) for p in parts), Counter()) == Counter(spelling.RUN.findall(text))
