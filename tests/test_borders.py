"""Citations in passages against those of the joined text."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import borders, citations

WORDS = ["Art.", "Sec.", "Article", "5", "12-A", "(b)", ",", "of", "the", "RA", "R.A.", "No.", "Republic", "Act", "10", "7", "G.R.", "L-33", "Civil Code", "1987 Constitution", "VII", "Section", "3", "and", ".", "Implementing Rules", "IRR of RA", "x"]


def joined(rows):
    texts = {}
    for kind, i, _, text in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0], r[1], r[2])):
        texts.setdefault((kind, i), []).append(text)
    return [(*k, "\n".join(v)) for k, v in texts.items()]


def spans_of(df, keep):
    return sorted(str(tuple(r)) for r in df.select("citing_kind", "citing_id", "raw", "kind", "case_citation", "act_number", "statute_title", "provision_no", *keep).distinct().collect())


@pytest.mark.parametrize("partitions", [1, 9])
def test_equal_to_the_joined_text(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(60):
        for p in range(rng.choice([1, 2, 5, 40 if i % 20 == 0 else 3])):
            text = None if rng.random() < 0.05 else "" if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
            rows.append((rng.choice(["case", "statute"]) if i % 2 else "case", i, p * 3, text))
    rows += [("case", 900, 0, "See Republic Act"), ("case", 900, 1, "No."), ("case", 900, 2, ""), ("case", 900, 3, "77 and Art. 5,"), ("case", 900, 4, "Sec. 2 of RA 7. Art. 5,"), ("case", 900, 5, "Sec. 2 of RA 7. G.R."), ("case", 900, 6, "No. 44.")]
    df = spark.createDataFrame(rows, "citing_kind string, citing_id long, passage long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tails = borders.with_tails(df, 30).collect()
        got = spans_of(borders.border_spans(df), [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = joined(rows)
    by_text = {}
    for r in sorted(tails, key=lambda r: (r["citing_kind"], r["citing_id"], r["passage"])):
        by_text.setdefault((r["citing_kind"], r["citing_id"]), []).append(r)
    for kind, i, whole in texts:
        at, before = 0, None
        for r in by_text[kind, i]:
            at += len(r["text"])
            assert r["tail"] == whole[at : at + 30] and r["before"] == before
            at, before = at + 1, r["passage"]
    want = citations.extract_citations(spark.createDataFrame(texts, "citing_kind string, citing_id long, text string"), max_spans=None)
    assert got == spans_of(want, [])
    assert any("\\n" in r for r in got)


def test_edges_and_the_bound_of_spans_are_those_of_the_joined_text(spark):
    statutes = spark.createDataFrame([(k, f"Law {k}", f"Law {k}", str(k)) for k in range(300)], "id long, short_title string, official_title string, act_number string")
    cases = spark.createDataFrame([(k, f"G.R. No. {k}") for k in range(20)], "id long, citation string")
    rng = random.Random(4)
    rows = [("case", i, p, " ".join(rng.choice(["RA 5", "RA", "G.R. No. 3", "No. 7", f"RA {rng.randrange(300)}", "and"]) for _ in range(rng.randint(1, 90)))) for i in range(8) for p in range(6)]
    df = spark.createDataFrame(rows, "citing_kind string, citing_id long, passage long, text string")
    texts = spark.createDataFrame(joined(rows), "citing_kind string, citing_id long, text string")
    for bound in (200, 20, None):
        split, whole = (citations.build_graph(x, statutes, cases, max_spans=bound) for x in (df, texts))
        assert sorted(map(tuple, split.edges.collect())) == sorted(map(tuple, whole.edges.collect()))
        assert split.counters.collect() == whole.counters.collect()


def test_no_passages(spark):
    df = spark.createDataFrame([("case", 1, 1, None)], "citing_kind string, citing_id long, passage long, text string")
    assert borders.border_spans(df).isEmpty() and borders.border_spans(df.filter(F.lit(False))).isEmpty()


def test_listed_texts_are_searched_as_one(spark):
    """an array of texts has the citations of the joined text, each with the text in which it first starts; no citation is too long."""
    rng = random.Random(11)
    rows = [(i, [None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]) for i in range(150)]
    rows += [(900, ["See Republic Act", None, "", " " * 600 + "No.", "77. RA 5", "and RA 5"]), (901, None), (902, [None])]
    found = [r.asDict() for r in citations.listed_spans(spark.createDataFrame(rows, "id int, texts array<string>")).collect()]
    whole = {i: "\n".join(t for t in texts if t is not None) for i, texts in rows if texts is not None}
    want = citations.extract_citations(spark.createDataFrame(list(whole.items()), "id int, text string"), max_spans=None)
    columns = ("id", "place", "raw", "kind", "case_citation", "act_number", "statute_title", "provision_no")
    assert sorted(str([r[c] for c in columns]) for r in found) == sorted(str([r[c] for c in columns]) for r in want.collect())
    assert {(r["raw"], r["passage"]) for r in found if r["id"] == 900} == {("Republic Act\n\n" + " " * 600 + "No.\n77", 0), ("RA 5", 4)}
    texts = dict(rows)
    assert all((texts[r["id"]][r["passage"]] or "").endswith(r["raw"].split("\n")[0]) or r["raw"].split("\n")[0] in texts[r["id"]][r["passage"]] for r in found)
