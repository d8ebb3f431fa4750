import pytest
from pyspark.sql import functions as F

from quern.operators import citations, graph, lookup
from quern.sources import registry


@pytest.fixture(scope="module")
def corpus(spark):
    statutes = spark.createDataFrame(
        [(1, "Civil Code", "Civil Code of the Philippines", "code", "386", "civil", "in_force"), (2, "Data Privacy Act", "Act on data", "republic_act", "10173", "special", "in_force"), (3, "Civil Service Law", "On service", "republic_act", "77", "civil", "in_force")],
        "id long, short_title string, official_title string, kind string, act_number string, domain string, status string",
    )
    provisions = spark.createDataFrame(
        [(1, 1, "1156", "Obligation", "An obligation is a juridical necessity.", "in_force", "1950-08-30", None), (2, 1, "5", None, "old text", "in_force", "1950-08-30", None), (3, 1, "5", None, "new text", "in_force", "2001-01-01", None), (4, 1, "Art. 7", None, "stored with prefix", "in_force", "1950-08-30", None)],
        "id long, statute_id long, provision_no string, heading string, body string, status string, valid_from string, valid_until string",
    )
    none = "promulgation_date string, ponente string, division string, status string, source_url string"
    cases = spark.createDataFrame([(1, "G.R. No. 238875", "A v. B", "sc", None, None, None, "reported", None), (2, "G.R. No. 238876", "C v. D", "ca", None, None, None, "reported", None)], f"id long, citation string, title string, court string, {none}")
    texts = spark.createDataFrame(
        [("case", 1, "Art. 1156, Civil Code and Art. 5, Civil Code, and G.R. No. 238876. See G.R. No. 238875 too. The IRR of RA 10173 apply. Unknown: RA 999."), ("case", 2, "Art. 5, Civil Code. See G.R. No. 238875."), ("statute", 2, "This amends Republic Act No. 386.")],
        "citing_kind string, citing_id long, text string",
    )
    return statutes, provisions, cases, citations.build_graph(texts, statutes, cases), texts


def test_extraction(spark):
    text = (
        "See G.R. No. 238875 and g.r. no. L-12345.\nArt. VIII, Sec. 13 of the 1987 Constitution is clear.\n"
        "Art. 1156, Civil Code, on the meaning of duty.\nSec. 5(b) of Republic Act No. 9165, which binds all.\nThe IRR of RA 10173 apply.\nSee RA 10173. See RA 10173 again; also éRA 386 and RA 442."
    )
    rows = [r.asDict() for r in citations.extract_citations(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("place").collect()]
    raws = [r["raw"] for r in rows]
    assert len(raws) == len(set(raws))
    assert [r["case_citation"] for r in rows if r["kind"] == "case"] == ["G.R. No. 238875", "G.R. No. L-12345"]
    assert ("1987 Constitution", "VIII-13") in [(r["statute_title"], r["provision_no"]) for r in rows]
    assert ("9165", "5(B)") in [(r["act_number"], r["provision_no"]) for r in rows]
    assert [r["act_number"] for r in rows if (r["statute_title"] or "").startswith("IRR")] == ["10173"]
    assert {"386", "442"} <= {r["act_number"] for r in rows}
    capped = citations.extract_citations(spark.createDataFrame([(1, text)], "id int, text string"), max_spans=3)
    assert [r["raw"] for r in capped.orderBy("place").collect()] == raws[:3]


def test_all_spans_of_many_passages(spark, corpus):
    acts = [f"See Republic Act No. {k}." for k in range(1, 301)]
    whole = spark.createDataFrame([("case", 1, "G.R. No. 238875 holds.\n" + "\n".join(acts))], "citing_kind string, citing_id long, text string")
    assert citations.extract_citations(whole, max_spans=None).count() == 301
    cut = spark.createDataFrame([("case", 1, k, "G.R. No. 238875 holds.\n" + "\n".join(acts[k * 100 : k * 100 + 100])) for k in range(3)], "citing_kind string, citing_id long, passage long, text string")
    assert citations.build_graph(cut, corpus[0], corpus[2], max_spans=None).counters.first() == citations.build_graph(whole, corpus[0], corpus[2], max_spans=None).counters.first() == (301, 1, 300, 1)


def test_passages_give_the_edges_of_the_whole_text(corpus, spark):
    rows = [r.asDict() for r in corpus[4].collect()]
    pieces = [(r["citing_kind"], r["citing_id"], n, piece) for r in rows for n, piece in enumerate(r["text"].replace(". See", ".|See").replace(". The IRR", ".|The IRR").replace(". Unknown", ".|Unknown").split("|"))]
    assert len(pieces) > len(rows)
    got = citations.build_graph(spark.createDataFrame(pieces, "citing_kind string, citing_id long, passage int, text string"), corpus[0], corpus[2])
    assert sorted(got.edges.collect()) == sorted(corpus[3].edges.collect()) and got.counters.first() == corpus[3].counters.first()


def test_a_customer_may_cite_any_number_of_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.plans import graph_queries

    n = 100_500
    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.col("id").alias("l_linenumber"), F.lit(1.0).alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert graph_queries.citation_round_trip(spark, str(tmp_path)).distinct().count() == n
    assert graph_queries._citing_texts(spark, str(tmp_path)).agg(F.max(F.length("text"))).first()[0] < 40_000


def test_edges(corpus):
    edges = {(r["citing_kind"], r["citing_id"], r["cited_kind"], r["cited_id"], r["cited_reference"]) for r in corpus[3].edges.collect()}
    assert edges == {
        ("case", 1, "case", 2, "G.R. No. 238876"),
        ("case", 1, "statute", 1, "Art. 1156, Civil Code"),
        ("case", 1, "statute", 2, "The IRR of RA 10173"),
        ("case", 2, "case", 1, "G.R. No. 238875"),
        ("case", 2, "statute", 1, "Art. 5, Civil Code"),
        ("statute", 2, "statute", 1, "Republic Act No. 386"),
    }
    n = corpus[3].counters.first()
    assert n["spans"] == n["resolved"] + n["unresolved"] and n["edges_inserted"] == 6
    again = citations.build_graph(corpus[4], corpus[0], corpus[2]).edges
    assert citations.missing_edges(again, corpus[3].edges).isEmpty()


def test_graph_queries(spark, corpus):
    statutes, provisions, cases, built, _ = corpus
    edges = built.edges
    assert [r["shortTitle"] for r in graph.related_laws(edges, statutes, cases, "gr no 238875").collect()] == ["Civil Code", "Data Privacy Act"]
    assert [(r["citation"], r["sharedStatutes"]) for r in graph.related_cases(edges, cases, "G.R. No. 238875").collect()] == [("G.R. No. 238876", 1)]
    assert {r["kind"] for r in graph.show_citations(edges, statutes, cases, "G.R. No. 238875").collect()} == {"case", "statute"}
    assert graph.resolve_case(cases, "G.R. No. 1").isEmpty()
    forward, back = graph.show_dependencies(edges, statutes, "Data Privacy Act")
    assert [r["shortTitle"] for r in forward.collect()] == ["Civil Code"] and back.isEmpty()
    assert [r["shortTitle"] for r in graph.show_dependencies(edges, statutes, "nothing", "386")[1].collect()] == ["Data Privacy Act"]
    assert [r["citingCitation"] for r in graph.show_implementing_rules(edges, statutes, cases, "Data Privacy Act").collect()] == ["G.R. No. 238875"]
    refs = [tuple(r) for r in graph.show_cross_references(edges, statutes, registry.registry(spark), "data privacy act").select("kind", "targetSlug", "shortTitle").collect()]
    assert refs == [("domain", t, None) for t in ("commercial-corporate", "labor", "criminal", "administrative")] + [("statute", None, "Civil Code")]
    assert {r["citing_id"] for r in graph.cases_citing_statute(edges, 1).collect()} == {1, 2}
    with pytest.raises(ValueError):
        graph.related_laws(edges, statutes, cases, "x", 51)


def test_title_must_be_unique(corpus):
    statutes = corpus[0]
    assert graph.resolve_statute(statutes, "Civil Code").first()["id"] == 1
    assert graph.resolve_statute(statutes, "civil").isEmpty()
    assert graph.resolve_statute(statutes, "privacy").first()["id"] == 2


def test_history_and_amendments(spark, corpus):
    statutes, provisions = corpus[:2]
    assert [r["body"] for r in graph.show_history(provisions, statutes, "Civil Code", "5").collect()] == ["old text", "new text"]
    log = spark.createDataFrame([(1, 1, "RA 11466", None, "5", "2020-01-01", None, None), (2, 1, "RA 1", None, None, None, None, None)], "id long, statute_id long, amending_law string, amending_law_id long, provision_no string, effective_date string, summary string, note string")
    assert [r["amendingLaw"] for r in graph.show_amendments(log, statutes, "Civil Code").collect()] == ["RA 1", "RA 11466"]


def test_lookups(spark, corpus):
    statutes, provisions, cases = corpus[:3]
    assert lookup.get_provision(provisions, statutes, "CIVIL CODE", "Art. 5").first()["body"] == "new text"
    assert lookup.get_provision(provisions, statutes, "Civil Code", "Article 5").isEmpty()
    assert lookup.get_provision(provisions, statutes, "Civil Code", "7").first()["body"] == "stored with prefix"
    ok = lambda **k: lookup.cite_validate(provisions, statutes, cases, **k).first()["status"]
    assert ok(statute="Civil Code", provision="Art. 1156") == "validated"
    assert ok(statute="Civil Code", provision="7") == "cannot_validate"
    assert ok(statute="Civil Code") == "validated"
    assert ok(case_citation="g.r. no. 238875") == "validated"
    assert ok(case_citation="G.R. No. 9") == "cannot_validate"
    assert ok() == "invalid_request"
    passages = spark.createDataFrame([(k, 1, k, None, f"p{k}") for k in range(1, 31)], "id long, case_id long, passage_no int, heading string, body string")
    found = lookup.get_case(cases, passages, "G.R. NO. 238875").first()
    assert found["passageCount"] == 20 and found["passages"][0]["body"] == "p1"
    assert [p["provision_no"] for p in lookup.statute_payload(statutes, provisions, "Civil Code").first()["provisions"]] == ["Art. 7", "5", "5", "1156"]
    domains = lookup.list_domains(registry.domain_names(spark), registry.registry(spark)).collect()
    assert len(domains) == 15 and domains[0]["keyInstruments"] == []
    big = spark.createDataFrame([(["x" * 1000] * 60,), (["y"],)], "items array<string>")
    assert sorted((r["truncated"], len(r["items"])) for r in lookup.bounded(big, "items").collect()) == [(False, 1), (True, 50)]
    texts = spark.createDataFrame([("x" * 30_000,), ("y",)], "payload string").select(lookup.rendered(F.col("payload"))).collect()
    assert sorted(len(r[0]) for r in texts) == [1, 25_014] and [r[0].endswith("… [truncated]") for r in texts] == [True, False]


def test_titles_with_a_hint(spark):
    from collections import defaultdict

    import random

    from quern.operators.citations import titles_with

    rnd = random.Random(8)
    keys = [(k, "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 14)))) for k in range(60)]
    hints = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 11))) for _ in range(80)})
    got = {r["title_key"]: (r["n"], r["title_id"]) for r in titles_with(spark.createDataFrame([(h,) for h in hints], "title_key string"), spark.createDataFrame(keys, "id int, key string")).collect()}
    want = defaultdict(set)
    for h in hints:
        for k, key in keys:
            if h in key:
                want[h].add(k)
    assert got == {h: (len(ids), min(ids)) for h, ids in want.items()}


def test_texts_are_searched_in_one_pass(spark):
    """One pass finds what each pattern finds in Spark's own dialect, each raw text once."""
    import random

    from pyspark.sql import functions as F

    from quern.operators import citations

    rng = random.Random(4)
    bits = ["G.R. No. L-12", "g.r. no. 3", "Art. VII, Sec. 5 of the 1987 Constitution", "Art. 7-a of the Civil Code", "Sec. 9(b), RA 5", "IRR of RA 77", "Republic Act No. 8", "E.O. 9x", "R. A. 10", "Act No. 4", "The", " and ", ", ", ". ", "\n", "Q", "_", "ſec. 4 of X", "P.D. 6", "Art. 5 of the , ."]
    texts = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 12)))) for k in range(400)] + [(400, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    found = citations.extract_citations(df, max_spans=None)
    got = {(r["id"], r["raw"]) for r in found.collect()}
    raws = df.select("id", F.explode(F.concat(*(F.regexp_extract_all("text", F.lit("(?i)" + citations.PATTERNS[k]), F.lit(0)) for k in citations.ORDER))).alias("raw"))
    want = {(r["id"], r["raw"]) for r in raws.collect()}
    assert got <= want and len(got) > 300 and {raw for _, raw in want - got} <= {raw for _, raw in want if raw.rstrip(" .,;").lower().endswith(("of", "of the"))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_look_ups_of_spans_are_not_broadcast(spark):
    """Small files may hold many keys, so neither statutes nor cases nor titles go whole to the driver."""
    from quern.operators import citations

    spans = spark.createDataFrame([("1", "statute", "5", None, None), ("2", "case", None, None, "G.R. No. 1"), ("3", "statute", None, "Long title of", None)], "span_id string, kind string, act_number string, statute_title string, case_citation string")
    statutes = spark.createDataFrame([(1, "Long title of things", "x", "5")], "id long, short_title string, official_title string, act_number string")
    cases = spark.createDataFrame([(9, "G.R. No. 1")], "id long, citation string")
    found = citations.resolve_spans(spans, statutes, cases)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["span_id"], r["statute_id"], r["case_id"]) for r in found.collect()) == [("1", 1, None), ("2", None, 9), ("3", 1, None)]


def test_stream_batches_have_many_files(spark, sf_dir, tmp_path, monkeypatch):
    """No task writes or reads a whole batch of references."""
    from quern.plans import graph_queries

    monkeypatch.setattr(graph_queries, "new_folder", lambda spark: str(tmp_path))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        streamed = graph_queries.edges_streamed(spark, sf_dir)
        assert sorted(map(str, streamed.collect())) == sorted(map(str, graph_queries.edges_dedup(spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(list((tmp_path / "references").glob("*.parquet"))) == 12
    assert len(list((tmp_path / "edges").glob("batch=*"))) == 3


def test_resolution_leaves_no_shuffles_and_shuffles_spans_once(spark, sf_dir):
    """what the steps of a graph shuffled goes with them, and edges shuffle what was found once."""
    from quern.plans import graph_queries

    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    blocks = lambda: {b for b in kept.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = blocks()
    edges = graph_queries.resolve_edges(spark, sf_dir)
    assert not blocks() - before
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert graph_queries._citing_texts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3


def test_titles_are_cut_into_runs_only_for_hints_that_ask(spark):
    """without a title to look for, or with exact ones alone, the runs of all titles are not shuffled."""
    statutes = spark.createDataFrame([(1, "Long title of things", "x", "5"), (2, "Another title", "y", "6")], "id long, short_title string, official_title string, act_number string")
    cases = spark.createDataFrame([], "id long, citation string")
    for title, wanted in ((None, None), ("Another title", 2), ("title of", 1), ("ofth", 1), ("nowhere to be found", None)):
        spans = spark.createDataFrame([("1", "statute", None, title, None)], "span_id string, kind string, act_number string, statute_title string, case_citation string")
        found = citations.resolve_spans(spans, statutes, cases)
        assert ("gram" in found._jdf.queryExecution().optimizedPlan().toString()) == (title in ("title of", "nowhere to be found"))
        assert [r["statute_id"] for r in found.collect()] == [wanted]
