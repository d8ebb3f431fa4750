import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate
from quern.sources import html, ingest, registry, robots, schemas
from quern.streaming import ingest as streaming


def seed_lines():
    base = {"sourceUrl": "https://x/1", "retrievedAt": "2024-01-01", "contentHash": "0" * 64}
    statute = base | {"shortTitle": "Civil Code", "officialTitle": "The Civil Code", "kind": "code", "actNumber": "386", "domain": "civil", "enactedDate": "1950-08-30", "provisions": [{"provisionNo": "1", "heading": "H", "body": "Text one."}, {"provisionNo": "2", "body": "Text two.", "validFrom": "1999-01-01"}]}
    case = base | {"citation": "G.R. No. 1", "title": "A v. B", "court": "sc", "passages": [{"passageNo": 1, "body": "We cite RA 386."}]}
    issuance = base | {"agency": "BIR", "issuanceType": "RMC", "referenceNo": "RMC 1-2023", "passages": [{"passageNo": 1, "body": "Pay."}]}
    return [{"kind": "statute", "record": statute}, {"kind": "case", "record": case}, {"kind": "issuance", "record": issuance}, {"kind": "case"}]


@pytest.fixture()
def seed(tmp_path):
    folder = tmp_path / "seed"
    folder.mkdir()
    (folder / "all.jsonl").write_text("\n\n".join(json.dumps(x) for x in seed_lines()) + "\n")
    return str(folder)


def test_build(spark, seed, tmp_path):
    rows = ingest.load_seed(spark, seed)
    assert rows.count() == 3
    assert ingest.load_seed(spark, str(tmp_path / "nothing")).isEmpty()
    built = ingest.build_corpora(spark, rows, "2024-05-05")
    ingest.write_corpora(built, str(tmp_path / "out"))
    ingest.write_corpora(built, str(tmp_path / "out"))
    again = ingest.open_corpora(spark, str(tmp_path / "out"))
    assert [(r["provision_no"], r["valid_from"]) for r in again["provisions"].orderBy("id").collect()] == [("1", "1950-08-30"), ("2", "1999-01-01")]
    assert [(r["citing_kind"], r["cited_kind"], r["cited_reference"]) for r in again["edges"].collect()] == [("case", "statute", "RA 386")]
    assert again["amendments"].isEmpty()
    assert {r["n"] for r in schemas.integrity({k: again[k] for k in schemas.TABLES}).collect()} == {0}
    text = json.loads(ingest.manifest(again, "now", "2024.05.05", [], seed))
    assert text["schemaVersion"] == 1 and text["corpora"]["laws"] == {"records": 1, "passages": 2}
    assert ingest.freshness(spark, str(tmp_path / "out/laws/statutes")) is not None
    assert ingest.freshness(spark, str(tmp_path / "none")) is None
    assert ingest.open_corpora(spark, str(tmp_path / "none"))["cases"].isEmpty()


def test_bad_seed_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        ingest.load_seed(spark, str(tmp_path)).collect()


def test_vocabulary(spark):
    cases = spark.createDataFrame([("sc",), ("xx",), (None,)], "court string")
    assert schemas.violations(cases, "cases").count() == 2


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"data")
    found = ingest.file_checksums(spark, str(tmp_path))
    good = spark.createDataFrame([("a.bin", hashlib.sha256(b"data").hexdigest())], "file string, sha256 string")
    assert ingest.failed_checksums(found, good).isEmpty()
    bad = spark.createDataFrame([("a.bin", "00"), ("b.bin", "11")], "file string, sha256 string")
    assert ingest.failed_checksums(found, bad).count() == 2
    assert spark.range(1).select(ingest.parse_checksum(F.lit("ABC  a.bin"))).first()[0] == "abc"


def test_pages(spark):
    body = "word " * 40
    page = f"<html><body><nav>menu</nav><h1 class='entry-title'> The Title </h1><article class='entry-content'><script>x()</script><p>{body}</p></article><footer>end</footer></body></html>"
    title, text = html.article(page)
    assert title == "The Title" and text.strip() == body.strip()
    assert html.article("<body><p>short</p></body>", ("#nothing",))[1] == "short"
    assert html.article(None) == (None, "")
    assert html.article("<table><td>no</td><td valign='top'>" + body + "</td></table>", html.TABLE_SELECTORS)[1].strip() == body.strip()
    catalogue = spark.createDataFrame([(1, "https://a/1", "2000-01-01", "One"), (2, "https://a/2", None, "Two"), (3, "https://a/3", "1990-01-01", "Old"), (4, "https://b/4", None, "Other")], "place int, source_url string, enacted_date string, short_title string")
    pages = spark.createDataFrame([(f"https://{s}/{k}", page) for s, k in (("a", 1), ("a", 2), ("a", 3), ("b", 4))], "url string, html string")
    got = ingest.targets(catalogue, pages, "https://a/", since="1995-01-01")
    assert [r["short_title"] for r in got.orderBy("place").collect()] == ["One", "Two"]
    existing = spark.createDataFrame([("One", "https://a/1")], "short_title string, source_url string")
    assert [r["short_title"] for r in ingest.new_documents(got, existing).collect()] == ["Two"]


def test_statutes_from_pages(spark):
    docs = spark.createDataFrame([("https://a/1", "One", "Official", "9", "2000-01-01", "code", "civil", "Section 1. First.\nSection 2. Second.", "t", "<p>")], "source_url string, short_title string, official_title string, act_number string, enacted_date string, kind string, domain string, text string, title string, html string")
    rows = ingest.statutes_from_pages(docs)
    statutes, provisions = ingest.statute_tables(rows.withColumn("retrievedAt", F.lit("now")), "2024-01-01")
    assert [r["provision_no"] for r in provisions.orderBy("id").collect()] == ["1", "2"] and statutes.first()["act_number"] == "9"


def test_robots(spark):
    text = "# note\nUser-agent: *\nDisallow: /private\n\nUser-agent: bot\nDisallow:\n\nUser-agent: botnet\nDisallow: /a\n"
    rules = robots.rules_table(spark, text)
    prefixes = lambda agent: [r["prefix"] for r in robots.rules_for_agent(rules, agent).collect()]
    assert prefixes("other/1") == ["/private"] and prefixes("Bot/1.0") == [] and prefixes("botnet/2") == ["/a"]
    pages = spark.createDataFrame([("http://h/private/x",), ("http://h/open",), ("http://h",)], "url string")
    assert robots.allowed_pages(pages, robots.rules_for_agent(rules, "zzz")).count() == 2
    assert robots.allowed_pages(pages, robots.rules_for_agent(rules, "bot")).count() == 3


def test_robots_by_join(spark):
    """Many prefixes are joined, with the same pages left, and no nested loop."""
    urls = [None, "", "http://h", "http://h/", "http://h/a", "http://h/ab/c?q=/z", "http://h/z/ab", "http://h/ß/x", "http://h/ß/x", "no url"]
    pages = spark.createDataFrame([(u, "clash") for u in urls], "url string, prefix string")
    for prefixes in (["/ab", "/z/"], ["/"], ["/ß/", "ab", "", None, "/ab", "/ab"], ["/longer/than/any/path/here"]):
        rules = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        wanted = sorted(map(str, robots.allowed_pages(pages, rules).collect()))
        joined = robots.allowed_pages(pages, rules, most_prefixes=0)
        assert sorted(map(str, joined.collect())) == wanted
        assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_registry(spark):
    assert registry.registry_problems(registry.registry(spark)).isEmpty()
    broken = spark.createDataFrame([("a", [("zz", None)]), ("a", [])], "slug string, crossRefs array<struct<target: string, reason: string>>")
    assert {r["problem"] for r in registry.registry_problems(broken).collect()} == {"duplicate slug", "dangling reference"}
    catalogue = spark.createDataFrame([("x", "1", "code", "u1", "civil"), ("x", "2", "code", "u2", "none")], "id string, act_number string, kind string, source_url string, domain string")
    assert {r["problem"] for r in ingest.catalogue_problems(catalogue, registry.domain_names(spark)).collect()} == {"duplicate id", "unknown domain"}


@pytest.mark.parametrize("text, answer, wanted", [("in 2024 only", "24", False), ("P250,000 due", "250,000", True), ("The  Quick\nbrown fox", "quick brown", True), ("category", "cat", False), ("a cat.", "Cat", True), ("x", "", False), ("a (b) c", "(b", False)])
def test_answers(spark, text, answer, wanted):
    assert spark.createDataFrame([(text, answer)], "t string, a string").select(evaluate.answer_matches(F.col("t"), F.col("a"))).first()[0] is wanted


def test_golden(spark, tmp_path):
    xml = """<evaluation><qa_pair><question> What? </question><answer>ten years</answer><plan><tool name="get_provision" args='{"statute": "Civil Code", "limit": 3}'/></plan></qa_pair>
<qa_pair><question>Who?</question><answer>he</answer><plan><tool name="a" args="{}"/><tool name="b" args="{}"/></plan></qa_pair></evaluation>"""
    (tmp_path / "golden.xml").write_text(xml)
    rows = evaluate.read_golden(spark, str(tmp_path / "golden.xml")).collect()
    assert rows[0]["question"] == "What?" and rows[0]["plan"][0]["args"] == {"statute": "Civil Code", "limit": "3"}
    assert [s["tool"] for s in rows[1]["plan"]] == ["a", "b"]
    out = spark.createDataFrame([("pass",), ("cover",)], "outcome string")
    assert evaluate.summarise(out).first()["exit_code"] == 0
    assert evaluate.summarise(out.filter("outcome = 'cover'")).first()["exit_code"] == 2


def test_stream(spark, seed, tmp_path):
    table = str(tmp_path / "table")
    with open(f"{seed}/more.jsonl", "w") as f:  # neither source nor hash
        f.write("\n".join([json.dumps({"kind": "case", "record": {"citation": "G.R. No. 2"}})] * 2))
    for run in range(2):  # with new state, as if replayed: finds nothing new
        streaming.ingest(streaming.first_of_source(streaming.seed_stream(spark, seed)), table, str(tmp_path / f"state{run}")).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_identifiers_follow_keys_over_ranges(spark):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 100).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("more")).repartition(7)
    found = ingest.numbered(rows, "key", "more").select("key", "more", "id")
    keys = sorted({(r["key"], r["more"]) for r in rows.collect()}, key=lambda k: (k[0], k[1] is not None, k[1]))
    assert {(r["key"], r["more"]): r["id"] for r in found.collect()} == {k: place + 1 for place, k in enumerate(keys)}
    assert found.count() == 500


def test_pages_are_parsed_in_bounded_batches(spark):
    """Pages stream through a task, whatever the rows of an Arrow batch hold; texts are as of single pages."""
    from quern.sources import html

    pages = [(k, f"<html><body><h1>T{k}</h1><article><p>{'word ' * (30 + k)}</p></article></body></html>") for k in range(50)] + [(50, None)]
    found = html.extract_article(spark.createDataFrame(pages, "page_id int, html string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got = {r["page_id"]: (r["title"], r["text"]) for r in found.collect()}
    assert got == {k: (t, x.strip()) for k, p in pages for t, x in [html.article(p)]}


def test_a_build_keeps_all_citations_of_an_entity(spark):
    """a case and a statute with more than 200 citations get an edge for each."""
    n = 230
    said = [f"RA {k} holds." for k in range(1, n + 1)]
    statutes = [{"kind": "statute", "record": {"shortTitle": f"Law {k:03}", "sourceUrl": f"u/{k}", "kind": "republic_act", "actNumber": str(k), "domain": "civil", "provisions": [{"provisionNo": "1", "body": " ".join(said) if k == n else "Nothing."}]}} for k in range(1, n + 1)]
    case = {"kind": "case", "record": {"citation": "G.R. No. 1", "title": "A v. B", "court": "sc", "passages": [{"passageNo": p, "body": " ".join(said[p::2])} for p in (0, 1)]}}
    seed = spark.createDataFrame([(json.dumps(x),) for x in [*statutes, case]], "value string").select(F.from_json("value", schemas.SEED).alias("r")).select("r.*")
    edges = ingest.build_corpora(spark, seed, "2024-05-05")["edges"]
    assert {(r["citing_kind"], r["n"]) for r in edges.groupBy("citing_kind").agg(F.countDistinct("cited_id").alias("n")).collect()} == {("case", n), ("statute", n - 1)}


def test_a_build_leaves_no_shuffles_and_compressed_seeds(spark, sf_dir, tmp_path, monkeypatch):
    """what a build shuffled goes with each step, tables are made of numbered records where they lie, and seed lines are compressed."""
    from quern.plans import build_queries

    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    blocks = lambda: {b for b in kept.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = blocks()
    monkeypatch.setattr(build_queries, "new_folder", lambda spark: str(tmp_path))
    build_queries.build_corpora(spark, sf_dir)
    assert not blocks() - before
    assert all(f.name.endswith(".gz") for f in (tmp_path / "seed").glob("part-*"))
    seed = ingest.load_seed(spark, f"{tmp_path}/seed", "*.txt.gz")
    tables = ingest.build_corpora(spark, seed, "2026-01-01", citations=False).tables
    assert all("Exchange" not in t._jdf.queryExecution().executedPlan().toString() for t in tables.values())
