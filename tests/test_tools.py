import json

import pytest

from quern.operators import evaluate
from quern.plans import tools
from quern.sources import ingest

SEED = [
    ("statute", {"sourceUrl": "u1", "retrievedAt": "t", "contentHash": "h", "shortTitle": "Civil Code", "officialTitle": "The Civil Code", "kind": "code", "actNumber": "386", "domain": "civil", "enactedDate": "1950-08-30", "provisions": [{"provisionNo": "1156", "heading": "Obligation", "body": "An obligation is a juridical necessity to give."}, {"provisionNo": "1144", "heading": None, "body": "Actions upon a written contract lapse in ten years."}]}),
    ("statute", {"sourceUrl": "u2", "retrievedAt": "t", "contentHash": "h", "shortTitle": "Privacy Act", "officialTitle": "Data Privacy Act", "kind": "republic_act", "actNumber": "10173", "domain": "special", "enactedDate": "2012-08-15", "provisions": [{"provisionNo": "1", "body": "This amends Republic Act No. 386 in part."}]}),
    ("case", {"sourceUrl": "u3", "retrievedAt": "t", "contentHash": "h", "citation": "G.R. No. 1", "title": "A v. B", "court": "sc", "passages": [{"passageNo": 1, "body": "See Art. 1156, Civil Code. The IRR of RA 10173 hold."}]}),
    ("issuance", {"sourceUrl": "u4", "retrievedAt": "t", "contentHash": "h", "agency": "BIR", "issuanceType": "Revenue Memorandum Circular", "referenceNo": "RMC 5-2020", "passages": [{"passageNo": 1, "body": "Returns are due in April."}]}),
]


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tools")
    (folder / "seed.jsonl").write_text("\n".join(json.dumps({"kind": k, "record": r}) for k, r in SEED))
    built = ingest.build_corpora(spark, ingest.load_seed(spark, str(folder)), "2024-01-01")
    ingest.write_corpora(built, f"{folder}/out")
    text = json.loads(ingest.manifest(built, "now", "2024.01.01", [], "seed", f"{folder}/out"))
    assert len(text["corpora"]["laws"]["sha256"]) == 64
    return ingest.open_corpora(spark, f"{folder}/out", views=True)


CALLS = [
    ("search_statute", {"query": "juridical necessity", "threshold": 0}, "ok", "Civil Code"),
    ("search_jurisprudence", {"query": "Civil Code", "threshold": 0}, "ok", "A v. B"),
    ("search_issuance", {"query": "april", "threshold": 0}, "ok", "RMC 5-2020"),
    ("get_provision", {"statute": "civil code", "provision": "Art. 1144"}, "ok", "ten years"),
    ("get_provision", {"statute": "civil code", "provision": "9"}, tools.NOT_COVERED, "[]"),
    ("get_case", {"citation": "g.r. no. 1"}, "ok", "A v. B"),
    ("get_issuance", {"agency": "bir", "referenceNo": "rmc 5-2020"}, "ok", "April"),
    ("cite_validate", {"caseCitation": "G.R. No. 1"}, "validated", "A v. B"),
    ("list_domains", {}, "ok", "constitutional"),
    ("statute", {"statute": "Privacy Act"}, "ok", "amends"),
    ("statute", {"statute": "None"}, "not_found", "[]"),
    ("related_laws", {"caseCitation": "G.R. No. 1"}, "ok", "Civil Code"),
    ("related_cases", {"caseCitation": "G.R. No. 1"}, "ok", "[]"),
    ("related_cases", {"caseCitation": "G.R. No. 2"}, tools.NOT_COVERED, "[]"),
    ("show_citations", {"caseCitation": "G.R. No. 1"}, "ok", "IRR of RA 10173"),
    ("show_amendments", {"statute": "Civil Code"}, "ok", "[]"),
    ("show_history", {"statute": "Civil Code", "provision": "1144"}, "ok", "1950-08-30"),
    ("show_dependencies", {"statute": "Privacy Act"}, "ok", "Civil Code"),
    ("show_implementing_rules", {"statute": "x", "actNumber": "10173"}, "ok", "G.R. No. 1"),
    ("show_cross_references", {"statute": "Privacy Act"}, "ok", "labor"),
    ("compute_prescription", {"actionType": "judgment", "causeOfActionDate": "2020-01-01"}, "ok", "2030-01-01"),
    ("compute_deadline", {"filingType": "appeal_rtc_to_ca", "noticeDate": "2026-01-05", "holidays": []}, "ok", "2026-01-20"),
    ("compute_13th_month", {"totalBasicSalary": 1200}, "ok", "100.0"),
]


@pytest.mark.parametrize("name, args, status, text", CALLS)
def test_tool(corpora, name, args, status, text):
    row = tools.call(corpora, name, args).first()
    assert row["status"] == status and text in row["payload"]


def test_domains_say_when_they_were_written(corpora):
    domains = json.loads(tools.call(corpora, "list_domains").first()["text"])
    assert {d["lastRefresh"] for d in domains} == {ingest.freshness(corpora["domains"].sparkSession, f"{corpora.folder}/laws")} != {None}


def test_all_tools_are_called():
    assert {c[0] for c in CALLS} == set(tools.TOOLS)


def test_golden(spark, corpora, tmp_path):
    pairs = [("ten years", "get_provision", {"statute": "Civil Code", "provision": "1144"}), ("blue", "get_case", {"citation": "G.R. No. 1"}), ("x", "get_provision", {"statute": "None", "provision": "1"})]
    xml = "".join(f"<qa_pair><question>q</question><answer>{a}</answer><plan><tool name='{t}' args='{json.dumps(g)}'/></plan></qa_pair>" for a, t, g in pairs)
    (tmp_path / "g.xml").write_text(f"<set>{xml}</set>")
    out = tools.run_golden(corpora, evaluate.read_golden(spark, str(tmp_path / "g.xml")))
    assert sorted((r["answer"], r["outcome"]) for r in out.collect()) == [("blue", "fail"), ("ten years", "pass"), ("x", "cover")]
    assert evaluate.summarise(out).first()["exit_code"] == 1


def test_a_golden_set_at_once_equals_one_by_one(spark, corpora):
    ask = lambda tool, **a: (tool, a)
    plans = [[ask("get_provision", statute="civil code", provision="Art. 1144")], [ask("get_provision", statute="None", provision="1")], [ask("get_case", citation="g.r. no. 1"), ask("get_provision", statute="The Civil Code", provision="1156")], [ask("get_case", caseCitation="G.R. No. 9"), ask("get_provision", statute="Privacy Act", provision="1")], []]
    rows = [(f"q{k}", a, p) for k, p in enumerate(plans) for a in ("ten years", "juridical", "1156", "amends", "")]
    golden = spark.createDataFrame(rows, "question string, answer string, plan array<struct<tool: string, args: map<string,string>>>")
    got = sorted(map(tuple, tools.run_golden_set(corpora, golden).collect()))
    assert got == sorted(map(tuple, tools.run_golden(corpora, golden).collect()))
    assert {g[2] for g in got} == {"pass", "fail", "cover"}
    with pytest.raises(ValueError):
        tools.run_golden_set(corpora, spark.createDataFrame([("q", "a", [("list_domains", {})])], golden.schema))
