import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import segment


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Art. 1.\r\n  Body   text.\r\n\r\n\r\nNext.", "Art. 1.\nBody text.\n\nNext."),
        ("  \n\t a \t \n", "a"),
        ("a ", "a"),
        ("", ""),
        ("one\ttwo  three", "one\ttwo three"),
    ],
)
def test_whitespace(spark, given, wanted):
    assert one(spark, given, text.normalise_whitespace) == wanted


def test_small_columns(spark):
    assert one(spark, "on 2024-13-99 and 2020-01-01", text.first_iso_date) == "2024-13-99"
    assert one(spark, "none", text.first_iso_date) is None
    assert one(spark, "G.R. No. L-12345", text.norm_key) == text.norm_key_of("g.r. no. l-12345") == "grnol12345"
    assert [one(spark, s, text.leading_int) for s in ("12-A", "Art. 5", " -3x", "")] == [12, 0, -3, 0]
    assert one(spark, "Article 1156", text.strip_provision_prefix) == "icle 1156"
    assert one(spark, "Sec. 5", text.strip_provision_prefix) == "5"
    assert one(spark, "Café ÀB ß 13th-month", text.tokens) == ["cafe", "ab", "ß", "13th", "month"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, "ÀBC", text.ascii_lower) == "Àbc"


def test_query_terms():
    assert text.query_terms('Waiver, "public policy"!') == ["waiver", "public", "policy"]
    assert text.query_terms("13th-month  Pag-IBIG ...") == ["13thmonth", "pagibig"]


def test_segments(spark):
    body = "The Title\nin force\nArticle 1. First things.\nbody one\nSECTION 2\n  body two\nArt. iv Last\nSection 3."
    rows = segment.segment_provisions(spark.createDataFrame([(1, body), (2, None), (3, "no heading")], "id int, text string")).orderBy("place").collect()
    assert [(r["number"], r["heading"], r["body"]) for r in rows] == [("1", "First things.", "First things.\nbody one"), ("2", "", "body two"), ("IV", "Last", "Last")]


def test_repeated_sections_are_reported(spark):
    rows = segment.segment_provisions(spark.createDataFrame([(1, "Section 1. a\nSection 1. b")], "id int, text string"))
    assert [tuple(r) for r in segment.repeated_numbers(rows, "id").collect()] == [(1, "1", 2)]


def naive_pack(paragraphs, most):
    """The packing rule for paragraphs that all fit."""
    out, held = [], []
    for p in paragraphs:
        if held and sum(len(h) + 2 for h in held) + len(p) + 2 > most:
            out.append("\n\n".join(held))
            held = []
        held.append(p)
    return [*out, "\n\n".join(held)] if held else out


def test_chunks(spark):
    paragraphs = [f"Paragraph {k} " + "word " * 25 for k in range(5)]
    paragraphs = [p.strip() for p in paragraphs]
    assert segment.pack("\n\n".join(paragraphs), 200) == naive_pack(paragraphs, 200)
    assert segment.pack("", 10) == []
    long = " ".join(f"Word number {k}." for k in range(500))
    parts = segment.pack(long, 100)
    assert all(len(p) <= 101 for p in parts) and sum(p.count("Word") for p in parts) == 500
    assert segment.pack("x" * 250, 100) == ["x" * 100, "x" * 100, "x" * 50]
    rows = segment.chunk_into_passages(spark.createDataFrame([(1, long), (2, " \n "), (3, None)], "id int, text string"), max_chars=100)
    assert [r["passage_no"] for r in rows.orderBy("passage_no").collect()] == list(range(1, len(parts) + 1))


def plain_passages(body, most):
    """Passages of a text by a loop over positions, without patterns."""
    least, done, now, size = int(0.6 * most) + 1, [], [], 0
    for p in body.split("\n\n"):
        if not p.strip():
            continue
        if len(p) <= most:
            if now and size + len(p) + 2 > most:
                done.append(now)
                now, size = [], 0
            now.append(p)
            size += len(p) + 2
            continue
        if now:
            done.append(now)
        while len(p) > most:
            ends = [k + 1 for k in range(least, most + 1) if p[k : k + 2] == ". "]
            blanks = [k for k in range(least, most + 1) if p[k : k + 1] == " "]
            at = max(ends or blanks or [most])
            done.append([p[:at].strip()])
            p = p[at:].strip()
        now, size = ([p], len(p)) if p else ([], 0)
    return ["\n\n".join(x) for x in done + ([now] if now else [])]


@pytest.mark.parametrize("name, broken, most", [("chunk_passages", True, segment.PASSAGE_CHARS), ("chunk_long_paragraphs", False, segment.ISSUANCE_CHARS)])
def test_chunk_queries_equal_a_plain_loop(spark, sf_dir, name, broken, most):
    from quern.plans.registry import QUERIES

    body = F.replace("text", F.lit("\n"), F.lit("\n\n")) if broken else F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalise_whitespace(F.coalesce(body, F.lit(""))).alias("body")).collect()
    wanted = sorted((r["doc_id"], k + 1, b) for r in docs for k, b in enumerate(plain_passages(r["body"], most)))
    got = sorted((r["doc_id"], r["passage_no"], r["body"]) for r in QUERIES[name](spark, sf_dir).collect())
    assert got == wanted and max(r[1] for r in got) > 1


def test_tax_issuance(spark):
    body = "Republic\nBureau of Internal Revenue\n\nREVENUE MEMORANDUM CIRCULAR NO. 85-2023\n\nSUBJECT: On filing of returns\n\nDated 2023-08-01"
    row = segment.normalise_issuance(spark.createDataFrame([(body,), ("just words\nmore",)], "text string")).orderBy("agency", "reference_no").collect()
    assert [(r["issuance_type"], r["reference_no"], r["title"], r["issue_date"], r["agency"]) for r in row] == [
        ("Revenue Memorandum Circular", "RMC 85-2023", "On filing of returns", "2023-08-01", "BIR"),
        ("Other Issuance", "UNKNOWN", "just words", None, "BIR"),
    ]
    over = segment.normalise_issuance(spark.createDataFrame([(body,)], "text string"), overrides={"agency": "X", "title": "T"}).first()
    assert (over["agency"], over["title"]) == ("X", "T")


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("Department of Labor and Employment\nDEPARTMENT ORDER NO. 174-17\nSubject: rules", ("DOLE", "Department Order", "Department Order 174-17", "rules")),
        ("Town Council\nORDINANCE NO. 12\nAn act", ("National Government Agency", "Ordinance", "Ordinance 12", "Town Council")),
        ("SOCIAL SECURITY SYSTEM\nCIRCULAR No. 2020-01", ("SSS", "Circular", "Circular 2020-01", "SOCIAL SECURITY SYSTEM")),
        ("ADVISORY on storms\nstay in", ("National Government Agency", "Advisory", "Advisory", "stay in")),
    ],
)
def test_agency_issuance(spark, body, wanted):
    r = segment.normalise_agency_issuance(spark.createDataFrame([(body,)], "text string")).first()
    assert (r["agency"], r["issuance_type"], r["reference_no"], r["title"]) == wanted


def by_lines(text):
    """Sections of a text, line by line."""
    import re

    white = segment._WHITE
    heads = (r"(?:ARTICLE|ART\.?)[%s]+([IVXLCDM]+|[0-9]+)\.?[%s]*(.*)" % (white, white), r"(?:SECTION|SEC\.?)[%s]+([0-9]+)\.?[%s]*(.*)" % (white, white))
    out = []
    for line in text.split("\n"):
        line = line.strip(white)
        found = next((m for h in heads if (m := re.fullmatch(h, line, re.I))), None)
        if found:
            out.append([found[1].upper(), found[2].strip(white), [found[2].strip(white)]])
        elif out:
            out[-1][2].append(line)
    rows = [(n, h, "\n".join(b).strip(white)) for n, h, b in out]
    return [r for r in rows if r[1] or r[2]]


def test_segments_equal_lines(spark):
    import random

    rnd = random.Random(6)
    parts = ["Section 5", "SECTION 7.", "Art. IV.  Of things ", "article 12 x", " Sec.\t3\r", "Sections 4", "Section", "　", "", "words and words", "see Section 9", "ART 1 b", "Sec. 2.."]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {}
    for r in segment.segment_provisions(df).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["number"], r["heading"], r["body"]))
    assert all(got.get(k, []) == by_lines(t) for k, t in enumerate(texts))


def test_a_long_text_is_segmented(spark):
    text = "\n".join(f"Section {k}. Heading {k}\n  body of {k}" for k in range(20_000))
    rows = segment.segment_provisions(spark.createDataFrame([(1, text)], "id int, text string"))
    assert rows.filter("body = concat('Heading ', number, '\nbody of ', number)").count() == 20_000


def test_texts_are_split_once_and_by_a_plain_pattern(spark):
    """Spark compiles the pattern of a split anew for each row."""
    body = "Section 1. a\n\tSection 2. b\tc\n \t \nSection 3. d\n\t\tArt. X\te\nx\tSection 4"
    rows = segment.segment_provisions(spark.createDataFrame([(1, body)], "id int, text string"))
    assert [(r["number"], r["body"]) for r in rows.orderBy("place").collect()] == [("1", "a"), ("2", "b\tc"), ("3", "d"), ("X", "e\nx\tSection 4")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_blanks_are_the_same_set_in_every_form(spark):
    letters = spark.createDataFrame([(chr(k),) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000], "c string")
    of = lambda pattern: {r["c"] for r in letters.filter(F.col("c").rlike(pattern)).collect()}
    assert of(text.SPACE) == set(text.SPACES) == {r["c"] for r in letters.filter(text.trim_space(F.col("c")) == "").collect()}
    assert of(text.BLANK) == of(f"(?i){text.BLANK}") == set(text.SPACES) - {"\n"}


def test_sections_carry_their_texts_hash(spark):
    texts = spark.createDataFrame([(1, "Section 1.  a\r\nSection 2. b"), (2, "no heading"), (3, None)], "id int, text string")
    clean, sections = segment.normalise_statute(texts)
    hashes = {r["id"]: r["content_hash"] for r in clean.collect()}
    assert [(r["id"], r["number"], r["content_hash"]) for r in sections.orderBy("place").collect()] == [(1, "1", hashes[1]), (1, "2", hashes[1])]


def test_normalised_statutes_builds_texts_once(spark, sf_dir):
    from quern.plans.registry import QUERIES

    assert QUERIES["normalised_statutes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
