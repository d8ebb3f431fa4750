"""Search, text and ingest queries on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.tables import new_folder
from quern.functions.text import ascii_upper, content_hash, first_iso_date, leading_int, normalise_whitespace
from quern.operators import evaluate, search, segment
from quern.sources import html, ingest, robots

from .registry import query, table

ASKED = "with this"
_TERMS = ("with", "this")

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\pL\pN]+'), lambda x: x <> '')"


def _scores(columns: tuple[str, ...] = ("text",), times: dict[str, int] | None = None, source: str = "documents") -> str:
    """SQL of all documents with every term and their BM25 score."""
    times = times or dict.fromkeys(_TERMS, 1)
    words = " || ".join(_TOKENS.format(c) for c in columns)
    tf = ", ".join(f"len(list_filter(words, lambda x: x = '{t}')) AS tf_{t}" for t in times)
    df = ", ".join(f"count(*) FILTER (WHERE tf_{t} > 0) AS df_{t}" for t in times)
    idf = lambda t: f"CASE WHEN ln((n - df_{t} + 0.5) / (df_{t} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df_{t} + 0.5) / (df_{t} + 0.5)) END"
    gain = " + ".join(f"{k} * ({idf(t)}) * (tf_{t} * 2.2 / (tf_{t} + 1.2 * (0.25 + 0.75 * dl / mean)))" for t, k in times.items())
    return f"""
WITH src AS ({source if source.strip().upper().startswith("SELECT") else f"SELECT * FROM {source}"}),
counted AS (SELECT * EXCLUDE (words), len(words) AS dl, {tf} FROM (SELECT *, {words} AS words FROM src)),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {df} FROM counted),
matched AS (SELECT c.*, {gain} AS bm25 FROM counted c CROSS JOIN stats WHERE {" AND ".join(f"tf_{t} > 0" for t in times)})"""


_CONFIDENCE = "0.5 * (bm25 / (bm25 + 5)) + 0.3 * ((contains(lower(text), 'with'))::INT + (contains(lower(text), 'this'))::INT) / 2.0 + 0.2 * (contains(lower(text), 'with this'))::INT"


def _documents(spark: SparkSession, sf_dir: str) -> search.Corpus:
    return search.Corpus(table(spark, sf_dir, "documents"), "doc_id", ("text",), "text")


def _result(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("doc_id", *columns, F.round("bm25", 6).alias("bm25"))


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched ORDER BY matched.bm25 DESC, doc_id LIMIT 50")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_documents(spark, sf_dir), ASKED, limit=50, threshold=0).rows)


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched WHERE lang = 'en' AND source = 'src3' ORDER BY matched.bm25 DESC, doc_id LIMIT 50")
def search_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_documents(spark, sf_dir), ASKED, filters={"lang": "en", "source": "src3"}, limit=50, threshold=0).rows)


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched ORDER BY matched.bm25 DESC, doc_id LIMIT 10 OFFSET 10")
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_documents(spark, sf_dir), ASKED, limit=10, offset=10, threshold=0).rows)


@query(_scores(times={"with": 2, "this": 1}) + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched ORDER BY matched.bm25 DESC, doc_id LIMIT 50")
def search_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_documents(spark, sf_dir), "with this With", limit=50, threshold=0).rows)


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched")
def search_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.scored(_documents(spark, sf_dir), ASKED))


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched")
def search_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _documents(spark, sf_dir)
    found = search.scored_by_postings(search.postings(corpus), search.corpus_stats(corpus), ASKED)
    return found.select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def _stored(corpus: search.Corpus) -> search.Index:
    return search.write_index(corpus, new_folder(corpus.passages.sparkSession))


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched ORDER BY matched.bm25 DESC, doc_id LIMIT 50")
def search_stored_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _documents(spark, sf_dir)
    return _result(search.search_stored(corpus, _stored(corpus), ASKED, limit=50, threshold=0))


@query(_scores() + "SELECT doc_id, round(bm25, 6) AS bm25 FROM matched WHERE lang = 'en' AND source = 'src3' ORDER BY matched.bm25 DESC, doc_id LIMIT 10 OFFSET 1")
def search_stored_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _documents(spark, sf_dir)
    return _result(search.search_stored(corpus, _stored(corpus), ASKED, filters={"lang": "en", "source": "src3"}, limit=10, offset=1, threshold=0))


# requests: two words of each benchmark item, every third in one source alone
_REQUESTS = "SELECT item_id AS request_id, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 2, 3), ' ') AS query, CASE WHEN row_number() OVER (ORDER BY item_id) % 3 = 0 THEN 'src1' END AS its_source FROM benchmark"


@query(
    f"""
WITH words AS (SELECT doc_id, source, {_TOKENS.format("coalesce(text, '')")} AS words FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM words),
postings AS (SELECT doc_id, source, dl, term, count(*) AS tf FROM (SELECT doc_id, source, len(words) AS dl, unnest(words) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
requests AS ({_REQUESTS}),
terms AS (SELECT request_id, its_source, term, count(*) AS times FROM (SELECT request_id, its_source, unnest({_TOKENS.format("query")}) AS term FROM requests) GROUP BY ALL),
needed AS (SELECT request_id, count(*) AS need FROM terms GROUP BY request_id),
scores AS (
  SELECT request_id, doc_id, count(*) AS met, sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))) AS bm25
  FROM terms JOIN postings USING (term) JOIN df USING (term) CROSS JOIN stats WHERE its_source IS NULL OR its_source = source GROUP BY ALL
)
SELECT request_id, doc_id, round(s.bm25, 6) AS bm25, row_number() OVER (PARTITION BY request_id ORDER BY round(s.bm25, 9) DESC, doc_id)::INT AS "rank"
FROM scores s JOIN needed USING (request_id) WHERE met = need
QUALIFY "rank" <= 10
"""
)
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of requests answered in one pass over the stored index."""
    corpus = _documents(spark, sf_dir)
    items = ingest.numbered(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    asked = items.select(F.col("item_id").alias("request_id"), F.array_join(F.slice(F.split("text", r"\s+"), 2, 2), " ").alias("query"), F.lit(10).alias("limit"), F.when(F.col("id") % 3 == 0, "src1").alias("its_source"))
    found = search.answer_requests(_stored(corpus), asked, corpus.passages, {"its_source": "source"}, "doc_id", digits=9)
    return found.select("request_id", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(
    _scores()
    + f"""SELECT doc_id, round(confidence, 6) AS confidence FROM (
  SELECT doc_id, {_CONFIDENCE} AS confidence FROM (SELECT * FROM matched ORDER BY bm25 DESC, doc_id LIMIT 50)) WHERE confidence >= 0.4"""
)
def search_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search(_documents(spark, sf_dir), ASKED, limit=50).rows
    return rows.select("doc_id", F.round("confidence", 6).alias("confidence"))


@query(
    _scores()
    + f"""SELECT doc_id, round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS level,
 concat_ws('; ', CASE WHEN contains(lower(text), 'with this') THEN 'exact phrase present' END, CASE WHEN contains(lower(text), 'with') AND contains(lower(text), 'this') THEN 'full term coverage' END) AS reasons
 FROM (SELECT *, {_CONFIDENCE} AS c FROM matched)"""
)
def search_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.scored(_documents(spark, sf_dir), ASKED).withColumn("c", search.confidence(F.col("bm25"), F.col("text"), None, ASKED))
    return rows.select("doc_id", F.round("c", 6).alias("confidence"), search.level(F.col("c")).alias("level"), F.array_join(search.reasons(F.col("text"), None, ASKED), "; ").alias("reasons"))


@query(
    _scores()
    + """SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet
 FROM (SELECT doc_id, text, greatest(0, hit - 80) AS s, least(length(text), hit + 160) AS e FROM (SELECT *, greatest(strpos(lower(text), 'with') - 1, 0) AS hit FROM matched))"""
)
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(_documents(spark, sf_dir), ASKED).select("doc_id", search.snippet(F.col("text"), ASKED).alias("snippet"))


@query(
    _scores()
    + f""", page AS (SELECT * FROM matched ORDER BY bm25 DESC, doc_id LIMIT 10 OFFSET 20),
n AS (SELECT (SELECT count(*) FROM matched) AS total, (SELECT count(*) FROM page WHERE {_CONFIDENCE} >= 0.4) AS count)
SELECT CASE WHEN count = 0 THEN 'insufficient_corpus_coverage' ELSE 'ok' END AS status, 'with this' AS query, count, total, 20 AS "offset",
 count > 0 AND 20 + count < total AS has_more, CASE WHEN count > 0 AND 20 + count < total THEN 20 + count END AS next_offset FROM n"""
)
def search_pagination_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_documents(spark, sf_dir), ASKED, limit=10, offset=20).meta


_SPLIT = r"SELECT doc_id, lang, split_part(text, chr(10), 1) AS heading, substr(text, length(split_part(text, chr(10), 1)) + 2) AS text FROM documents"


@query(
    _scores(("heading", "text"), source=_SPLIT)
    + f"SELECT doc_id, round(bm25, 6) AS bm25, round({_CONFIDENCE} + 0.05 * (contains(lower(heading), 'with this'))::INT, 6) AS confidence FROM matched"
)
def search_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heading = F.substring_index("text", "\n", 1)
    split = docs.select("doc_id", heading.alias("heading"), F.substring(F.col("text"), F.length(heading) + 2, F.length("text")).alias("text"))
    rows = search.scored(search.Corpus(split, "doc_id", ("heading", "text"), "text", "heading"), ASKED)
    return rows.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round(search.confidence(F.col("bm25"), F.col("text"), F.col("heading"), ASKED), 6).alias("confidence"))


# passages with parents: documents stand for passages, nations for their statutes, cases and issuances, regions for what these are filtered by
_COURTS = ("sc", "ca", "sb", "cta", "other")
_COURT_SQL = "CASE n_regionkey " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_COURTS)) + " END"
_PARENTS = "SELECT doc_id, 'Art. ' || doc_id AS no, coalesce(lang, '') AS heading, text, n_name, n_regionkey FROM documents JOIN nation ON n_nationkey = doc_id % 25"
_PAGE = f"(SELECT *, {_CONFIDENCE} AS c FROM (SELECT * FROM matched WHERE n_regionkey = {{0}} ORDER BY bm25 DESC, doc_id LIMIT 50))"
_LEVEL = "CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS \"confidenceLevel\""


def _passages(spark: SparkSession, sf_dir: str, parent: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias(parent), F.concat(F.lit("Art. "), F.col("doc_id")).alias("provision_no"), F.coalesce("lang", F.lit("")).alias("heading"), F.col("text").alias("body"), F.lit("in_force").alias("status"))


def _parents(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), *(c.alias(n) for n, c in columns.items()))


def _court() -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in _COURTS)), (F.col("n_regionkey") + 1).cast("int"))


@query(
    _scores(("no", "heading", "text"), source=_PARENTS)
    + f"SELECT n_name AS statute, {_COURT_SQL} AS domain, n_name || ', ' || no || ' (' || heading || ')' AS citation, no AS \"provisionNo\", round(c, 3) AS confidence, {_LEVEL} FROM {_PAGE.format(1)}"
)
def search_provisions_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    page = search.search_statute(_passages(spark, sf_dir, "statute_id"), _parents(spark, sf_dir, short_title=name, official_title=name, kind=F.lit("code"), domain=_court()), ASKED, domain="ca", limit=50, threshold=0)
    return page.rows.select("statute", "domain", "citation", "provisionNo", "confidence", "confidenceLevel")


@query(_scores(("heading", "text"), source=_PARENTS) + f"SELECT n_name AS citation, {_COURT_SQL} AS court, round(c, 3) AS confidence, {_LEVEL} FROM {_PAGE.format(2)}")
def search_cases_of_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, none = F.col("n_name"), F.lit(None).cast("string")
    page = search.search_jurisprudence(_passages(spark, sf_dir, "case_id"), _parents(spark, sf_dir, citation=name, title=name, court=_court(), promulgation_date=none, ponente=none), ASKED, court="sb", limit=50, threshold=0)
    return page.rows.select("citation", "court", "confidence", "confidenceLevel")


@query(_scores(("heading", "text"), source=_PARENTS) + f"SELECT {_COURT_SQL} AS agency, 'RMC' AS \"issuanceType\", n_name AS \"referenceNo\", round(c, 3) AS confidence, {_LEVEL} FROM {_PAGE.format(3)}")
def search_issuances_of_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, none = F.col("n_name"), F.lit(None).cast("string")
    page = search.search_issuance(_passages(spark, sf_dir, "issuance_id"), _parents(spark, sf_dir, agency=_court(), issuance_type=F.lit("RMC"), reference_no=name, title=name, issue_date=none), ASKED, agency="cta", issuance_type="RMC", limit=50, threshold=0)
    return page.rows.select("agency", "issuanceType", "referenceNo", "confidence", "confidenceLevel")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_documents(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({_TOKENS.format('text')})), 6) AS mean_length FROM documents")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus_stats(_documents(spark, sf_dir)).select("n_docs", F.round("mean_length", 6).alias("mean_length"))


_CLEAN = "text"
for _p, _to in (("\\r\\n", "\\n"), ("[ \\t]+\\n", "\\n"), ("\\n[ \\t]+", "\\n"), ("\\n{3,}", "\\n\\n"), ("[ \\t]{2,}", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to}', 'g')".replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '^[ \\t]+', '', 'gm'), '^\\s+', ''), '\\s+$', '')"
_MESSY = "replace(replace(text, ' the ', chr(9) || '  the   '), chr(10), ' ' || chr(13) || chr(10) || '  ' || chr(10) || chr(10) || chr(9))"


def _messy(text):
    return F.replace(F.replace(text, F.lit(" the "), F.lit("\t  the   ")), F.lit("\n"), F.lit(" \r\n  \n\n\t"))


@query(f"SELECT doc_id, sha256({_CLEAN}) AS clean_sha256, length({_CLEAN}) AS n_chars FROM (SELECT doc_id, {_MESSY} AS text FROM documents)")
def whitespace_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", normalise_whitespace(_messy(F.col("text"))).alias("text"))
    return rows.select("doc_id", content_hash(F.col("text")).alias("clean_sha256"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", not 1900-01-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first_iso_date(said).alias("found"))


@query("SELECT p_partkey, CAST(coalesce(nullif(regexp_extract(p_brand, '[0-9]+'), ''), '0') AS BIGINT) AS number FROM part")
def leading_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", leading_int(F.regexp_replace("p_brand", "^[^0-9]*", " ")).alias("number"))


@query()
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return segment.chunk_into_passages(docs)


@query()
def chunk_long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_into_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), max_chars=segment.ISSUANCE_CHARS)


@query("SELECT l_orderkey, number, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS number, l_quantity FROM lineitem) GROUP BY ALL")
def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("Section "), F.col("l_linenumber"), F.lit(". Part "), F.col("l_partkey"), F.lit("\n  quantity "), F.col("l_quantity"))
    texts = lines.groupBy("l_orderkey").agg(F.concat(F.lit("Order\n"), F.array_join(F.array_sort(F.collect_list(said)), "\n")).alias("text"))
    sections = segment.segment_provisions(texts)
    quantity = F.regexp_extract("body", r"quantity ([0-9.]+)", 1).cast("double")
    return sections.groupBy("l_orderkey", "number").agg(F.count("*").alias("n"), F.sum(quantity).alias("quantity"))


_TAX_SQL = """
SELECT p_partkey, 'Revenue ' || form AS issuance_type, code || ' ' || p_size || '-2023' AS reference_no, 'about ' || p_name AS title, '2023-01-02' AS issue_date, 'BIR' AS agency
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'Regulations' WHEN 1 THEN 'Memorandum Circular' WHEN 2 THEN 'Memorandum Order' ELSE 'Memorandum Ruling' END AS form,
             CASE p_partkey % 4 WHEN 0 THEN 'RR' WHEN 1 THEN 'RMC' WHEN 2 THEN 'RMO' ELSE 'RMR' END AS code FROM part)"""


@query(_TAX_SQL)
def tax_issuance_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*(F.lit(f) for f in ("REGULATIONS", "MEMORANDUM CIRCULAR", "MEMORANDUM ORDER", "MEMORANDUM RULING")))
    form = F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("Republic\n\nREVENUE "), form, F.lit(" NO. "), F.col("p_size"), F.lit("-2023\n  SUBJECT:  about "), F.col("p_name"), F.lit("\nof 2023-01-02"))
    rows = segment.normalise_issuance(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    return rows.select("p_partkey", "issuance_type", "reference_no", "title", "issue_date", "agency")


_AGENCY_SQL = """
SELECT s_suppkey, form AS issuance_type, CASE WHEN form = 'Guidelines' THEN form ELSE form || ' ' || s_nationkey END AS reference_no, s_name AS title, agency
FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'Memorandum Circular' WHEN 1 THEN 'Ordinance' ELSE 'Guidelines' END AS form,
             CASE s_suppkey % 2 WHEN 0 THEN 'SSS' ELSE 'National Government Agency' END AS agency FROM supplier)"""


@query(_AGENCY_SQL)
def agency_issuance_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    form = F.when(key % 3 == 0, F.concat(F.lit("Memorandum Circular No. "), F.col("s_nationkey"))).when(key % 3 == 1, F.concat(F.lit("ORDINANCE "), F.col("s_nationkey"))).otherwise("Guidelines on things")
    text = F.concat(F.when(key % 2 == 0, "Social  Security System").otherwise("Town Council"), F.lit("\n"), form, F.lit("\nTitle: "), F.col("s_name"))
    rows = segment.normalise_agency_issuance(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")))
    return rows.select("s_suppkey", "issuance_type", "reference_no", "title", "agency")


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)</h1>', 1)), '') IS NOT NULL AS has_title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract_article(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.col("title").isNotNull().alias("has_title"))


@query()
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract_article(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.filter(F.length("text") >= html.MIN_TEXT)


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: quern\nDisallow: /fr/\nDisallow: /en/1\nDisallow:\n"


@query("SELECT page_id FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages) WHERE NOT starts_with(path, '/fr/') AND NOT starts_with(path, '/en/1')")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.rules_for_agent(robots.rules_table(spark, ROBOTS), "Quern/1.0")
    return robots.allowed_pages(table(spark, sf_dir, "pages"), rules).select("page_id")


@query("SELECT min(page_id) AS page_id, url FROM pages WHERE starts_with(url, 'https://') GROUP BY url ORDER BY page_id LIMIT 25")
def catalogue_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    first = pages.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("url", "p.page_id", "p.html")
    catalogue = first.select(F.col("page_id").alias("place"), F.col("url").alias("source_url"), F.lit(None).cast("string").alias("enacted_date"))
    found = ingest.targets(catalogue, first, "https://", since="2000-01-01", limit=25, min_chars=0)
    return found.select(F.col("place").alias("page_id"), F.col("source_url").alias("url"))


@query(
    """SELECT doc_id AS place, 'https://x.org/' || doc_id AS url, doc_id % 300 AS n FROM documents
 WHERE doc_id % 300 >= 120 AND doc_id % 2 = 0 AND (doc_id % 7 = 0 OR 1990 + doc_id % 30 >= 2005) ORDER BY doc_id LIMIT 150"""
)
def catalogue_targets_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries made of documents: half under the prefix, some undated or too old, and with pages that are too thin."""
    key = F.col("doc_id")
    url = F.concat(F.when(key % 2 == 0, "https://x.org/").otherwise("https://y.org/"), key)
    docs = table(spark, sf_dir, "documents").select(key.alias("place"), url.alias("source_url"), F.when(key % 7 > 0, F.concat((1990 + key % 30).cast("string"), F.lit("-06-01"))).alias("enacted_date"))
    body = F.concat(F.lit("<html><body><article><p>"), F.expr("repeat('x', CAST(place % 300 AS INT))"), F.lit("</p></article></body></html>"))
    found = ingest.targets(docs, docs.select(F.col("source_url").alias("url"), body.alias("html")), "https://x.org/", since="2005-01-01", limit=150)
    return found.select("place", F.col("source_url").alias("url"), F.length("text").cast("long").alias("n"))


_ANSWER = "CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 2) WHEN doc_id % 3 = 1 THEN '  ' || translate(split_part(text, ' ', 3), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' || split_part(text, ' ', 4) ELSE CAST(n_chars AS VARCHAR) END"
_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(
    f"""WITH p AS (SELECT doc_id, {_NORMAL.format("text")} AS hay, {_NORMAL.format(_ANSWER)} AS needle FROM documents),
q AS (SELECT *, regexp_escape(needle) AS safe FROM p)
SELECT doc_id, CASE WHEN needle = '' THEN false WHEN length(needle) >= 8 THEN contains(hay, needle)
 WHEN regexp_matches(needle, '[0-9]') THEN regexp_matches(hay, '(^|[^0-9])' || safe || '([^0-9]|$)')
 ELSE regexp_matches(hay, '\\b' || safe || '\\b') END AS matched FROM q"""
)
def answers_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    answer = F.when(F.col("doc_id") % 3 == 0, word(2)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), ascii_upper(word(3)), F.lit(" "), word(4))).otherwise(F.col("n_chars").cast("string"))
    return docs.select("doc_id", evaluate.answer_matches(F.col("text"), answer).alias("matched"))


@query(
    """SELECT count(*) FILTER (WHERE toxic = 0) AS passed, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS coverage, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS failed,
 count(*) AS total, CASE WHEN count(*) FILTER (WHERE toxic = 1 AND quality = 1) > 0 THEN 1 ELSE 0 END AS exit_code FROM labels"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    judged = labels.select(evaluate.outcome(F.col("toxic") == 0, F.col("quality") == 1).alias("outcome"))
    return evaluate.summarise(judged)
