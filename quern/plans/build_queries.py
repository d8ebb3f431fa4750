"""Queries that build corpora from the given tables, and that extract and resolve every kind of citation: parts, orders and suppliers stand for cases, statutes and issuances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tables import new_folder, releasing
from quern.operators import borders, citations, lookup, segment
from quern.sources import ingest, robots, schemas, snapshots
from quern.sources.registry import domain_names

from .graph_queries import PROBE, _customer_statutes, _probe
from .registry import query, table

_KINDS = (
    # kind, raw, case_citation, act_number, statute_title, provision_no; in the order in which they are extracted
    ("'case'", "'G.R. No. l-' || p_partkey", "'G.R. No. L-' || p_partkey", "NULL", "NULL", "NULL"),
    ("'case'", "'g.r. no. ' || p_size || '00'", "'G.R. No. ' || p_size || '00'", "NULL", "NULL", "NULL"),
    ("'statute'", "'Article VII, Section ' || p_size || ' of the 1987 Constitution'", "NULL", "NULL", "'1987 Constitution'", "'VII-' || p_size"),
    ("'statute'", "'Section ' || p_size || ' of the 1987 Constitution'", "NULL", "NULL", "'1987 Constitution'", "CAST(p_size AS VARCHAR)"),
    ("'statute'", "'Art. ' || p_partkey || '-a, the Civil Code'", "NULL", "NULL", "'Civil Code'", "p_partkey || '-A'"),
    ("'statute'", "'Sec. ' || p_size || '(b) of PD ' || p_partkey", "NULL", "CAST(p_partkey AS VARCHAR)", "'PD ' || p_partkey", "p_size || '(B)'"),
    ("'statute'", "'the Revised Implementing Rules and Regulations of Republic Act No. ' || p_partkey", "NULL", "CAST(p_partkey AS VARCHAR)", "'IRR of RA ' || p_partkey", "NULL"),
    ("'statute'", "'Republic Act No. ' || p_partkey", "NULL", "CAST(p_partkey AS VARCHAR)", "NULL", "NULL"),
    ("'statute'", "'PD ' || p_partkey", "NULL", "CAST(p_partkey AS VARCHAR)", "NULL", "NULL"),
)


@query(" UNION ALL ".join(f"SELECT p_partkey, {place} AS place, {k[0]} AS kind, {k[1]} AS raw, {k[2]} AS case_citation, {k[3]} AS act_number, {k[4]} AS statute_title, {k[5]} AS provision_no FROM part" for place, k in enumerate(_KINDS)))
def citation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of citation in one text for each part; a raw text that comes twice counts once."""
    key, size = F.col("p_partkey"), F.col("p_size")
    said = (
        F.concat(F.lit("Article VII, Section "), size, F.lit(" of the 1987 Constitution.")),
        F.concat(F.lit("Art. "), key, F.lit("-a, the Civil Code and Republic Act No. "), key, F.lit(" hold.")),
        F.concat(F.lit("See the Revised Implementing Rules and Regulations of Republic Act No. "), key, F.lit(".")),
        F.concat(F.lit("G.R. No. l-"), key, F.lit(" and g.r. no. "), size, F.lit("00 differ.")),
        F.concat(F.lit("Sec. "), size, F.lit("(b) of PD "), key, F.lit(", and more.")),
    )
    texts = table(spark, sf_dir, "part", spread_out=True).select("p_partkey", F.concat_ws("\n", *said).alias("text"))
    return citations.extract_citations(texts).select("p_partkey", "place", "kind", "raw", "case_citation", "act_number", "statute_title", "provision_no")


@query("SELECT c_custkey, count(*) AS n, max(k) AS last_number FROM (SELECT c_custkey, unnest(generate_series(1, least(c_custkey % 300 + 1, 200))) AS k FROM customer) GROUP BY 1")
def citations_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with up to 300 citations; the first 200 of a text are kept."""
    said = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 300 + 1).cast("int")), lambda k: F.concat(F.lit("RA "), k.cast("string")))
    spans = citations.extract_citations(table(spark, sf_dir, "customer", spread_out=True).select("c_custkey", F.array_join(said, " ").alias("text")))
    return spans.groupBy("c_custkey").agg(F.count("*").alias("n"), F.max(F.col("act_number").cast("long")).alias("last_number"))


@query(
    """WITH w AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem)
SELECT l_orderkey, 'Republic Act No.' || chr(10) || least(number, 99) AS raw, CAST(least(number, 99) AS VARCHAR) AS act_number, min(place) AS passage
FROM (SELECT l_orderkey, place, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY place) AS number FROM w) WHERE number IS NOT NULL GROUP BY ALL"""
)
def citations_over_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as passages of one text: each ends in the middle of a citation whose number the next one begins with."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("case").alias("citing_kind"), F.col("l_orderkey").alias("citing_id"), place.cast("long").alias("passage"), F.concat(F.least("l_partkey", F.lit(99)), F.lit(" applies. See Republic Act No.")).alias("text"))
    found = borders.border_spans(rows)
    return found.groupBy(F.col("citing_id").alias("l_orderkey"), "raw", "act_number").agg(F.min("passage").alias("passage"))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(
    f"""WITH keys AS (SELECT DISTINCT id, {_KEY.format("title")} AS key FROM (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title FROM part UNION ALL SELECT p_partkey, 'Charter of the ' || p_name || ' ' || p_partkey || ' of nature' FROM part)),
asked AS (SELECT p_partkey AS citing_id, p_size, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_partkey ELSE ' ' || p_partkey || ' of nature' END AS hint FROM part),
hints AS (SELECT DISTINCT {_KEY.format("hint")} AS key FROM asked),
exact AS (SELECT h.key, count(DISTINCT id) AS n, min(id) AS id FROM hints h JOIN keys k ON k.key = h.key GROUP BY 1),
within AS (SELECT h.key, count(DISTINCT id) AS n, min(id) AS id FROM hints h JOIN keys k ON contains(k.key, h.key) WHERE h.key NOT IN (SELECT key FROM exact) GROUP BY 1)
SELECT citing_id, id AS cited_id, 'Art. ' || p_size || ' of the ' || hint AS cited_reference FROM asked JOIN (SELECT * FROM exact UNION ALL SELECT * FROM within) f ON f.key = {_KEY.format("hint")} WHERE n = 1"""
)
def resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions cited by title alone: a third by a whole title, a third by a part of one that only one statute has, a third by a name that many share, which resolves where it is the only one."""
    parts, name, key = table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_partkey")
    numbered = F.concat_ws(" ", name, key)
    hint = F.when(key % 3 == 0, name).when(key % 3 == 1, numbered).otherwise(F.concat(numbered, F.lit(" of nature")))
    texts = table(spark, sf_dir, "part", spread_out=True).select(F.lit("case").alias("citing_kind"), key.alias("citing_id"), F.concat(F.lit("Art. "), F.col("p_size"), F.lit(" of the "), hint, F.lit(".")).alias("text"))
    statutes = parts.select(key.alias("id"), numbered.alias("short_title"), F.concat(F.lit("Charter of the "), numbered, F.lit(" of nature")).alias("official_title"), F.lit(None).cast("string").alias("act_number"))
    cases = parts.select(key.alias("id"), F.concat(F.lit("G.R. No. "), key).alias("citation"))
    return citations.build_graph(texts, statutes, cases).edges.select("citing_id", "cited_id", "cited_reference")


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed records: orders as statutes with their lines as provisions, parts as cases that cite an order, suppliers as issuances."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = lambda x: F.struct(
        x["l_linenumber"].cast("string").alias("provisionNo"),
        F.concat(F.lit("Part "), x["l_partkey"]).alias("body"),
        F.when(x["l_linenumber"] % 2 == 1, day(x["l_shipdate"])).alias("validFrom"),
    )
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_shipdate")).alias("lines"))  # the lines of an order
    own = own.select("o_orderkey", F.array_sort(F.transform("lines", line)).alias("provisions"))
    passage = lambda text: F.array(F.struct(F.lit(1).alias("passageNo"), text.alias("body"))).alias("passages")
    order = F.concat(F.lit("Order "), F.col("o_orderkey"))
    records = {
        "statute": orders.join(own, "o_orderkey").select(order.alias("shortTitle"), order.alias("officialTitle"), F.lit("republic_act").alias("kind"), F.col("o_orderkey").cast("string").alias("actNumber"), F.lit("civil").alias("domain"), F.when(F.col("o_orderkey") % 5 > 0, day("o_orderdate")).alias("enactedDate"), F.concat(F.lit("u/"), F.col("o_orderkey")).alias("sourceUrl"), "provisions"),
        "case": part.select(F.concat(F.lit("G.R. No. "), F.col("p_partkey")).alias("citation"), F.col("p_name").alias("title"), F.lit("sc").alias("court"), passage(F.concat(F.lit("Republic Act No. "), F.col("p_size"), F.lit(" holds.")))),
        "issuance": supplier.select(F.lit("BIR").alias("agency"), F.lit("RMC").alias("issuanceType"), F.concat(F.lit("RMC "), F.col("s_suppkey")).alias("referenceNo"), passage(F.col("s_name"))),
    }
    lines_of = [rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct("*").alias("record"))).alias("value")) for kind, rows in records.items()]
    return lines_of[0].union(lines_of[1]).union(lines_of[2])


@query(
    """WITH s AS (SELECT *, row_number() OVER (ORDER BY 'Order ' || o_orderkey) AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT *, row_number() OVER (ORDER BY 'G.R. No. ' || p_partkey) AS id FROM part),
i AS (SELECT *, row_number() OVER (ORDER BY 'RMC ' || s_suppkey) AS id FROM supplier)
SELECT 'provision' AS kind, id, 'Order ' || o_orderkey AS parent, CAST(l_linenumber AS VARCHAR) AS number, 'Part ' || l_partkey AS body,
 coalesce(CASE WHEN l_linenumber % 2 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, '2026-01-01') AS since FROM s JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'case passage', id, 'G.R. No. ' || p_partkey, '1', 'Republic Act No. ' || p_size || ' holds.', NULL FROM c
UNION ALL SELECT 'issuance passage', id, 'RMC ' || s_suppkey, '1', s_name, NULL FROM i
UNION ALL SELECT 'edge', c.id, 'Republic Act No. ' || p_size, CAST(s.id AS VARCHAR), 'statute', NULL FROM c JOIN s ON o_orderkey = p_size"""
)
def build_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: seed lines written and read, corpora built with their edges, written as tables and opened again."""
    folder = new_folder(spark)
    with releasing(spark):
        _seed(spark, sf_dir).write.text(f"{folder}/seed", compression="gzip")
    built = ingest.build_corpora(spark, ingest.load_seed(spark, f"{folder}/seed", "*.txt.gz"), today="2026-01-01")
    ingest.write_corpora(built, f"{folder}/corpora")
    c = ingest.open_corpora(spark, f"{folder}/corpora")
    none = F.lit(None).cast("string")
    kids = [("provision", "provisions", "statutes", "statute_id", "short_title", "provision_no", F.col("valid_from")), ("case passage", "case_passages", "cases", "case_id", "citation", "passage_no", none), ("issuance passage", "issuance_passages", "issuances", "issuance_id", "reference_no", "passage_no", none)]
    rows = c["edges"].select(F.lit("edge").alias("kind"), F.col("citing_id").alias("id"), F.col("cited_reference").alias("parent"), F.col("cited_id").cast("string").alias("number"), F.col("cited_kind").alias("body"), none.alias("since"))
    for kind, child, parent, key, name, number, since in kids:
        joined = c[child].drop("id").join(c[parent].select(F.col("id").alias(key), name), key)
        rows = rows.union(joined.select(F.lit(kind).alias("kind"), key, name, F.col(number).cast("string"), "body", since))
    return rows


@query("SELECT l_orderkey, sha256(text) AS content_hash, n FROM (SELECT l_orderkey, 'Order' || chr(10) || string_agg(said, chr(10) ORDER BY said) AS text, count(*) AS n FROM (SELECT l_orderkey, 'Section ' || l_linenumber || '. Part ' || l_partkey || chr(10) || 'sold by ' || l_suppkey AS said FROM lineitem) GROUP BY 1)")
def normalised_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and number of sections of each order's text, whose white space is untidy."""
    said = F.concat(F.lit("Section "), F.col("l_linenumber"), F.lit(".  Part "), F.col("l_partkey"), F.lit("\t \r\n  sold by "), F.col("l_suppkey"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("  Order \n"), F.array_join(F.array_sort(F.collect_list(said)), " \n\t"), F.lit("\n\n")).alias("text"))  # the lines of an order
    _, sections = segment.normalise_statute(texts)
    return sections.groupBy("l_orderkey", "content_hash").agg(F.count("*").alias("n"))


@query("SELECT p.page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND q.url = p.url AND q.page_id % 100 = p.page_id % 100)")
def new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Page "), F.col("page_id") % 100).alias("short_title"), F.col("url").alias("source_url"))
    return ingest.new_documents(pages, pages.filter("page_id % 3 = 0")).select("page_id")


@query(
    """WITH c AS (SELECT CAST(s_suppkey % 9 AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS act_number, CASE WHEN s_suppkey % 2 = 0 THEN 'act' ELSE 'code' END AS kind, 'u/' || s_suppkey AS source_url, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE 'civil' END AS domain FROM supplier)
SELECT 'duplicate id' AS problem, id AS value FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate act_number', act_number FROM c GROUP BY act_number, kind HAVING count(*) > 1
UNION ALL SELECT 'duplicate source_url', source_url FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown domain', domain FROM c WHERE domain <> 'civil'"""
)
def catalogue_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.catalogue_problems(_catalogue(spark, sf_dir), domain_names(spark))


@query("SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE 'civil' END AS domain FROM supplier")
def catalogue_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.catalogue_domains(_catalogue(spark, sf_dir))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((key % 9).cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("act_number"), F.when(key % 2 == 0, "act").otherwise("code").alias("kind"), F.concat(F.lit("u/"), key).alias("source_url"), F.when(key % 4 == 0, F.col("s_name")).otherwise("civil").alias("domain"))


@query(f"""SELECT c_mktsegment AS agency, c_name AS "referenceNo", place AS passage_no, o_orderpriority AS body FROM customer JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey = {PROBE}) ON c_custkey = o_custkey WHERE place <= 20""")
def lookup_issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer with orders as an issuance, whose passages are the orders."""
    none, asked = F.lit(None).cast("string"), _probe(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    agency = customers.filter(F.col("c_name") == asked).first()["c_mktsegment"]
    issuances = customers.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("agency"), F.lit("RMC").alias("issuance_type"), F.col("c_name").alias("reference_no"), F.col("c_name").alias("title"), none.alias("issue_date"), F.lit("current").alias("status"), none.alias("source_url"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    passages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("issuance_id"), place.alias("passage_no"), none.alias("heading"), F.col("o_orderpriority").alias("body"))
    found = lookup.get_issuance(issuances, passages, agency.lower(), asked.upper())
    return found.select("agency", "referenceNo", F.explode("passages").alias("p")).select("agency", "referenceNo", F.col("p.passage_no").cast("long").alias("passage_no"), "p.body")


@query(f"""SELECT c_name AS short_title, CAST(o_orderkey AS VARCHAR) AS provision_no, o_orderpriority AS body FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = {PROBE} ORDER BY o_orderkey LIMIT 100""")
def statute_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer with orders as a statute, with its first provisions in numeric order."""
    o = table(spark, sf_dir, "orders")
    provisions = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("statute_id"), F.col("o_orderkey").cast("string").alias("provision_no"), F.lit(None).cast("string").alias("heading"), F.col("o_orderpriority").alias("body"), F.lit("in_force").alias("status"))
    found = lookup.statute_payload(_customer_statutes(spark, sf_dir), provisions, _probe(spark, sf_dir).lower())
    return found.select("short_title", F.explode("provisions").alias("p")).select("short_title", "p.provision_no", "p.body")


@query("SELECT 'vocabulary' AS rule, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'unique', count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'reference', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule of the tables of cases: customers as cases, orders as their passages."""
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("citation"), F.when(F.col("c_mktsegment") == "BUILDING", "sc").otherwise(F.col("c_mktsegment")).alias("court"))
    passages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("passage_no"))
    found = schemas.integrity({"cases": cases, "case_passages": passages})
    return found.filter("table = 'cases' OR rule = 'reference'").select("rule", "n")


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(line)), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM lines),
sums AS (SELECT doc_id, count(*) AS n_passages, sum(len(w))::BIGINT AS n_tokens, sum(len(list_distinct(w)))::BIGINT AS n_postings FROM words GROUP BY 1)
SELECT 'd' || doc_id AS key, CASE WHEN source = 'src3' THEN 'new' WHEN lang = 'fr' THEN 'changed' ELSE 'same' END AS status, n_passages, n_tokens, n_postings FROM documents JOIN sums USING (doc_id)
UNION ALL SELECT DISTINCT 'b' || item_id, 'gone', 0, 0, 0 FROM benchmark"""
)
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl with older French texts, benchmark items and no src3, brought to the state of all documents: what changed, and what the snapshot then holds of each."""
    docs = table(spark, sf_dir, "documents").withColumn("key", F.concat(F.lit("d"), "doc_id"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), "text")
    older = docs.filter(~F.col("source").eqNullSafe("src3")).select("key", F.when(F.col("lang") == "fr", F.concat(F.lit("older "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    store = snapshots.Snapshots(spark, new_folder(spark), 16)
    snapshots.ingest_crawl(store, older.union(items))
    moved = snapshots.ingest_crawl(store, docs.select("key", "text"))
    read = lambda name: store.read(name, snapshots.SCHEMAS[name])
    held = read("passages").groupBy("key").agg(F.count("*").alias("n_passages"))
    words = read("postings").groupBy("key").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_postings"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return moved.join(held, "key", "left").join(words, "key", "left").select("key", "status", none("n_passages"), none("n_tokens"), none("n_postings"))


_ROBOTS_SQL = """
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
rules AS (
  SELECT host, '*' AS agent, '/' || left(host, 1) AS prefix FROM hosts UNION ALL SELECT host, 'quern', '/en' FROM hosts WHERE length(host) % 2 = 0
  UNION ALL SELECT host, 'quern', '/de/1' FROM hosts WHERE length(host) % 2 = 0 UNION ALL SELECT host, 'other', '/' FROM hosts
), best AS (
  SELECT host, max(agent) FILTER (agent = 'quern') AS own FROM rules GROUP BY host
), asked AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages
)
SELECT page_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM rules r JOIN best b ON b.host = r.host AND r.agent = coalesce(b.own, '*') WHERE r.host = a.host AND starts_with(a.path, r.prefix))
"""


@query(_ROBOTS_SQL)
def robots_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the rules of their own hosts allow; each host's file has lines in groups of several agents."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(robots.url_host(F.col("url")).alias("host")).distinct()
    own = F.when(F.length("host") % 2 == 0, F.lit("# ours\nUser-agent: Quern\nDisallow: /en\nDisallow:\nDISALLOW : /de/1\n")).otherwise("")
    files = hosts.select("host", F.concat(F.lit("Disallow: /ignored\nUser-Agent: *\nDisallow: /"), F.substring("host", 1, 1), F.lit("\n\n"), own, F.lit("user-agent: other\nDisallow: /\n")).alias("content"))
    return robots.allowed_by_host(pages, robots.rules_of_hosts(files, "Quern/1.0")).select("page_id")
