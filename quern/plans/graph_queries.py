"""Look-ups and citation-graph queries on the given tables: customers stand for cases, parts for statutes, orders for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import leading_int
from quern.functions.tables import new_folder
from quern.operators import citations, graph, lookup
from quern.sources import ingest, registry, schemas
from quern.streaming import edges

from .registry import query, table

# first reference wins: the least (order, line, price) of each customer and part
_EDGES = """
WITH refs AS (SELECT o.o_custkey AS citing_id, l.l_partkey AS cited_id, 'order ' || l.l_orderkey || ' line ' || l.l_linenumber AS cited_reference,
                     row_number() OVER (PARTITION BY o.o_custkey, l.l_partkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice) AS place
              FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
edges AS (SELECT citing_id, cited_id, cited_reference FROM refs WHERE place = 1),
names AS (SELECT p_name FROM part GROUP BY p_name)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return citations.first_edges(_references(orders, lines), [F.col(c) for c in _ORDER])


_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def _references(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return orders.hint("merge").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(  # neither side is small
        F.lit("case").alias("citing_kind"),
        F.col("o_custkey").alias("citing_id"),
        F.lit("statute").alias("cited_kind"),
        F.col("l_partkey").alias("cited_id"),
        F.concat(F.lit("order "), F.col("l_orderkey"), F.lit(" line "), F.col("l_linenumber")).alias("cited_reference"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("citation"), F.col("c_mktsegment").alias("title"), F.col("c_nationkey").cast("string").alias("court"))


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey")).alias("short_title"), F.col("p_type").alias("official_title"), F.lit("code").alias("kind"), F.col("p_partkey").cast("string").alias("act_number"), F.lit("civil").alias("domain"), F.lit("in_force").alias("status"))


PROBE = "(SELECT c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)))"


def _probe(spark: SparkSession, sf_dir: str) -> str:
    """The name of the first customer who has orders."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").agg(F.min("c_name")).first()[0]


@query(_EDGES + " SELECT 'case' AS citing_kind, citing_id, 'statute' AS cited_kind, cited_id, cited_reference FROM edges")
def edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(_EDGES + " SELECT 'case' AS citing_kind, citing_id, 'statute' AS cited_kind, cited_id, cited_reference FROM edges")
def edges_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in three batches of many files, the latest files first."""
    folder = new_folder(spark)
    refs = _references(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # of a batch, so that no task gets a whole one
    refs.repartition(3 * files, "l_orderkey", "l_linenumber").write.parquet(f"{folder}/references")
    stream = spark.readStream.schema(refs.schema).option("maxFilesPerTrigger", files).option("latestFirst", True).parquet(f"{folder}/references")
    edges.keep_first_edges(stream, _ORDER, f"{folder}/edges", f"{folder}/state").awaitTermination()
    return edges.first_edges(spark, f"{folder}/edges")


@query(
    _EDGES
    + f""" SELECT e.cited_reference AS "citedReference", e.cited_id AS "statuteId", p_name || ' ' || p_partkey AS "shortTitle", p_type AS "officialTitle", 'civil' AS domain, CAST(p_partkey AS VARCHAR) AS "actNumber"
 FROM edges e LEFT JOIN part ON p_partkey = e.cited_id WHERE e.citing_id = {PROBE} ORDER BY 1, 2 LIMIT 50"""
)
def related_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_laws(_edges(spark, sf_dir), _statutes(spark, sf_dir), _cases(spark, sf_dir), _probe(spark, sf_dir), 50)


@query(
    _EDGES
    + f""", top AS (SELECT o.citing_id, count(*) AS shared FROM edges e JOIN edges o ON o.cited_id = e.cited_id AND o.citing_id <> e.citing_id WHERE e.citing_id = {PROBE} GROUP BY 1 ORDER BY shared DESC, citing_id LIMIT 50)
 SELECT c_name AS citation, c_mktsegment AS title, CAST(c_nationkey AS VARCHAR) AS court, shared AS "sharedStatutes" FROM top LEFT JOIN customer ON c_custkey = citing_id"""
)
def related_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_cases(_edges(spark, sf_dir), _cases(spark, sf_dir), _probe(spark, sf_dir), 50)


@query(
    _EDGES
    + f""" SELECT 'statute' AS kind, cited_reference AS "citedReference", p_name || ' ' || p_partkey AS title, CAST(p_partkey AS VARCHAR) AS "actNumber", CAST(NULL AS VARCHAR) AS citation
 FROM edges LEFT JOIN part ON p_partkey = cited_id WHERE citing_id = {PROBE} ORDER BY 2, cited_id LIMIT 200"""
)
def show_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_citations(_edges(spark, sf_dir), _statutes(spark, sf_dir), _cases(spark, sf_dir), _probe(spark, sf_dir), 200)


@query(_EDGES + " SELECT DISTINCT citing_id FROM edges WHERE cited_id = 17")
def cases_citing_statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cases_citing_statute(_edges(spark, sf_dir), 17)


# parts of one order: the part of a line cites the part of the next line
_LAWS = """
WITH refs AS (SELECT l_partkey AS citing_id, lead(l_partkey) OVER w AS cited_id, l_orderkey, l_linenumber FROM lineitem
              WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
laws AS (SELECT citing_id, cited_id, min('IRR in order ' || l_orderkey) AS cited_reference FROM refs WHERE cited_id IS NOT NULL AND cited_id <> citing_id GROUP BY 1, 2)"""


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    refs = lines.select(F.col("l_partkey").alias("citing_id"), F.lead("l_partkey").over(order).alias("cited_id"), F.concat(F.lit("IRR in order "), F.col("l_orderkey")).alias("cited_reference"))
    refs = refs.filter("cited_id IS NOT NULL AND cited_id <> citing_id").withColumns({"citing_kind": F.lit("statute"), "cited_kind": F.lit("statute")})
    return citations.first_edges(refs, [F.col("cited_reference")])


@query(_LAWS + """ SELECT cited_reference AS "citedReference", p_name || ' ' || p_partkey AS "shortTitle", CAST(p_partkey AS VARCHAR) AS "actNumber", 'civil' AS domain FROM laws LEFT JOIN part ON p_partkey = cited_id WHERE citing_id = 17 ORDER BY 1, cited_id LIMIT 100""")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_dependencies(_laws(spark, sf_dir), _statutes(spark, sf_dir), "", "17", 100)[0]


@query(_LAWS + """, back AS (SELECT DISTINCT citing_id FROM laws WHERE cited_id = 17 ORDER BY 1 LIMIT 100) SELECT p_name || ' ' || p_partkey AS "shortTitle", CAST(p_partkey AS VARCHAR) AS "actNumber" FROM back LEFT JOIN part ON p_partkey = citing_id""")
def reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_dependencies(_laws(spark, sf_dir), _statutes(spark, sf_dir), "", "17", 100)[1]


@query(_LAWS + """ SELECT cited_reference AS "citedReference", CAST(NULL AS VARCHAR) AS "citingCitation", CAST(NULL AS VARCHAR) AS "citingTitle" FROM laws WHERE cited_id = 17 AND contains(upper(cited_reference), 'IRR') ORDER BY 1, citing_id LIMIT 100""")
def implementing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_implementing_rules(_laws(spark, sf_dir), _statutes(spark, sf_dir), _cases(spark, sf_dir), "", "17", 100)


_CURATED = ", ".join(f"('{t}', {k})" for k, t in enumerate(next(d[4] for d in registry.DOMAINS if d[0] == "civil")))
_NAMES = ", ".join(f"('{d[0]}', '{d[1]}')" for d in registry.DOMAINS)


@query(
    _LAWS
    + f""", curated(slug, place) AS (VALUES {_CURATED}), domain_names(slug, name) AS (VALUES {_NAMES}),
 cited AS (SELECT cited_reference, p_name || ' ' || p_partkey AS title, CAST(p_partkey AS VARCHAR) AS number FROM laws LEFT JOIN part ON p_partkey = cited_id WHERE citing_id = 17 ORDER BY 1, cited_id LIMIT 100)
 SELECT 'domain' AS kind, c.slug AS "targetSlug", n.name AS "targetName", CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS "citedReference", CAST(NULL AS VARCHAR) AS "shortTitle", CAST(NULL AS VARCHAR) AS "actNumber" FROM curated c LEFT JOIN domain_names n ON n.slug = c.slug
 UNION ALL SELECT 'statute', NULL, NULL, NULL, cited_reference, title, number FROM cited"""
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_cross_references(_laws(spark, sf_dir), _statutes(spark, sf_dir), registry.registry(spark), "", "17", 100)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place = 1")
def lookup_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest_versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def _provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of one provision of each customer's statute."""
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("statute_id"), F.concat(F.lit("Art. "), F.col("o_orderstatus")).alias("provision_no"), F.lit(None).cast("string").alias("heading"), F.col("o_orderpriority").alias("body"), F.lit("in_force").alias("status"), text.alias("valid_from"), F.lit(None).cast("string").alias("valid_until"))


def _customer_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("short_title"), F.col("c_name").alias("official_title"), F.lit("code").alias("kind"), F.col("c_custkey").cast("string").alias("act_number"), F.lit("civil").alias("domain"), F.lit("in_force").alias("status"))


@query(
    f"""SELECT c_name || ', Art. ' || o_orderstatus AS citation, c_name AS statute, 'Art. ' || o_orderstatus AS "provisionNo", o_orderpriority AS body, strftime(o_orderdate, '%Y-%m-%d') AS "validFrom"
 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = {PROBE} AND o_orderstatus = 'F' ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 1"""
)
def lookup_provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.get_provision(_provisions(spark, sf_dir), _customer_statutes(spark, sf_dir), _probe(spark, sf_dir).upper(), "art. f")
    return rows.select("citation", "statute", "provisionNo", "body", "validFrom")


@query(f"""SELECT 'Art. ' || o_orderstatus AS "provisionNo", CAST(NULL AS VARCHAR) AS heading, 'in_force' AS status, strftime(o_orderdate, '%Y-%m-%d') AS "validFrom", CAST(NULL AS VARCHAR) AS "validUntil", o_orderpriority AS body FROM orders WHERE o_custkey = {PROBE} AND o_orderstatus = 'O'""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.show_history(_provisions(spark, sf_dir), _customer_statutes(spark, sf_dir), _probe(spark, sf_dir), "ART. O")


@query(f"""SELECT o_orderpriority AS "amendingLaw", CAST(NULL AS BIGINT) AS "amendingLawId", o_orderstatus AS "provisionNo", strftime(o_orderdate, '%Y-%m-%d') AS "effectiveDate", CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_custkey = {PROBE} ORDER BY 4, o_orderkey LIMIT 100""")
def amendment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    log = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("statute_id"), F.col("o_orderpriority").alias("amending_law"), F.lit(None).cast("long").alias("amending_law_id"), F.col("o_orderstatus").alias("provision_no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"), none.alias("summary"), none.alias("note"))
    return graph.show_amendments(log, _customer_statutes(spark, sf_dir), _probe(spark, sf_dir), limit=100)


@query("SELECT p.p_partkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R') THEN 'validated' ELSE 'cannot_validate' END AS status FROM part p")
def cite_validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("PART "), F.col("p_partkey")).alias("citation"))
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("part "), F.col("l_partkey")).alias("citation"))
    return lookup.validate_batch(asked, known, "citation").select("p_partkey", "status")


@query(f"SELECT 'validated' AS status, c_name AS citation, c_mktsegment AS title FROM customer WHERE c_custkey = {PROBE}")
def cite_validate_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.cite_validate(_provisions(spark, sf_dir), _customer_statutes(spark, sf_dir), _cases(spark, sf_dir), case_citation=_probe(spark, sf_dir).upper())


@query(f"SELECT c_name AS citation, count(*) AS n, min(place) AS first FROM customer JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey = {PROBE}) ON c_custkey = o_custkey WHERE place <= 20 GROUP BY 1")
def lookup_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    cases = _cases(spark, sf_dir).withColumns({"promulgation_date": none, "ponente": none, "division": none, "status": F.lit("reported"), "source_url": none})
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    passages = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), place.alias("passage_no"), none.alias("heading"), F.col("o_orderpriority").alias("body"))
    rows = lookup.get_case(cases, passages, _probe(spark, sf_dir).lower())
    return rows.select("citation", F.col("passageCount").cast("long").alias("n"), F.element_at("passages", 1)["passage_no"].cast("long").alias("first"))


@query("SELECT c_custkey, CAST(nullif(regexp_extract(c_name, '[0-9]+'), '') AS BIGINT) AS number FROM customer")
def numeric_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", leading_int(F.regexp_extract("c_name", "[0-9].*", 0)).alias("number"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.orphans(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def vocabulary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("court", F.when(F.col("o_orderstatus") == "F", "sc").when(F.col("o_orderstatus") == "O", "ca").otherwise(F.col("o_orderstatus")))
    return schemas.violations(rows, "cases").select("o_orderkey", "o_orderstatus")


#: A passage cites parts of so many consecutive keys at most, however many its customer cites.
_PASSAGE_KEYS = 1024


def _citing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each customer, in passages of bounded size, that cite the parts of their orders as acts, and the customer as a case."""
    keys = _references(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")).select("citing_id", F.floor(F.col("cited_id") / _PASSAGE_KEYS).alias("passage"), "cited_id")
    keys = keys.repartition("citing_id", "passage").groupBy("citing_id", "passage").agg(F.collect_set("cited_id").alias("keys"))  # keys are shuffled once, by themselves
    said = F.transform("keys", lambda k: F.concat(F.lit("See Republic Act No. "), k, F.lit(".")))
    texts = keys.select("citing_id", "passage", F.array_join(F.array_sort(said), "\n").alias("acts"))
    return texts.select(F.lit("case").alias("citing_kind"), "citing_id", "passage", F.concat(F.lit("G.R. No. "), F.col("citing_id"), F.lit(" holds.\n"), F.col("acts")).alias("text"))


def _numbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).withColumn("citation", F.concat(F.lit("G.R. No. "), F.col("id")))


@query("SELECT DISTINCT o_custkey AS citing_id, CAST(l_partkey AS VARCHAR) AS act_number FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def citation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = citations.extract_citations(_citing_texts(spark, sf_dir), max_spans=None)
    return spans.filter("kind = 'statute'").select("citing_id", "act_number").distinct()


@query("SELECT DISTINCT 'case' AS citing_kind, o_custkey AS citing_id, 'statute' AS cited_kind, l_partkey AS cited_id, 'Republic Act No. ' || l_partkey AS cited_reference FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.build_graph(_citing_texts(spark, sf_dir), _statutes(spark, sf_dir), _numbered_cases(spark, sf_dir), max_spans=None, over_borders=False).edges


@query("SELECT n + c AS spans, n AS resolved, c AS unresolved, n AS edges_inserted FROM (SELECT count(*) AS n, count(DISTINCT o_custkey) AS c FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey))")
def resolve_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.build_graph(_citing_texts(spark, sf_dir), _statutes(spark, sf_dir), _numbered_cases(spark, sf_dir), max_spans=None, over_borders=False).counters


@query(f"SELECT s.slug, s.name, count(n_nationkey) AS n FROM (VALUES {_NAMES}) s(slug, name) LEFT JOIN nation ON n_nationkey % 15 = (SELECT count(*) FROM (VALUES {_NAMES}) t(slug, name) WHERE t.slug < s.slug) GROUP BY 1, 2".replace("Human Resources & Workplace", "HR & Workplace"))
def domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with how many nations are dealt to each, in order of slug."""
    domains = lookup.list_domains(registry.domain_names(spark), registry.registry(spark)).select("slug", "name")
    slugs = sorted(d[0] for d in registry.DOMAINS)
    dealt = table(spark, sf_dir, "nation").select(F.element_at(F.array(*(F.lit(s) for s in slugs)), (F.col("n_nationkey") % 15 + 1).cast("int")).alias("slug"))
    return domains.join(dealt.groupBy("slug").agg(F.count("*").alias("n")), "slug", "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT 'q' || o_orderkey AS question, CASE WHEN o_orderkey % 4 = 0 THEN 'none of these' ELSE o_orderpriority END AS answer,
 CASE WHEN o_orderkey % 4 = 0 THEN 'fail' WHEN o_orderkey % 4 = 1 THEN 'cover' ELSE 'pass' END AS outcome FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, all answered at once: customers as statutes, whose provisions are their orders; a quarter asks for what isn't there, a quarter for another answer."""
    from . import tools

    orders, customers, none = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    key = F.col("o_orderkey")
    provisions = orders.select(key.alias("id"), F.col("o_custkey").alias("statute_id"), key.cast("string").alias("provision_no"), none.alias("heading"), F.col("o_orderpriority").alias("body"), F.lit("in_force").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), none.alias("valid_until"))
    cases = spark.createDataFrame([], schemas.TABLES["cases"])
    corpora = ingest.Corpora({"statutes": _customer_statutes(spark, sf_dir), "provisions": provisions, "cases": cases, "case_passages": spark.createDataFrame([], schemas.TABLES["case_passages"])})
    asked = F.when(key % 4 == 1, F.concat(F.lit("no "), key)).otherwise(F.concat(F.lit("Sec. "), key))
    step = F.struct(F.lit("get_provision").alias("tool"), F.create_map(F.lit("statute"), F.upper("c_name"), F.lit("provision"), asked).alias("args"))
    golden = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("q"), key).alias("question"), F.when(key % 4 == 0, "none of these").otherwise(F.col("o_orderpriority")).alias("answer"), F.array(step).alias("plan"))
    return tools.run_golden_set(corpora, golden)
