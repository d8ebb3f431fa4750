"""Seed lines and fetched pages into corpus tables, with their manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions.tables import releasing, written
from quern.functions.text import content_hash
from quern.operators.citations import build_graph
from quern.operators.segment import normalise_statute

from .html import MIN_TEXT, SELECTORS, extract_article
from .registry import domain_names
from .schemas import CORPORA, SEED, TABLES


def load_seed(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(kind, record) of every line of the folder's files of that name; a line that is no JSON fails, a missing folder is empty."""
    try:
        rows = spark.read.schema(SEED).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SEED)
        raise
    return rows.filter("kind IS NOT NULL AND record IS NOT NULL")


def records(seed: DataFrame, kind: str) -> DataFrame:
    return seed.filter(F.col("kind") == kind).select("record.*")


def numbered(df: DataFrame, *keys: str, to: str = "id", once: bool = False) -> DataFrame:
    """Identifiers 1, 2, … in order of the natural key: keys are sorted in ranges, and each range starts where those before it end. Rows are shuffled once, to meet
    their key's identifier; with ``once`` one row of each key stays, where it lies."""
    order = df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(order.select(*keys, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row")), release=True)  # once, as ranges come of a sample
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = sizes.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    key = F.struct(*keys).alias("_key")  # structs with equal nulls are equal
    own = placed.join(F.broadcast(starts), "_range").select(key, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(to))
    found = df.select("*", key).join(own, "_key")
    return (found.dropDuplicates(["_key"]) if once else found).drop("_key")


def child_ids(parent: str, place: str) -> Column:
    """Identifiers of children from their parent's and their place in an array, which is under 2^31: in order of both, and no two the same."""
    return F.shiftleft(F.col(parent), 31) + F.col(place)


def _fit(df: DataFrame, table: str) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


@dataclass(frozen=True)
class Corpora:
    """The tables of all three corpora by name."""

    tables: dict[str, DataFrame]
    #: The folder from which they were opened.
    folder: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _statute_parents(rows: DataFrame) -> DataFrame:
    parents = numbered(rows, "shortTitle", "sourceUrl", once=True)
    return parents.withColumnsRenamed({"shortTitle": "short_title", "officialTitle": "official_title", "actNumber": "act_number", "enactedDate": "enacted_date", "sourceUrl": "source_url", "contentHash": "content_hash", "retrievedAt": "retrieved_at"})


def _case_parents(rows: DataFrame) -> DataFrame:
    return numbered(rows, "citation").withColumnsRenamed({"promulgationDate": "promulgation_date", "sourceUrl": "source_url", "contentHash": "content_hash", "retrievedAt": "retrieved_at"})


def _issuance_parents(rows: DataFrame) -> DataFrame:
    names = {"issuanceType": "issuance_type", "referenceNo": "reference_no", "issueDate": "issue_date", "sourceUrl": "source_url", "contentHash": "content_hash", "retrievedAt": "retrieved_at"}
    return numbered(rows.withColumnsRenamed(names), "agency", "issuance_type", "reference_no")


def _statutes(parents: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    kids = parents.select(F.col("id").alias("statute_id"), "enacted_date", F.posexplode("provisions").alias("place", "p"))
    kids = kids.select(child_ids("statute_id", "place").alias("id"), "statute_id", F.col("p.provisionNo").alias("provision_no"), F.col("p.heading").alias("heading"), F.col("p.body").alias("body"), F.lit("in_force").alias("status"), F.coalesce("p.validFrom", "enacted_date", F.lit(today)).alias("valid_from"))
    return _fit(parents.withColumn("status", F.lit("in_force")), "statutes"), _fit(kids, "provisions")


def _with_passages(parents: DataFrame, status: str, key: str, table: str, children: str) -> tuple[DataFrame, DataFrame]:
    kids = parents.select(F.col("id").alias(key), F.posexplode("passages").alias("place", "p"))
    kids = kids.select(child_ids(key, "place").alias("id"), key, F.col("p.passageNo").alias("passage_no"), F.col("p.heading").alias("heading"), F.col("p.body").alias("body"))
    return _fit(parents.withColumn("status", F.lit(status)), table), _fit(kids, children)


def statute_tables(rows: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(statutes, provisions): all in force, valid from their own date, else the enactment, else today."""
    return _statutes(_statute_parents(rows), today)


def case_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _with_passages(_case_parents(rows), "reported", "case_id", "cases", "case_passages")


def issuance_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _with_passages(_issuance_parents(rows), "current", "issuance_id", "issuances", "issuance_passages")


def citation_sources(statutes: DataFrame, cases: DataFrame) -> DataFrame:
    """(citing_kind, citing_id, texts) to look for citations in: the passages of cases and of statutes, as their records hold them."""
    own = lambda parents, kind, column: parents.select(F.lit(kind).alias("citing_kind"), F.col("id").alias("citing_id"), F.col(f"{column}.body").alias("texts"))
    return own(cases, "case", "passages").unionByName(own(statutes, "statute", "provisions"))


def build_corpora(spark: SparkSession, seed: DataFrame, today: str, *, citations: bool = True) -> Corpora:
    """All tables from seed lines; edges from their texts unless ``citations`` is false. Numbered records are written once, and tables and edges are made where they lie."""
    laws, rulings, notices = (written(of(records(seed, kind)), release=True) for of, kind in ((_statute_parents, "statute"), (_case_parents, "case"), (_issuance_parents, "issuance")))
    statutes, provisions = _statutes(laws, today)
    cases, case_passages = _with_passages(rulings, "reported", "case_id", "cases", "case_passages")
    issuances, issuance_passages = _with_passages(notices, "current", "issuance_id", "issuances", "issuance_passages")
    tables = {"domains": domain_names(spark), "statutes": statutes, "provisions": provisions, "amendments": spark.createDataFrame([], TABLES["amendments"])}
    tables |= {"cases": cases, "case_passages": case_passages, "issuances": issuances, "issuance_passages": issuance_passages}
    tables["edges"] = build_graph(citation_sources(laws, rulings), statutes, cases).edges if citations else spark.createDataFrame([], TABLES["edges"])
    return Corpora(tables)


def write_corpora(corpora: Corpora, folder: str, names: list[str] | None = None) -> None:
    """Rebuild the Parquet tables of some or all corpora."""
    for corpus in names or CORPORA:
        for table in CORPORA[corpus]:
            with releasing(corpora[table].sparkSession):
                corpora[table].write.mode("overwrite").parquet(f"{folder}/{corpus}/{table}")


def open_corpora(spark: SparkSession, folder: str, *, views: bool = False) -> Corpora:
    """Tables of a built folder; a table that is not there is empty, with its schema."""
    tables = {}
    for corpus, names in CORPORA.items():
        for name in names:
            try:
                tables[name] = spark.read.parquet(f"{folder}/{corpus}/{name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                tables[name] = spark.createDataFrame([], TABLES[name])
            if views:
                tables[name].createOrReplaceTempView(name)
    return Corpora(tables, folder)


def targets(catalogue: DataFrame, pages: DataFrame, prefix: str, *, since: str | None = None, limit: int | None = None, min_chars: int = MIN_TEXT, selectors: tuple[str, ...] = SELECTORS) -> DataFrame:
    """Fetched documents of catalogue entries under a url prefix: those since a date (or undated), without thin pages, the first ``limit`` in catalogue order.

    ``catalogue`` has ``place`` and ``source_url``; ``pages`` has ``url`` and ``html``.
    """
    wanted = catalogue.filter(F.col("source_url").startswith(prefix))
    if since:
        wanted = wanted.filter(F.col("enacted_date").isNull() | (F.col("enacted_date") >= since))
    found = wanted.join(pages.select(F.col("url").alias("source_url"), "html"), "source_url")
    found = extract_article(found, selectors=selectors).filter(F.length("text") >= min_chars).orderBy("place")
    return found.limit(limit) if limit is not None else found


def new_documents(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose (short_title, source_url) is not there yet."""
    return documents.join(existing.select("short_title", "source_url"), ["short_title", "source_url"], "left_anti")


def statutes_from_pages(documents: DataFrame) -> DataFrame:
    """Records as in seed lines from fetched documents with their catalogue columns."""
    clean, sections = normalise_statute(documents.select("source_url", "text"))
    parts = sections.groupBy("source_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "number", "heading", "body"))), lambda s: F.struct(s["number"].alias("provisionNo"), F.nullif(s["heading"], F.lit("")).alias("heading"), s["body"].alias("body"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("validFrom"), F.lit(None).cast("string").alias("validUntil"))).alias("provisions"))
    rows = documents.drop("text", "html", "title").join(clean.select("source_url", "content_hash"), "source_url").join(parts, "source_url", "left")
    return rows.withColumnsRenamed({"source_url": "sourceUrl", "short_title": "shortTitle", "official_title": "officialTitle", "act_number": "actNumber", "enacted_date": "enactedDate", "content_hash": "contentHash"})


def catalogue_problems(catalogue: DataFrame, domains: DataFrame) -> DataFrame:
    """(problem, value): repeated ids, act numbers of one kind, and urls; domains that do not exist."""
    repeated = [catalogue.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value"), *(["kind"] if c == "act_number" else [])).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"duplicate {c}").alias("problem"), "value") for c in ("id", "act_number", "source_url")]
    unknown = catalogue.join(domains.select(F.col("slug").alias("domain")), "domain", "left_anti").select(F.lit("unknown domain").alias("problem"), F.col("domain").alias("value"))
    return repeated[0].union(repeated[1]).union(repeated[2]).union(unknown)


def catalogue_domains(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("domain").distinct().orderBy("domain")


def passage_hash(passages: Column) -> Column:
    """Hash of an array of (number, heading, body) as seed generators write it."""
    return content_hash(F.array_join(F.transform(passages, lambda p: F.concat_ws(" ", p["provisionNo"], p["heading"], p["body"])), "\n\n"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, modified) of files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def parse_checksum(text: Column) -> Column:
    """The digest of a line ``<hex>  <name>``."""
    return F.lower(F.element_at(F.split(F.trim(text), r"\s+"), 1))


def failed_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (file, sha256) that are missing or differ."""
    return expected.withColumnRenamed("sha256", "expected").join(found, "file", "left").filter(~F.col("expected").eqNullSafe(F.col("sha256"))).select("file", "expected", "sha256")


def freshness(spark: SparkSession, path: str) -> str | None:
    """When the newest file under a path was written, as ISO text in UTC; null if there is none. Only the listing is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return None
    newest = F.to_utc_timestamp(F.max("modificationTime"), F.current_timezone())
    return files.agg(F.date_format(newest, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).first()[0]


def record_counts(corpora: Corpora) -> DataFrame:
    """(corpus, records, passages)."""
    parts = [("laws", "statutes", "provisions"), ("cases", "cases", "case_passages"), ("issuances", "issuances", "issuance_passages")]
    rows = [corpora[r].agg(F.count("*").alias("records")).crossJoin(corpora[p].agg(F.count("*").alias("passages"))).select(F.lit(c).alias("corpus"), "records", "passages") for c, r, p in parts]  # one row each
    return rows[0].union(rows[1]).union(rows[2])


def manifest(corpora: Corpora, built_at: str, stamp: str, sources: list[str], seed_dir: str, folder: str | None = None) -> str:
    """The manifest as JSON; corpora without records are left out. With the built ``folder``, each corpus has one digest over its files' digests."""
    counts = {r["corpus"]: {"records": r["records"], "passages": r["passages"]} for r in record_counts(corpora).collect() if r["records"]}
    for corpus in counts if folder else ():
        files = file_checksums(corpora["statutes"].sparkSession, f"{folder}/{corpus}").filter(F.col("file").endswith(".parquet"))
        digest = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "").cast("binary"), 256).alias("d")).first()["d"]  # a digest for each file
        counts[corpus] |= {"file": corpus, "sha256": digest}
    return json.dumps({"schemaVersion": 1, "version": stamp, "builtAt": built_at, "corpora": counts, "sources": sources, "seedDir": seed_dir}, indent=2)


def default_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyy.MM.dd")
