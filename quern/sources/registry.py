"""The registry of domains: names, corpora, how often they are refreshed, and which other domains they refer to.

Descriptions, key instruments, sources and the reasons of references are prose
that an operator of the corpus keeps in a JSON file; ``load_registry`` reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slug, name, corpora, refresh cadence, targets of cross-references in order.
DOMAINS = (
    ("accounting", "Accounting & Auditing Law", ("laws", "issuances"), "medium", ("tax", "commercial-corporate", "administrative", "payroll")),
    ("administrative", "Administrative Law", ("laws", "issuances"), "medium", ("constitutional", "remedial", "tax")),
    ("business-transactional", "Business & Transactional Law", ("laws", "cases", "issuances"), "medium", ("civil", "commercial-corporate", "special", "remedial")),
    ("civil", "Civil Law", ("laws",), "low", ("constitutional", "family", "commercial-corporate", "special")),
    ("commercial-corporate", "Commercial/Corporate Law", ("laws",), "medium", ("civil", "tax", "special")),
    ("constitutional", "Constitutional Law", ("laws",), "low", ("civil", "criminal", "remedial", "local-government")),
    ("criminal", "Criminal Law", ("laws",), "medium", ("constitutional", "remedial", "special")),
    ("family", "Family Code", ("laws",), "low", ("civil", "criminal", "remedial")),
    ("human-resources", "Human Resources & Workplace Compliance", ("laws", "cases", "issuances"), "high", ("labor", "payroll", "administrative", "special")),
    ("labor", "Labor Law", ("laws", "cases"), "medium", ("constitutional", "civil", "remedial")),
    ("local-government", "Local Government Law", ("laws",), "low", ("constitutional", "tax", "administrative")),
    ("payroll", "Payroll & Benefits Law", ("laws", "issuances"), "high", ("labor", "tax", "accounting", "special")),
    ("remedial", "Remedial Law", ("laws", "cases"), "medium", ("constitutional", "criminal", "civil")),
    ("special", "Special/Cross-Cutting Laws", ("laws", "issuances"), "medium", ("commercial-corporate", "labor", "criminal", "administrative")),
    ("tax", "Tax Law", ("laws", "issuances"), "high", ("constitutional", "commercial-corporate", "local-government", "special")),
)
#: Where the table of domains has another name than the registry.
TABLE_NAMES = {"human-resources": "HR & Workplace Compliance"}

SCHEMA = "slug string, name string, description string, keyInstruments array<string>, sources array<struct<name: string, url: string, cadence: string>>, corpora array<string>, refreshCadence string, crossRefs array<struct<target: string, reason: string>>"


def registry(spark: SparkSession) -> DataFrame:
    """The registry without prose."""
    rows = [(slug, name, None, [], [], list(corpora), cadence, [(t, None) for t in targets]) for slug, name, corpora, cadence, targets in DOMAINS]
    return spark.createDataFrame(rows, SCHEMA)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry from JSON lines in SCHEMA."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def domain_names(spark: SparkSession) -> DataFrame:
    """The table of domains: slug, name, description."""
    return spark.createDataFrame([(slug, TABLE_NAMES.get(slug, name), None) for slug, name, *_ in DOMAINS], "slug string, name string, description string")


def registry_problems(modules: DataFrame) -> DataFrame:
    """(problem, slug): slugs that occur twice, and references to domains that do not exist."""
    twice = modules.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate slug").alias("problem"), "slug")
    targets = modules.select("slug", F.explode("crossRefs.target").alias("target"))
    return twice.union(targets.join(modules.select(F.col("slug").alias("target")), "target", "left_anti").select(F.lit("dangling reference").alias("problem"), "slug"))
