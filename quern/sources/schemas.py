"""Schemas of the three corpora, and the rules that rows must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies.
ENUMS = {
    ("statutes", "kind"): ("constitution", "code", "republic_act", "presidential_decree", "executive_order", "act", "rules", "other"),
    ("statutes", "status"): ("in_force", "amended", "repealed", "superseded"),
    ("provisions", "status"): ("in_force", "amended", "repealed", "superseded"),
    ("cases", "court"): ("sc", "ca", "sb", "cta", "other"),
    ("issuances", "status"): ("current", "superseded", "revoked"),
}

TABLES = {
    "domains": "slug string, name string, description string",
    "statutes": "id long, short_title string, official_title string, kind string, act_number string, domain string, enacted_date string, status string, source_url string, content_hash string, retrieved_at string, created_at string, updated_at string",
    "provisions": "id long, statute_id long, provision_no string, heading string, body string, status string, valid_from string, valid_until string",
    "amendments": "id long, statute_id long, amending_law string, amending_law_id long, provision_no string, effective_date string, summary string, note string",
    "cases": "id long, citation string, title string, court string, promulgation_date string, ponente string, division string, status string, source_url string, content_hash string, retrieved_at string",
    "case_passages": "id long, case_id long, passage_no int, heading string, body string",
    "edges": "citing_kind string, citing_id long, cited_kind string, cited_id long, cited_reference string",
    "issuances": "id long, agency string, issuance_type string, reference_no string, title string, issue_date string, status string, source_url string, content_hash string, retrieved_at string",
    "issuance_passages": "id long, issuance_id long, passage_no int, heading string, body string",
}

CORPORA = {"laws": ("domains", "statutes", "provisions", "amendments"), "cases": ("cases", "case_passages", "edges"), "issuances": ("issuances", "issuance_passages")}

#: Columns that no two rows may share.
UNIQUE = {
    "domains": ("slug",),
    "provisions": ("statute_id", "provision_no", "valid_from"),
    "cases": ("citation",),
    "case_passages": ("case_id", "passage_no"),
    "edges": ("citing_kind", "citing_id", "cited_kind", "cited_id"),
    "issuances": ("agency", "issuance_type", "reference_no"),
    "issuance_passages": ("issuance_id", "passage_no"),
}

#: (table, column, parent table, parent column)
REFERENCES = (
    ("statutes", "domain", "domains", "slug"),
    ("provisions", "statute_id", "statutes", "id"),
    ("amendments", "statute_id", "statutes", "id"),
    ("case_passages", "case_id", "cases", "id"),
    ("issuance_passages", "issuance_id", "issuances", "id"),
)

#: One line of seed data: a kind, and the union of the three record shapes.
SEED = (
    "kind string, record struct<sourceUrl: string, retrievedAt: string, contentHash: string, shortTitle: string, officialTitle: string, kind: string, actNumber: string, domain: string, enactedDate: string, "
    "provisions: array<struct<provisionNo: string, heading: string, body: string, status: string, validFrom: string, validUntil: string>>, "
    "citation: string, title: string, court: string, promulgationDate: string, ponente: string, division: string, "
    "agency: string, issuanceType: string, referenceNo: string, issueDate: string, "
    "passages: array<struct<passageNo: int, heading: string, body: string>>>"
)


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside a closed vocabulary, with ``broken`` naming the columns."""
    checks = [F.when(F.col(c).isNull() | ~F.col(c).isin(*values), F.lit(c)) for (t, c), values in ENUMS.items() if t == table]
    if table == "edges":
        filled = F.col("citing_id").isNotNull() & F.col("cited_id").isNotNull()
        checks.append(F.when(~(filled & F.col("citing_kind").isin("case", "statute") & F.col("cited_kind").isin("case", "statute")), F.lit("ends")))
    return df.withColumn("broken", F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")).filter(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that more than one row has, with ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is not null and has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, table, n): how many rows or keys break each rule."""
    parts = []
    for name, df in tables.items():
        parts.append(violations(df, name).agg(F.count("*").alias("n")).select(F.lit("vocabulary").alias("rule"), F.lit(name).alias("table"), "n"))
        if name in UNIQUE:
            parts.append(duplicate_keys(df, *UNIQUE[name]).agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), F.lit(name).alias("table"), "n"))
    for child, column, parent, parent_column in REFERENCES:
        if child in tables and parent in tables:
            parts.append(orphans(tables[child], column, tables[parent], parent_column).agg(F.count("*").alias("n")).select(F.lit("reference").alias("rule"), F.lit(child).alias("table"), "n"))
    return reduce(DataFrame.unionByName, parts)
