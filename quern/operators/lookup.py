"""Exact and version-aware look-ups, citation validation and bounded payloads.

A look-up is a filter on a normalised key followed by the first row in a total
order; batch forms take a table of requests and join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower, leading_int, strip_provision_prefix

PASSAGES, MOST_PASSAGES, PROVISIONS, PAYLOAD_CHARS, PAYLOAD_ITEMS = 20, 100, 100, 25_000, 50


def same(a: Column, b: Column | str) -> Column:
    """Equal but for the case of A-Z."""
    return ascii_lower(a) == ascii_lower(F.lit(b) if isinstance(b, str) else b)


def latest_versions(rows: DataFrame, keys: list[str], version: str, tie: list[str]) -> DataFrame:
    """Of each key the row with the greatest version; ties by the columns in ``tie``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), *tie))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_row(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def status_of(df: DataFrame, empty: str, found: str = "ok") -> DataFrame:
    """One row (status, count) for a result."""
    return df.agg(F.count("*").alias("count")).select(F.when(F.col("count") == 0, empty).otherwise(found).alias("status"), "count")


def get_provision(provisions: DataFrame, statutes: DataFrame, statute: str, provision: str) -> DataFrame:
    """The newest version of a provision; both numbers lose their prefix first. No row if there is none."""
    titles = statutes.filter(same(F.col("short_title"), statute) | same(F.col("official_title"), statute))
    titles = titles.select(F.col("id").alias("statute_id"), "short_title", "official_title", "kind", "domain", F.col("status").alias("statute_status"))
    rows = provisions.filter(same(strip_provision_prefix(F.col("provision_no")), strip_provision_prefix(F.lit(provision)))).join(titles, "statute_id")
    return first_row(rows, F.col("valid_from").desc_nulls_last(), "id").select(*_provision())


def _provision() -> list[Column]:
    names = {"short_title": "statute", "official_title": "officialTitle", "kind": "kind", "domain": "domain", "provision_no": "provisionNo", "heading": "heading", "body": "body", "status": "provisionStatus", "statute_status": "statuteStatus", "valid_from": "validFrom", "valid_until": "validUntil"}
    return [citation("short_title", "provision_no", "heading").alias("citation"), *(F.col(c).alias(n) for c, n in names.items())]


def get_provisions(requests: DataFrame, provisions: DataFrame, statutes: DataFrame) -> DataFrame:
    """``get_provision`` for a table of requests (request, statute, provision): a row for each that is found, with the request."""
    titles = statutes.select(F.explode(F.array_distinct(F.array(ascii_lower(F.col("short_title")), ascii_lower(F.col("official_title"))))).alias("_title"), F.col("id").alias("statute_id"), "short_title", "official_title", "kind", "domain", F.col("status").alias("statute_status"))
    asked = requests.select("request", ascii_lower(F.col("statute")).alias("_title"), ascii_lower(strip_provision_prefix(F.col("provision"))).alias("_number"))
    rows = asked.join(titles, "_title").join(provisions.withColumn("_number", ascii_lower(strip_provision_prefix(F.col("provision_no")))), ["statute_id", "_number"])
    newest = Window.partitionBy("request").orderBy(F.col("valid_from").desc_nulls_last(), "id")
    return rows.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").select("request", *_provision())


def citation(title: str, number: str, heading: str) -> Column:
    return F.concat(F.col(title), F.lit(", "), F.col(number), F.when(F.col(heading).isNotNull(), F.concat(F.lit(" ("), F.col(heading), F.lit(")"))).otherwise(""))


def _with_passages(parent: DataFrame, passages: DataFrame, key: str, limit: int) -> DataFrame:
    if not 1 <= limit <= MOST_PASSAGES:
        raise ValueError(f"1 to {MOST_PASSAGES} passages")
    own = passages.join(F.broadcast(parent.select(F.col("id").alias(key))), key).orderBy("passage_no", "id").limit(limit)
    items = own.agg(F.array_sort(F.collect_list(F.struct("passage_no", "heading", "body"))).alias("passages"))
    return parent.crossJoin(F.broadcast(items)).withColumn("passageCount", F.size("passages"))  # one row each


def get_case(cases: DataFrame, passages: DataFrame, case_citation: str, limit: int = PASSAGES) -> DataFrame:
    """A case with its first passages; ``passageCount`` counts those returned."""
    found = _with_passages(first_row(cases.filter(same(F.col("citation"), case_citation)), "id"), passages, "case_id", limit)
    return found.select(*_case())


def _case() -> list[Column]:
    return ["citation", "title", "court", F.col("promulgation_date").alias("promulgationDate"), "ponente", "division", F.col("status").alias("caseStatus"), F.col("source_url").alias("sourceUrl"), "passageCount", "passages"]


def get_cases(requests: DataFrame, cases: DataFrame, passages: DataFrame, limit: int = PASSAGES) -> DataFrame:
    """``get_case`` for a table of requests (request, citation): a row for each that is found, with the request."""
    known = cases.withColumn("_key", ascii_lower(F.col("citation")))
    first = Window.partitionBy("_key").orderBy("id")
    known = known.withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    rows = requests.select("request", ascii_lower(F.col("citation")).alias("_key")).join(known, "_key")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("passage_no", "id"))
    wanted = passages.join(rows.select(F.col("id").alias("case_id")).distinct(), "case_id", "left_semi")
    own = wanted.withColumn("_place", place).filter(F.col("_place") <= limit).groupBy(F.col("case_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("passage_no", "heading", "body"))).alias("passages"))  # at most ``limit``
    none = F.array().cast("array<struct<passage_no:int,heading:string,body:string>>")
    return rows.join(own, "id", "left").withColumn("passages", F.coalesce("passages", none)).withColumn("passageCount", F.size("passages")).select("request", *_case())


def get_issuance(issuances: DataFrame, passages: DataFrame, agency: str, reference_no: str, limit: int = PASSAGES) -> DataFrame:
    """An issuance with its first passages."""
    own = issuances.filter(same(F.col("agency"), agency) & same(F.col("reference_no"), reference_no))
    found = _with_passages(first_row(own, "id"), passages, "issuance_id", limit)
    return found.select("agency", F.col("issuance_type").alias("issuanceType"), F.col("reference_no").alias("referenceNo"), "title", F.col("issue_date").alias("issueDate"), F.col("status").alias("issuanceStatus"), F.col("source_url").alias("sourceUrl"), "passageCount", "passages")


def cite_validate(provisions: DataFrame, statutes: DataFrame, cases: DataFrame, *, statute: str | None = None, provision: str | None = None, case_citation: str | None = None) -> DataFrame:
    """One row: status, and the citation's text if it is valid. A case citation goes first. Only the argument loses its prefix, the stored number does not."""
    spark = cases.sparkSession
    if case_citation:
        found = first_row(cases.filter(same(F.col("citation"), case_citation)), "id").select("citation", "title")
    elif statute:
        titles = statutes.filter(same(F.col("short_title"), statute) | same(F.col("official_title"), statute)).select(F.col("id").alias("statute_id"), "short_title")
        rows = provisions.join(titles, "statute_id")
        if provision:
            rows = rows.filter(ascii_lower(F.col("provision_no")) == ascii_lower(strip_provision_prefix(F.lit(provision))))
        rows = first_row(rows, F.col("valid_from").desc_nulls_last(), "id")
        found = rows.select(citation("short_title", "provision_no", "heading").alias("citation"), F.col("status").alias("provisionStatus"), "body")
    else:
        return spark.range(1).select(F.lit("invalid_request").alias("status"))
    one = spark.range(1).select(F.lit(1).alias("_one"))
    return one.join(found.withColumn("_one", F.lit(1)), "_one", "left").drop("_one").select(F.when(F.col("citation").isNull(), "cannot_validate").otherwise("validated").alias("status"), "*")


def validate_batch(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requests with ``status``: validated if the key is known but for case, else cannot_validate."""
    keys = known.select(ascii_lower(F.col(key).cast("string")).alias("_key")).distinct()
    asked = requests.withColumn("_key", ascii_lower(F.col(key).cast("string")))
    return asked.join(keys.withColumn("_known", F.lit(True)), "_key", "left").withColumn("status", F.when(F.col("_known"), "validated").otherwise("cannot_validate")).drop("_key", "_known")


def statute_payload(statutes: DataFrame, provisions: DataFrame, statute: str) -> DataFrame:
    """One statute with its first provisions, numbers in numeric order; no row if it is not found."""
    found = first_row(statutes.filter(same(F.col("short_title"), statute) | same(F.col("official_title"), statute)), "id")
    own = provisions.join(F.broadcast(found.select(F.col("id").alias("statute_id"))), "statute_id")
    own = own.withColumn("number", leading_int(F.col("provision_no"))).orderBy("number", "provision_no", "id").limit(PROVISIONS)
    items = own.agg(F.array_sort(F.collect_list(F.struct("number", "provision_no", "id", "heading", "body", "status"))).alias("provisions"))
    return found.crossJoin(F.broadcast(items)).withColumn("provisions", F.transform("provisions", lambda x: x.dropFields("number", "id")))  # one row each


def list_domains(domains: DataFrame, registry: DataFrame, last_refresh: Column | None = None) -> DataFrame:
    """All domains with what the registry says of them; lists are empty where it says nothing."""
    more = registry.select("slug", "keyInstruments", "sources", "refreshCadence")
    rows = domains.join(more, "slug", "left")
    return rows.select("slug", "name", "description", (last_refresh if last_refresh is not None else F.lit(None)).cast("string").alias("lastRefresh"), F.coalesce("keyInstruments", F.array().cast("array<string>")).alias("keyInstruments"), F.coalesce("sources", F.array().cast(registry.schema["sources"].dataType)).alias("sources"), "refreshCadence").orderBy("slug")


def bounded(df: DataFrame, items_col: str) -> DataFrame:
    """``df`` with only the first items of a list column where its JSON is too long, and ``truncated`` to say so."""
    long = F.length(F.to_json(F.col(items_col), {"ignoreNullFields": "false"})) > PAYLOAD_CHARS
    return df.withColumns({"truncated": long, items_col: F.when(long, F.slice(items_col, 1, PAYLOAD_ITEMS)).otherwise(F.col(items_col))})


def rendered(payload: Column) -> Column:
    """A payload's text for readers, cut where it is too long."""
    return F.when(F.length(payload) > PAYLOAD_CHARS, F.concat(F.substring(payload, 1, PAYLOAD_CHARS), F.lit("\n… [truncated]"))).otherwise(payload)
