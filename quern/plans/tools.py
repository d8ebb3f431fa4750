"""The tools by name, over built corpora, and the golden evaluation that runs them.

Each tool takes the corpora and its own arguments and returns a one-row table
with ``status`` and, where it answers, ``payload`` as JSON; ``call`` adds ``text``,
the payload cut at 25,000 characters.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import calendar
from quern.functions.tables import written
from quern.operators import evaluate, graph, lookup, search
from quern.sources.ingest import Corpora, freshness
from quern.sources.registry import registry

NOT_COVERED, CANNOT = "insufficient_corpus_coverage", "cannot_validate"
Tool = Callable[..., DataFrame]


def _packed(rows: DataFrame, empty: str | None = NOT_COVERED) -> DataFrame:
    """One row: the rows as a JSON list, which are a page or all versions of one provision; ``empty`` is the status without any (None: that is no failure)."""
    listed = rows.agg(F.count("*").alias("count"), F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("payload"))
    status = F.lit("ok") if empty is None else F.when(F.col("count") == 0, empty).otherwise("ok")
    return listed.select(status.alias("status"), "count", "payload")


def _found(entity: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a known entity, of which there may be none; a refusal if the entity is unknown."""
    known = entity.agg(F.count("*").alias("known"))
    return _packed(rows, None).crossJoin(F.broadcast(known)).withColumn("status", F.when(F.col("known") == 0, NOT_COVERED).otherwise("ok")).drop("known")  # one row each


def _refreshed(c: Corpora) -> Column:
    """When the tables of laws were last written, if they were opened from a folder."""
    return F.lit(freshness(c["domains"].sparkSession, f"{c.folder}/laws") if c.folder else None)


def _page(page: search.Page) -> DataFrame:
    return page.meta.crossJoin(F.broadcast(_packed(page.rows, None).select("payload")))  # one row each


TOOLS: dict[str, Tool] = {
    "search_statute": lambda c, **a: _page(search.search_statute(c["provisions"], c["statutes"], **a)),
    "search_jurisprudence": lambda c, **a: _page(search.search_jurisprudence(c["case_passages"], c["cases"], **a)),
    "search_issuance": lambda c, **a: _page(search.search_issuance(c["issuance_passages"], c["issuances"], **a)),
    "get_provision": lambda c, **a: _packed(lookup.get_provision(c["provisions"], c["statutes"], **a)),
    "get_case": lambda c, **a: _packed(lookup.bounded(lookup.get_case(c["cases"], c["case_passages"], **a), "passages")),
    "get_issuance": lambda c, **a: _packed(lookup.bounded(lookup.get_issuance(c["issuances"], c["issuance_passages"], **a), "passages")),
    "cite_validate": lambda c, **a: (lambda r: r.select("status", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")))(lookup.cite_validate(c["provisions"], c["statutes"], c["cases"], **a)),
    "list_domains": lambda c: _packed(lookup.list_domains(c["domains"], registry(c["domains"].sparkSession), _refreshed(c))),
    "statute": lambda c, **a: _packed(lookup.statute_payload(c["statutes"], c["provisions"], **a), "not_found"),
    "related_laws": lambda c, case_citation, **a: _found(graph.resolve_case(c["cases"], case_citation), graph.related_laws(c["edges"], c["statutes"], c["cases"], case_citation, **a)),
    "related_cases": lambda c, case_citation, **a: _found(graph.resolve_case(c["cases"], case_citation), graph.related_cases(c["edges"], c["cases"], case_citation, **a)),
    "show_citations": lambda c, case_citation, **a: _found(graph.resolve_case(c["cases"], case_citation), graph.show_citations(c["edges"], c["statutes"], c["cases"], case_citation, **a)),
    "show_amendments": lambda c, statute, act_number=None, **a: _found(graph.resolve_statute(c["statutes"], statute, act_number), graph.show_amendments(c["amendments"], c["statutes"], statute, act_number, **a)),
    "show_history": lambda c, **a: _packed(graph.show_history(c["provisions"], c["statutes"], **a)),
    "show_dependencies": lambda c, statute, act_number=None, **a: _found(graph.resolve_statute(c["statutes"], statute, act_number), _dependencies(c, statute, act_number, **a)),
    "show_implementing_rules": lambda c, statute, act_number=None, **a: _found(graph.resolve_statute(c["statutes"], statute, act_number), graph.show_implementing_rules(c["edges"], c["statutes"], c["cases"], statute, act_number, **a)),
    "show_cross_references": lambda c, statute, act_number=None, **a: _found(graph.resolve_statute(c["statutes"], statute, act_number), graph.show_cross_references(c["edges"], c["statutes"], registry(c["statutes"].sparkSession), statute, act_number, **a)),
    "compute_prescription": lambda c, **a: _calculated(calendar.compute_prescription(c["statutes"].sparkSession, **a)),
    "compute_deadline": lambda c, **a: _calculated(calendar.compute_deadline(c["statutes"].sparkSession, **a)),
    "compute_13th_month": lambda c, **a: _calculated(calendar.compute_13th_month(c["statutes"].sparkSession, **a).withColumn("status", F.lit("ok"))),
}

#: Argument names as callers write them.
ARGUMENTS = {
    "caseCitation": "case_citation",
    "actNumber": "act_number",
    "referenceNo": "reference_no",
    "issuanceType": "issuance_type",
    "actionType": "action_type",
    "causeOfActionDate": "date",
    "filingType": "filing_type",
    "noticeDate": "notice_date",
    "extensionDays": "extension_days",
    "totalBasicSalary": "total_basic_salary",
}


def _calculated(row: DataFrame) -> DataFrame:
    return row.select("status", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def _dependencies(c: Corpora, statute: str, act_number: str | None, **a) -> DataFrame:
    forward, back = graph.show_dependencies(c["edges"], c["statutes"], statute, act_number, **a)
    return graph.ordered_union(forward.withColumn("direction", F.lit("dependency")), back.withColumn("direction", F.lit("dependentOn")), F.col("citedReference").asc_nulls_first(), "shortTitle").drop("ord")


def call(corpora: Corpora, name: str, args: dict | None = None) -> DataFrame:
    """Run a tool with arguments as callers write them."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    given = {ARGUMENTS.get(k, k): v for k, v in (args or {}).items()}
    if name == "get_case" and "case_citation" not in given and "citation" in given:
        given["case_citation"] = given.pop("citation")
    return TOOLS[name](corpora, **given).withColumn("text", lookup.rendered(F.col("payload")))


def _value(text: str | None):
    """An argument from its JSON text: numbers and lists as such, the rest as it is."""
    try:
        out = json.loads(text) if text is not None else None
    except ValueError:
        return text
    return out if isinstance(out, (int, float, list)) and not isinstance(out, bool) else text


NUMBERS = frozenset(("limit", "offset", "extensionDays", "totalBasicSalary", "holidays"))


#: Tools whose calls are answered all at once, from a table of them: (request, args) to (request, columns of the payload).
BATCHED: dict[str, Callable[[Corpora, DataFrame], DataFrame]] = {
    "get_provision": lambda c, steps: lookup.get_provisions(steps.select("request", F.col("args")["statute"].alias("statute"), F.col("args")["provision"].alias("provision")), c["provisions"], c["statutes"]),
    "get_case": lambda c, steps: lookup.bounded(lookup.get_cases(steps.select("request", F.coalesce(F.col("args")["caseCitation"], F.col("args")["citation"]).alias("citation")), c["cases"], c["case_passages"]), "passages"),
}


def run_golden_set(corpora: Corpora, golden: DataFrame) -> DataFrame:
    """(question, answer, outcome) of any number of golden pairs whose plans call only tools that are BATCHED, without optional arguments: a join for each tool, not a query for each pair. Other tools are an error."""
    pairs = written(golden.select("question", "answer", "plan", F.monotonically_increasing_id().alias("pair")))
    steps = pairs.select("pair", F.posexplode("plan").alias("place", "step")).select(F.struct("pair", "place").alias("request"), "step.tool", "step.args")
    if unknown := steps.filter(~F.col("tool").isin(*BATCHED)).select("tool").first():
        raise ValueError(f"{unknown['tool']!r} is called one by one: use run_golden")
    said = None
    for tool, answered in BATCHED.items():
        asked = steps.filter(F.col("tool") == tool)
        found = answered(corpora, asked)
        payload = F.to_json(F.array(F.struct(*(c for c in found.columns if c != "request"))), {"ignoreNullFields": "false"})
        rows = asked.select("request").join(found.select("request", payload.alias("payload")), "request", "left")
        rows = rows.select("request.pair", "request.place", F.when(F.col("payload").isNull(), NOT_COVERED).otherwise("ok").alias("status"), F.coalesce("payload", F.lit("[]")).alias("payload"))
        said = rows if said is None else said.union(rows)
    texts = said.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "payload"))), lambda x: x["payload"]), "\n").alias("text"), F.bool_or(F.col("status") == NOT_COVERED).alias("uncovered"))  # the steps of a plan
    whole = pairs.join(texts, "pair", "left").withColumns({"text": F.coalesce("text", F.lit("")), "uncovered": F.coalesce("uncovered", F.lit(True))})
    return whole.select("question", "answer", evaluate.outcome(evaluate.answer_matches(F.col("text"), F.col("answer")), ~F.col("uncovered") & (F.trim("text") != "")).alias("outcome"))


def run_golden(corpora: Corpora, golden: DataFrame) -> DataFrame:
    """(question, answer, outcome) of golden pairs. A set has a few dozen pairs; each plan's steps become one query."""
    spark, parts = golden.sparkSession, []
    for pair in golden.collect():
        steps = []
        for step in pair["plan"] or []:
            args = {k: _value(v) if k in NUMBERS else v for k, v in (step["args"] or {}).items()}
            steps.append(call(corpora, step["tool"], args).select("status", F.coalesce("payload", F.lit("")).alias("payload")))
        said = spark.createDataFrame([], "status string, payload string")
        for step in steps:
            said = said.union(step)
        said = said.agg(F.array_join(F.collect_list("payload"), "\n").alias("text"), F.coalesce(F.bool_or(F.col("status").isin(NOT_COVERED, CANNOT)), F.lit(True)).alias("uncovered"))
        parts.append(said.select(F.lit(pair["question"]).alias("question"), F.lit(pair["answer"]).alias("answer"), evaluate.outcome(evaluate.answer_matches(F.col("text"), F.lit(pair["answer"])), ~F.col("uncovered") & (F.trim("text") != "")).alias("outcome")))
    out = spark.createDataFrame([], "question string, answer string, outcome string")
    for p in parts:
        out = out.union(p)
    return out
