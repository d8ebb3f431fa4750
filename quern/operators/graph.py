"""Queries on the citation graph: edges are (citing_kind, citing_id, cited_kind, cited_id, cited_reference), one for each pair of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import norm_key, norm_key_of

from .lookup import first_row, same

#: Kind of look-up: rows by default, and at most.
LIMITS = {"related_laws": (20, 50), "related_cases": (10, 50), "show_amendments": (50, 100), "show_dependencies": (50, 100), "show_citations": (100, 200), "show_implementing_rules": (50, 100), "show_cross_references": (50, 100)}


def _limit(name: str, limit: int | None) -> int:
    usual, most = LIMITS[name]
    limit = usual if limit is None else limit
    if not 1 <= limit <= most:
        raise ValueError(f"{name}: a limit is 1 to {most}")
    return limit


def resolve_case(cases: DataFrame, case_citation: str) -> DataFrame:
    """One row (id) at most: the first case with the same letters and digits, whose citation also has the argument's last number as it is."""
    digits = "".join(c if c.isascii() and c.isdigit() else " " for c in case_citation).split()
    found = cases.filter(norm_key(F.col("citation")) == norm_key_of(case_citation))
    return first_row(found.filter(F.col("citation").contains(digits[-1])) if digits else found, "id").select("id")


def resolve_statute(statutes: DataFrame, statute: str, act_number: str | None = None) -> DataFrame:
    """One row (id) at most: by act number (the least identifier), else by a title that is equal, else by one that contains the name; a title must be the only one."""
    key = norm_key_of(statute)
    rows = statutes.select("id", F.array(norm_key(F.col("short_title")), norm_key(F.col("official_title"))).alias("keys"), (F.col("act_number") == act_number if act_number else F.lit(False)).alias("by_number"))
    exact, within = F.array_contains("keys", key), F.exists("keys", lambda k: k.contains(key))
    ids = rows.agg(
        F.min(F.when(F.col("by_number"), F.col("id"))).alias("number"),
        F.count_if(exact).alias("n_exact"),
        F.min(F.when(exact, F.col("id"))).alias("exact"),
        F.count_if(within).alias("n_within"),
        F.min(F.when(within, F.col("id"))).alias("within"),
    )
    title = F.when(F.col("n_exact") > 0, F.when(F.col("n_exact") == 1, F.col("exact"))).when(F.col("n_within") == 1, F.col("within"))
    return ids.select(F.coalesce("number", title).alias("id")).filter("id is not null")


def _from(edges: DataFrame, side: str, kind: str, entity: DataFrame) -> DataFrame:
    """Edges whose citing or cited entity is the one row of ``entity``."""
    return edges.filter(F.col(f"{side}_kind") == kind).join(F.broadcast(entity.select(F.col("id").alias(f"{side}_id"))), f"{side}_id", "left_semi")


def _named(df: DataFrame, entities: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """``df`` with an entity's columns; null where it is missing."""
    return df.join(entities.select(F.col("id").alias(key), *(F.col(c).alias(n) for c, n in names.items())), key, "left")


def related_laws(edges: DataFrame, statutes: DataFrame, cases: DataFrame, case_citation: str, limit: int | None = None) -> DataFrame:
    """Statutes that a case cites, by reference."""
    out = _from(edges, "citing", "case", resolve_case(cases, case_citation)).filter("cited_kind = 'statute'").orderBy("cited_reference", "cited_id").limit(_limit("related_laws", limit))
    out = _named(out, statutes, "cited_id", {"short_title": "shortTitle", "official_title": "officialTitle", "domain": "domain", "act_number": "actNumber"})
    return out.select(F.col("cited_reference").alias("citedReference"), F.col("cited_id").alias("statuteId"), "shortTitle", "officialTitle", "domain", "actNumber").orderBy("citedReference", "statuteId")


def shared_targets(edges: DataFrame, probe: DataFrame) -> DataFrame:
    """(citing_id, shared): entities that cite what ``probe`` (id) cites, other than itself, with how many targets they share. The probe's own edges are few and go to all tasks if Spark finds them small."""
    own = edges.join(F.broadcast(probe.select(F.col("id").alias("citing_id"))), "citing_id", "left_semi").select("cited_kind", "cited_id", F.col("citing_id").alias("probe_id"))
    others = edges.join(own, ["cited_kind", "cited_id"]).filter("citing_id <> probe_id")
    return others.groupBy("citing_id").agg(F.count("*").alias("shared"))


def related_cases(edges: DataFrame, cases: DataFrame, case_citation: str, limit: int | None = None) -> DataFrame:
    """Cases that share cited statutes with a case, most shared first."""
    laws = edges.filter("citing_kind = 'case' AND cited_kind = 'statute'")
    top = shared_targets(laws, resolve_case(cases, case_citation)).orderBy(F.desc("shared"), "citing_id").limit(_limit("related_cases", limit))
    out = _named(top, cases, "citing_id", {"citation": "citation", "title": "title", "court": "court"})
    return out.orderBy(F.desc("shared"), "citing_id").select("citation", "title", "court", F.col("shared").alias("sharedStatutes"))


def cases_citing_statute(edges: DataFrame, statute_id: int) -> DataFrame:
    return edges.filter((F.col("citing_kind") == "case") & (F.col("cited_kind") == "statute") & (F.col("cited_id") == statute_id)).select("citing_id").distinct()


def show_amendments(amendments: DataFrame, statutes: DataFrame, statute: str, act_number: str | None = None, limit: int | None = None) -> DataFrame:
    """The amendment log of a statute by date; an empty one is no failure."""
    own = amendments.join(F.broadcast(resolve_statute(statutes, statute, act_number).select(F.col("id").alias("statute_id"))), "statute_id", "left_semi")
    return own.orderBy(F.col("effective_date").asc_nulls_first(), "id").limit(_limit("show_amendments", limit)).select(F.col("amending_law").alias("amendingLaw"), F.col("amending_law_id").alias("amendingLawId"), F.col("provision_no").alias("provisionNo"), F.col("effective_date").alias("effectiveDate"), "summary", "note")


def show_history(provisions: DataFrame, statutes: DataFrame, statute: str, provision: str, act_number: str | None = None) -> DataFrame:
    """All versions of a provision, oldest first; its number is compared as it is stored, but for case."""
    own = provisions.filter(same(F.col("provision_no"), provision)).join(F.broadcast(resolve_statute(statutes, statute, act_number).select(F.col("id").alias("statute_id"))), "statute_id", "left_semi")
    return own.orderBy(F.col("valid_from").asc_nulls_first(), "id").select(F.col("provision_no").alias("provisionNo"), "heading", "status", F.col("valid_from").alias("validFrom"), F.col("valid_until").alias("validUntil"), "body")


def show_dependencies(edges: DataFrame, statutes: DataFrame, statute: str, act_number: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(statutes that a statute cites, statutes that cite it), each up to the limit."""
    limit, entity = _limit("show_dependencies", limit), resolve_statute(statutes, statute, act_number)
    names = {"short_title": "shortTitle", "act_number": "actNumber", "domain": "domain"}
    laws = edges.filter("citing_kind = 'statute' AND cited_kind = 'statute'")
    forward = _named(_from(laws, "citing", "statute", entity).orderBy("cited_reference", "cited_id").limit(limit), statutes, "cited_id", names)
    back = _named(_from(laws, "cited", "statute", entity).select("citing_id").distinct().orderBy("citing_id").limit(limit), statutes, "citing_id", names)
    return forward.orderBy("cited_reference", "cited_id").select(F.col("cited_reference").alias("citedReference"), "shortTitle", "actNumber", "domain"), back.orderBy("citing_id").select("shortTitle", "actNumber")


def show_citations(edges: DataFrame, statutes: DataFrame, cases: DataFrame, case_citation: str, limit: int | None = None) -> DataFrame:
    """All that a case cites, statutes and cases, by reference."""
    own = _from(edges, "citing", "case", resolve_case(cases, case_citation)).orderBy("cited_reference", "cited_kind", "cited_id").limit(_limit("show_citations", limit))
    own = own.withColumns({"law_id": F.when(F.col("cited_kind") == "statute", F.col("cited_id")), "case_id": F.when(F.col("cited_kind") == "case", F.col("cited_id"))})
    out = _named(_named(own, statutes, "law_id", {"short_title": "law_title", "act_number": "actNumber"}), cases, "case_id", {"citation": "citation", "title": "case_title"})
    return out.orderBy("cited_reference", "cited_kind", "cited_id").select(F.col("cited_kind").alias("kind"), F.col("cited_reference").alias("citedReference"), F.coalesce("law_title", "case_title").alias("title"), "actNumber", "citation")


def show_implementing_rules(edges: DataFrame, statutes: DataFrame, cases: DataFrame, statute: str, act_number: str | None = None, limit: int | None = None) -> DataFrame:
    """References to a statute's implementing rules, with the case that makes each, if it is a case."""
    own = _from(edges, "cited", "statute", resolve_statute(statutes, statute, act_number)).filter(F.upper("cited_reference").contains("IRR"))
    own = own.orderBy("cited_reference", "citing_kind", "citing_id").limit(_limit("show_implementing_rules", limit)).withColumn("case_id", F.when(F.col("citing_kind") == "case", F.col("citing_id")))
    out = _named(own, cases, "case_id", {"citation": "citingCitation", "title": "citingTitle"})
    return out.orderBy("cited_reference", "citing_kind", "citing_id").select(F.col("cited_reference").alias("citedReference"), "citingCitation", "citingTitle")


def ordered_union(first: DataFrame, second: DataFrame, *order: Column | str) -> DataFrame:
    """All rows of the first, then all of the second, each in order; columns that one lacks are null there."""
    both = first.withColumn("ord", F.lit(0)).unionByName(second.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("ord", *order)


def show_cross_references(edges: DataFrame, statutes: DataFrame, registry: DataFrame, statute: str, act_number: str | None = None, limit: int | None = None) -> DataFrame:
    """What the registry says a statute's domain refers to, then the statutes that it cites; only those are limited."""
    entity = resolve_statute(statutes, statute, act_number)
    domain = statutes.join(F.broadcast(entity), "id", "left_semi").select(F.col("domain").alias("slug"))
    curated = registry.join(F.broadcast(domain), "slug", "left_semi").select(F.posexplode("crossRefs").alias("place", "ref")).select("place", F.col("ref.target").alias("targetSlug"), F.col("ref.reason").alias("reason"))
    curated = curated.join(registry.select(F.col("slug").alias("targetSlug"), "name"), "targetSlug", "left")
    curated = curated.select(F.lit("domain").alias("kind"), "place", "targetSlug", F.coalesce("name", "targetSlug").alias("targetName"), "reason")
    laws = show_dependencies(edges, statutes, statute, act_number, _limit("show_cross_references", limit))[0]
    return ordered_union(curated, laws.select(F.lit("statute").alias("kind"), "citedReference", "shortTitle", "actNumber"), F.col("place").asc_nulls_first(), F.col("citedReference").asc_nulls_first(), "shortTitle").drop("ord", "place")
