"""Conjunctive BM25 search with a confidence gate, snippets and pages.

Statistics are always of the whole corpus: filters come after them. A query is
answered either from texts, in two narrow passes (one row of statistics goes
back to all tasks), or from a stored index, of which only the
query's terms are read.

In the index each posting has its gain, the part of its score that doesn't depend on
how rare its term is, and a tier by which the gains of a term are ranked in TIERS steps.
Postings are sorted by term and tier, and a small table has each (term, tier)'s number and largest gain.
``top_by_index`` reads the highest tiers first, learns from them a score that k passages reach,
and then only the tiers from which a passage could still reach it. ``answer_requests`` answers a table
of requests in one pass: each request starts from its rarest term's postings, so its frequent terms
are looked up by passage and never multiplied by requests.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import log
from operator import and_, or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.tables import written
from quern.functions.text import fold, fold_term, query_terms, term_count, terms_of, token_count, tokens

# BM25, page sizes, confidence and snippet.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
DEFAULT_LIMIT, MAX_LIMIT, QUERY_CHARS = 10, 50, 300
THRESHOLD, HIGH, MEDIUM = 0.4, 0.7, 0.4
SNIPPET_BEFORE, SNIPPET_AFTER, ELLIPSIS = 80, 160, "…"
#: Steps of a term's gains in the index, and postings of each term that the first look reads about.
TIERS, PROBE_ROWS = 64, 4096
#: Texts whose words are counted at once.
_ROWS = 256
#: Sums of gains are rounded to so many digits, as Spark adds them in any order and equal passages must tie.
DIGITS = 12


@dataclass(frozen=True)
class Corpus:
    """A table of passages: its identifier, its indexed text columns, and which of them are body and heading."""

    passages: DataFrame
    id_col: str
    indexed: tuple[str, ...]
    body: str
    heading: str | None = None


@dataclass(frozen=True)
class Page:
    """Rows of one page, and a one-row table of its numbers."""

    rows: DataFrame
    meta: DataFrame
    terms: list[str] = field(default_factory=list)


def _idf(n_docs: Column, n_having: Column) -> Column:
    idf = F.log((n_docs - n_having + 0.5) / (n_having + 0.5))
    return F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)


def _gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def check_page(query: str, limit: int | None, offset: int | None) -> tuple[int, int]:
    if not 1 <= len(query) <= QUERY_CHARS:
        raise ValueError(f"a query has 1 to {QUERY_CHARS} characters")
    return min(limit or DEFAULT_LIMIT, MAX_LIMIT), max(0, offset or 0)


def scored(corpus: Corpus, query: str) -> DataFrame:
    """All passages that have every term, with ``bm25`` (higher is better). Empty if the query has no terms."""
    wanted = Counter(fold_term(t) for t in query_terms(query))
    p = corpus.passages
    if not wanted:
        return p.filter(F.lit(False)).withColumn("bm25", F.lit(0.0))
    names = [f"_tf{i}" for i in range(len(wanted))]
    folded = [f"_text{k}" for k in range(len(corpus.indexed))]
    counted = p.withColumns({f: fold(F.coalesce(p[c], F.lit(""))) for f, c in zip(folded, corpus.indexed, strict=True)})
    over = lambda count: sum((count(F.col(f)) for f in folded[1:]), count(F.col(folded[0])))
    counted = counted.withColumns({"_length": over(token_count), **{n: over(lambda c, t=t: term_count(c, t)) for n, t in zip(names, wanted, strict=True)}}).drop(*folded)
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(n) > 0).alias(f"_df{n}") for n in names))
    matched = counted.filter(" AND ".join(f"{n} > 0" for n in names)).crossJoin(F.broadcast(stats))  # one row
    score = sum((k * _idf(F.col("_n"), F.col(f"_df{n}")) * _gain(F.col(n), F.col("_length"), F.col("_mean")) for n, k in zip(names, wanted.values(), strict=True)), F.lit(0.0))
    return matched.withColumn("bm25", score).drop("_length", "_n", "_mean", *names, *(f"_df{n}" for n in names))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to (id, term, length, tf), counted within each row, a few rows at a time."""
    for batch in batches:
        for part in (batch.slice(k, _ROWS) for k in range(0, batch.num_rows, _ROWS)):
            words = part.column("words")
            flat = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
            found = flat.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            row, length = found["row"], pc.list_value_length(words).cast(pa.int32())
            out = pa.table({"id": part.column("id").take(row), "term": found["term"], "length": length.take(row), "tf": found["count_all"]})
            yield from out.combine_chunks().to_batches()


def postings(corpus: Corpus) -> DataFrame:
    """(id, term, tf, length) of every passage's terms. Passages are counted where they lie; only if identifiers repeat, their postings of equal length are added up by a shuffle."""
    p = corpus.passages
    words = F.flatten(F.array(*(tokens(p[c]) for c in corpus.indexed)))
    rows = p.select(p[corpus.id_col].alias("id"), words.alias("words"))
    schema = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("tf", T.LongType())])
    counts = rows.mapInArrow(_term_counts, schema)
    if p.groupBy(p[corpus.id_col]).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return counts
    return counts.groupBy("id", "term", "length").agg(F.sum("tf").alias("tf"))


def corpus_stats(corpus: Corpus) -> DataFrame:
    """One row: n_docs and mean_length, passages without tokens included."""
    words = sum((token_count(fold(F.coalesce(corpus.passages[c], F.lit("")))) for c in corpus.indexed), F.lit(0))
    return corpus.passages.agg(F.count("*").alias("n_docs"), F.avg(words).alias("mean_length"))


@dataclass(frozen=True)
class Index:
    """A stored index: postings (term, tier, id, tf, length, gain), tiers (term, tier, n, gain), stats (n_docs, mean_length)."""

    postings: DataFrame
    tiers: DataFrame
    stats: DataFrame


def write_index(corpus: Corpus, path: str, partitions: int | None = None) -> Index:
    """Postings sorted by term and tier, so that a query reads only the row groups that it needs, with the tiers and the statistics beside them."""
    spark = corpus.passages.sparkSession
    counted = written(postings(corpus))  # texts are read and split once, and the ranges' sample reads this
    total = counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    stats = corpus.passages.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(total))  # one row each
    stats = stats.select("n_docs", (F.col("n_tokens") / F.nullif("n_docs", F.lit(0))).alias("mean_length"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").select("mean_length")
    rows = counted.crossJoin(F.broadcast(mean))  # one row
    rows = rows.select("term", "id", "tf", "length", _gain(F.col("tf"), F.col("length"), F.col("mean_length")).alias("gain"))
    rows = rows.withColumn("tier", F.least(F.lit(TIERS - 1), F.floor(F.col("gain") * TIERS / (K1 + 1))).cast("int"))
    by = ["term", "tier", "id"]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/postings")
    tiers = spark.read.parquet(f"{path}/postings").groupBy("term", "tier").agg(F.count("*").alias("n"), F.max("gain").alias("gain"))
    tiers.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/tiers")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "tiers", "stats")))


def _tiers_from(cuts: dict[str, int]) -> Column:
    """Postings of each term from a tier on, in a form that Parquet row groups can be pruned by."""
    return reduce(or_, ((F.col("term") == t) & (F.col("tier") >= cut) for t, cut in cuts.items()))


def _scores_from(index: Index, weights: dict[str, float], cuts: dict[str, int], allowed: DataFrame | None) -> DataFrame:
    """(id, bm25) of the passages that have every term in a tier from its cut on."""
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("term")]
    rows = index.postings.filter(_tiers_from(cuts)).groupBy("id").agg(F.round(F.sum(weight * F.col("gain")), DIGITS).alias("bm25"), F.count("*").alias("_found"))
    rows = rows.filter(F.col("_found") == len(cuts)).drop("_found")
    return rows if allowed is None else rows.join(allowed, "id", "left_semi")


def needed_tiers(index: Index, query: str, k: int, allowed: DataFrame | None = None) -> tuple[dict[str, float], dict[str, int]] | None:
    """Each term's weight, and the tier from which on its postings decide the best ``k`` passages; None if no passage can have all terms.

    The driver sees at most TIERS rows for each query term, and one score each time.
    """
    wanted = Counter(fold_term(t) for t in query_terms(query))
    tiers: dict[str, dict[int, tuple[int, float]]] = {t: {} for t in wanted}
    for r in index.tiers.filter(F.col("term").isin(*wanted)).collect() if wanted else []:
        tiers[r["term"]][r["tier"]] = (r["n"], r["gain"])
    if not wanted or not all(tiers.values()):
        return None
    n_docs = index.stats.first()["n_docs"]
    weights = {}
    for t, times in wanted.items():
        having = sum(n for n, _ in tiers[t].values())
        idf = log((n_docs - having + 0.5) / (having + 0.5))
        weights[t] = times * (idf if idf > 0 else IDF_FLOOR)
    lowest, size = {t: min(tiers[t]) for t in wanted}, PROBE_ROWS
    while True:
        cuts = {}
        for t in wanted:  # the highest tiers of about ``size`` postings
            seen = 0
            for tier in sorted(tiers[t], reverse=True):
                if seen and seen + tiers[t][tier][0] > size:
                    break
                seen, cuts[t] = seen + tiers[t][tier][0], tier
        if cuts == lowest:
            return weights, lowest
        floor = _scores_from(index, weights, cuts, allowed).orderBy(F.desc("bm25")).offset(k - 1).limit(1).agg(F.max("bm25")).first()[0]
        if floor is not None:
            break
        size *= 8
    # with any term in a lower tier, a passage scores less than k passages do, even if its other terms gain the most
    best = {t: weights[t] * max(g for _, g in tiers[t].values()) for t in wanted}
    most, floor = sum(best.values()), floor * (1 - 1e-9)
    return weights, {t: min(tier for tier, (_, g) in tiers[t].items() if weights[t] * g + most - best[t] >= floor) for t in wanted}


def top_by_index(index: Index, query: str, limit: int | None = None, offset: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, bm25) of one page, best first: the same as scoring all passages. ``allowed`` (id) are the passages that a filter leaves."""
    limit, offset = check_page(query, limit, offset)
    needed = needed_tiers(index, query, limit + offset, allowed)
    if needed is None:
        return index.postings.select("id", F.lit(0.0).alias("bm25")).filter(F.lit(False))
    return _scores_from(index, *needed, allowed).orderBy(F.desc("bm25"), "id").offset(offset).limit(limit)


def search_stored(corpus: Corpus, index: Index, query: str, *, filters: dict[str, str] | None = None, limit: int | None = None, offset: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``search`` from a stored index: texts are read only for the hits of the page."""
    held = {c: v for c, v in (filters or {}).items() if v is not None}
    p = corpus.passages
    allowed = p.filter(reduce(and_, (F.col(c) == v for c, v in held.items()))).select(F.col(corpus.id_col).alias("id")) if held else None
    hits = top_by_index(index, query, limit, offset, allowed)
    page = p.join(F.broadcast(hits.withColumnRenamed("id", corpus.id_col)), corpus.id_col)  # one page
    body, heading = F.col(corpus.body), F.col(corpus.heading) if corpus.heading else None
    page = page.withColumn("confidence", confidence(F.col("bm25"), body, heading, query)).filter(F.col("confidence") >= threshold)
    return page.withColumns({"confidence_level": level(F.col("confidence")), "snippet": snippet(body, query)}).orderBy(F.desc("bm25"), corpus.id_col)


def answer_requests(index: Index, requests: DataFrame, passages: DataFrame | None = None, filters: dict[str, str] | None = None, id_col: str = "id", *, digits: int = DIGITS) -> DataFrame:
    """(request_id, id, bm25, rank): the best passages of each of ``requests`` (request_id, query, limit), best first; scores equal in so many ``digits`` tie, and go by identifier.

    ``filters`` maps columns of ``requests`` to columns of ``passages``; where a request's value is null it doesn't filter. Requests
    without an identifier or without terms, or with a term that no passage has, have no rows. Requests of equal identifiers are answered as one of the longest query.
    """
    filters = filters or {}
    asked = requests.select("request_id", F.col("query"), F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"), *filters).groupBy("request_id").agg(F.max_by(F.struct("query", "limit", *filters), F.struct(F.length("query"), "query", "limit")).alias("r")).select("request_id", "r.*")
    asked = written(asked)
    terms = asked.select("request_id", F.explode(terms_of(F.col("query"))).alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("times"))
    having = index.tiers.groupBy("term").agg(F.sum("n").alias("df"))
    idf = _idf(F.col("n_docs"), F.col("df"))
    rated = terms.join(having, "term", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))  # one row
    rated = rated.withColumn("weight", F.col("times") * idf)
    plans = rated.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "weight"))).alias("terms"), F.count_if(F.col("df").isNull()).alias("unknown"))  # a query is short
    plans = written(plans.filter("unknown = 0").drop("unknown"))
    lists = index.postings.select("term", "id", "gain")
    rarest = F.col("terms")[0]
    found = plans.select("request_id", rarest["term"].alias("term"), rarest["weight"].alias("weight"), F.slice("terms", 2, QUERY_CHARS).alias("others")).join(lists, "term").withColumn("bm25", F.col("weight") * F.col("gain")).drop("term", "weight", "gain")
    alone = found.filter(F.size("others") == 0).select("request_id", "id", "bm25")
    further = found.filter(F.size("others") > 0).withColumn("other", F.explode("others"))
    further = further.select("request_id", "id", "bm25", F.size("others").alias("need"), F.col("other.term").alias("term"), F.col("other.weight").alias("weight")).join(lists, ["term", "id"])
    met = further.groupBy("request_id", "id").agg(F.first("bm25").alias("first"), F.sum(F.col("weight") * F.col("gain")).alias("rest"), F.count("*").alias("met"), F.first("need").alias("need"))
    scores = alone.union(met.filter("met = need").select("request_id", "id", F.col("first") + F.col("rest")))
    scores = scores.join(asked.drop("query"), "request_id").withColumn("bm25", F.round("bm25", DIGITS))
    if filters:
        own = passages.select(passages[id_col].alias("id"), *(F.col(c).alias(f"_own_{c}") for c in filters.values()))
        fits = reduce(and_, (F.col(r).isNull() | (F.col(r) == F.col(f"_own_{c}")) for r, c in filters.items()))
        scores = scores.join(own, "id").filter(fits)
    best = Window.partitionBy("request_id").orderBy(F.desc(F.round("bm25", digits)), "id")
    return scores.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= MAX_LIMIT) & (F.col("rank") <= F.col("limit"))).select("request_id", "id", "bm25", "rank")


def scored_by_postings(rows: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(id, bm25) of passages with every term, from postings."""
    wanted = Counter(fold_term(t) for t in query_terms(query))
    own = rows.filter(F.col("term").isin(*wanted)) if wanted else rows.filter(F.lit(False))
    times = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)) if wanted else F.lit(None).cast("map<string,int>")
    having = F.broadcast(own.groupBy("term").agg(F.count("*").alias("df")))  # a row for each query term
    parts = own.join(having, "term").crossJoin(F.broadcast(stats))  # one row
    gain = times[F.col("term")] * _idf(F.col("n_docs"), F.col("df")) * _gain(F.col("tf"), F.col("length"), F.col("mean_length"))
    return parts.groupBy("id").agg(F.sum(gain).alias("bm25"), F.count("*").alias("found")).filter(F.col("found") == len(wanted)).drop("found")


def confidence(bm25: Column, body: Column, heading: Column | None, query: str) -> Column:
    """Saturated score, share of terms that the body contains, whole query in body, and in heading: 0 to 1."""
    terms, low = query_terms(query), F.lower(body)
    coverage = sum((low.contains(t).cast("int") for t in terms), F.lit(0)) / F.lit(float(max(1, len(terms))))
    b = F.greatest(F.lit(0.0), bm25)
    score = 0.5 * (b / (b + 5)) + 0.3 * coverage + 0.2 * low.contains(query.lower()).cast("int")
    if heading is not None:
        score = score + 0.05 * F.coalesce(F.lower(heading).contains(query.lower()), F.lit(False)).cast("int")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def reasons(body: Column, heading: Column | None, query: str) -> Column:
    """Why a hit is trusted, in words."""
    terms, low = query_terms(query), F.lower(body)
    phrase = low.contains(query.lower())
    near = F.coalesce(F.lower(heading).contains(query.lower()), F.lit(False)) if heading is not None else F.lit(False)
    full = F.lit(bool(terms))
    for t in terms:
        full = full & low.contains(t)
    said = F.array(F.when(phrase, "exact phrase present"), F.when(near, "heading match"), F.when(full, "full term coverage"))
    return F.filter(said, lambda x: x.isNotNull())


def snippet(body: Column, query: str) -> Column:
    """The text around the first query term, with marks where it is cut."""
    terms = query_terms(query)
    at = F.greatest(F.instr(F.lower(body), terms[0]) - 1, F.lit(0)) if terms else F.lit(0)
    start, end = F.greatest(F.lit(0), at - SNIPPET_BEFORE), F.least(F.length(body), at + SNIPPET_AFTER)
    return F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), F.substring(body, start + 1, end - start), F.when(end < F.length(body), ELLIPSIS).otherwise(""))


def search(corpus: Corpus, query: str, *, filters: dict[str, str] | None = None, limit: int | None = None, offset: int | None = None, threshold: float = THRESHOLD) -> Page:
    """One page of hits, best first, and its numbers. The gate comes after the page is cut, so a page may be short while ``total`` counts all matches."""
    limit, offset = check_page(query, limit, offset)
    matched = scored(corpus, query)
    for column, value in (filters or {}).items():
        if value is not None:
            matched = matched.filter(F.col(column) == value)
    page = matched.orderBy(F.desc("bm25"), corpus.id_col).offset(offset).limit(limit)
    body, heading = F.col(corpus.body), F.col(corpus.heading) if corpus.heading else None
    page = page.withColumn("confidence", confidence(F.col("bm25"), body, heading, query)).filter(F.col("confidence") >= threshold)
    rows = page.withColumns({"confidence_level": level(F.col("confidence")), "snippet": snippet(body, query)}).orderBy(F.desc("bm25"), corpus.id_col)
    counts = matched.agg(F.count("*").alias("total")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("count"))))  # one row each
    more = F.lit(offset) + F.col("count") < F.col("total")
    empty = F.col("count") == 0
    meta = counts.select(
        F.when(empty, "insufficient_corpus_coverage").otherwise("ok").alias("status"),
        F.lit(query).alias("query"),
        "count",
        "total",
        F.lit(offset).alias("offset"),
        (~empty & more).alias("has_more"),
        F.when(~empty & more, F.lit(offset) + F.col("count")).alias("next_offset"),
    )
    return Page(rows, meta, query_terms(query))


def _joined(passages: DataFrame, parents: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    return passages.join(parents.select(F.col("id").alias(key), *(F.col(c).alias(n) for c, n in names.items())), key)


def search_statute(provisions: DataFrame, statutes: DataFrame, query: str, *, domain: str | None = None, limit: int | None = None, offset: int | None = None, threshold: float = THRESHOLD) -> Page:
    """Hits in provisions: number, heading and body are searched; parents come by a join after scoring."""
    corpus = Corpus(_joined(provisions, statutes, "statute_id", {"short_title": "statute", "official_title": "officialTitle", "kind": "kind", "domain": "domain"}), "id", ("provision_no", "heading", "body"), "body", "heading")
    page = search(corpus, query, filters={"domain": domain}, limit=limit, offset=offset, threshold=threshold)
    cited = F.concat(F.col("statute"), F.lit(", "), F.col("provision_no"), F.when(F.col("heading").isNotNull(), F.concat(F.lit(" ("), F.col("heading"), F.lit(")"))).otherwise(""))
    rows = page.rows.select("statute", "officialTitle", "kind", "domain", cited.alias("citation"), F.col("provision_no").alias("provisionNo"), "status", "snippet", F.round("confidence", 3).alias("confidence"), F.col("confidence_level").alias("confidenceLevel"))
    return Page(rows, page.meta, page.terms)


def search_jurisprudence(passages: DataFrame, cases: DataFrame, query: str, *, court: str | None = None, limit: int | None = None, offset: int | None = None, threshold: float = THRESHOLD) -> Page:
    """Hits in case passages."""
    if court not in (None, "sc", "ca", "sb", "cta", "other"):
        raise ValueError(f"no court {court!r}")
    names = {"citation": "citation", "title": "title", "court": "court", "promulgation_date": "promulgationDate", "ponente": "ponente"}
    corpus = Corpus(_joined(passages, cases, "case_id", names), "id", ("heading", "body"), "body")
    page = search(corpus, query, filters={"court": court}, limit=limit, offset=offset, threshold=threshold)
    rows = page.rows.select(*names.values(), "snippet", F.round("confidence", 3).alias("confidence"), F.col("confidence_level").alias("confidenceLevel"))
    return Page(rows, page.meta, page.terms)


def search_issuance(passages: DataFrame, issuances: DataFrame, query: str, *, agency: str | None = None, issuance_type: str | None = None, limit: int | None = None, offset: int | None = None, threshold: float = THRESHOLD) -> Page:
    """Hits in issuance passages."""
    names = {"agency": "agency", "issuance_type": "issuanceType", "reference_no": "referenceNo", "title": "title", "issue_date": "issueDate"}
    corpus = Corpus(_joined(passages, issuances, "issuance_id", names), "id", ("heading", "body"), "body")
    page = search(corpus, query, filters={"agency": agency, "issuanceType": issuance_type}, limit=limit, offset=offset, threshold=threshold)
    rows = page.rows.select(*names.values(), "snippet", F.round("confidence", 3).alias("confidence"), F.col("confidence_level").alias("confidenceLevel"))
    return Page(rows, page.meta, page.terms)

