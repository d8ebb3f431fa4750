r"""Citations: extraction from text, resolution against a corpus, and the edge table that comes of them.

Patterns are in Java's dialect, read without regard to case: SPACE and EDGE stand
for ECMAScript's white space and ASCII word edge, and the end of text is ``\z``. Texts are searched by the same
patterns in Python's dialect, once for each kind, as Spark's functions give no places of matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.tables import written
from quern.functions.text import EDGE, SPACE, ascii_upper, norm_key

MAX_SPANS = 200

# The citation patterns.
_ACTS = rf"(?:Republic{SPACE}+Act|R\.?{SPACE}*A\.?|Presidential{SPACE}+Decree|P\.?{SPACE}*D\.?|Executive{SPACE}+Order|E\.?{SPACE}*O\.?|Batas{SPACE}+Pambansa|B\.?{SPACE}*P\.?|Commonwealth{SPACE}+Act|C\.?{SPACE}*A\.?"
PATTERNS = {
    "case": rf"{EDGE}G\.R\.{SPACE}*No\.{SPACE}*(L?-?[0-9]+){EDGE}",
    "constitution": rf"{EDGE}(?:Art(?:icle)?\.?){SPACE}*([IVXLCDM]+){SPACE}*,{SPACE}*(?:Sec(?:tion)?\.?){SPACE}*([0-9]+(?:{SPACE}*\([0-9]+\))?){SPACE}*(?:of{SPACE}+)?(?:the{SPACE}+)?1987{SPACE}+Constitution{EDGE}",
    "provision": rf"{EDGE}(?:Art(?:icle)?\.?|Sec(?:tion)?\.?){SPACE}*([0-9]+(?:-[A-Za-z0-9]+)?(?:\([A-Za-z0-9]+\))?){SPACE}*(?:,{SPACE}*|{SPACE}+of{SPACE}+)(?:the{SPACE}+)?([A-Z][A-Za-z0-9 ,.'-]{{2,80}}?)"
    rf"(?={SPACE}*(?:\.(?={SPACE}*(?:\z|[A-Z]))|\z|,{SPACE}*and{EDGE}|{SPACE}+and{SPACE}+(?:Art(?:icle)?|Sec(?:tion)?|G\.R\.|R\.?{SPACE}*A\.?|Republic|Presidential|Executive|Batas|Commonwealth|Act){EDGE}))",
    "irr": rf"{EDGE}(?:the{SPACE}+)?(?:Revised{SPACE}+)?(?:Implementing{SPACE}+Rules(?:{SPACE}+and{SPACE}+Regulations)?|IRR){SPACE}+of{SPACE}+(?:the{SPACE}+)?(?:RA|Republic{SPACE}+Act|R\.?{SPACE}*A\.?){SPACE}*(?:No\.?{SPACE}*)?([0-9]+){EDGE}",
    "act": EDGE + _ACTS + rf"|Act{SPACE}+No\.?){SPACE}*(?:No\.?{SPACE}*)?([0-9]+){EDGE}",
    "act_in_title": EDGE + _ACTS + rf"){SPACE}*(?:No\.?{SPACE}*)?([0-9]+){EDGE}",
}
CODE_TITLES = (
    "Civil Code",
    "Civil Code of the Philippines",
    "Revised Penal Code",
    "Family Code",
    "Labor Code",
    "National Internal Revenue Code",
    "Local Government Code",
    "Corporation Code",
    "Administrative Code",
    "Rules of Court",
)
#: Kinds in the order in which they are looked for; it breaks ties between references to one entity.
ORDER = ("case", "constitution", "provision", "irr", "act")

#: What a text has, in capitals, if it has a citation of a kind.
NEEDED = {"case": ("G.R.",), "constitution": ("1987",), "provision": ("ART", "SEC"), "irr": ("IRR", "IMPLEMENTING")}


def normalise_title(hint: Column) -> Column:
    """A title hint without ``the`` and closing punctuation; a known code's long name where the hint is its short one; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(hint), f"(?i)^the{SPACE}+", ""), "[.,;]+$", "")
    t = F.nullif(F.trim(t), F.lit(""))
    long = F.concat(t, F.lit(" of the Philippines"))
    return F.when(t.isin(*CODE_TITLES), t).when(long.isin(*CODE_TITLES), long).otherwise(t)


#: The patterns in Python's dialect. They begin with a letter and end with a letter or digit, so one side of an edge is known there.
_FORMS = {
    kind: re.compile(f"(?<![A-Za-z0-9_]){p.removeprefix(EDGE).removesuffix(EDGE)}" + "(?![A-Za-z0-9_])" * p.endswith(EDGE), re.IGNORECASE | re.ASCII)
    for kind, p in ((k, PATTERNS[k].replace(r"\z", r"\Z")) for k in ORDER)
}
_MATCH = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
_MATCH_TYPES = (pa.int32(), pa.string(), pa.string(), pa.string())
#: Bytes of a batch about which texts are searched at once.
_BATCH = 8 << 20


def _titled(hint: str) -> bool:
    """Whether ``normalise_title`` leaves anything of a hint."""
    return bool(re.sub("[.,;]+\\Z", "", _THE.sub("", hint.strip(" "))).strip(" "))


_THE = re.compile(f"\\Athe{SPACE}+", re.IGNORECASE | re.ASCII)


def _search(k: int, text: str, capitals: str, skip: int, size: int, seen: set[str], out: tuple[list, ...]) -> int:
    """Add to the columns of ``out`` the matches of a kind that start before ``size``, found behind ``skip``, but for raw texts already ``seen`` and
    provisions without a title; returns where the last match ends, at least ``skip``."""
    end, kind = skip, ORDER[k]
    needed = NEEDED.get(kind)
    if needed is None or any(w in capitals for w in needed):
        for m in _FORMS[kind].finditer(text, skip):
            if m.start() >= size:
                break
            end, raw = m.end(), m[0]
            if raw not in seen and (kind != "provision" or _titled(m[2])):
                seen.add(raw)
                for column, value in zip(out, (k, raw, m[1], m[2] if m.re.groups > 1 else None, m.start()), strict=False):  # the start only if asked for
                    column.append(value)
    return end


def listed_spans(df: DataFrame, texts_col: str = "texts") -> DataFrame:
    """A row for each distinct citation in each row's array of texts, as in those texts joined by line ends (nulls left out): the columns of ``df`` but the array,
    ``passage`` (where in the array the text stands in which it first starts), place, the columns of its span, and the priority of its kind. Only rows are read; no text is cut."""
    columns = [c for c in df.columns if c != texts_col]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("_matches", T.ArrayType(_MATCH)), T.StructField("_passages", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * _BATCH / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                out, offsets, passages = ([], [], [], [], []), [0], []
                for texts in batch.column(texts_col).to_pylist():
                    held = [(k, t) for k, t in enumerate(texts or ()) if t is not None]
                    text = "\n".join(t for _, t in held)
                    starts = [0, *accumulate(len(t) + 1 for _, t in held)]
                    capitals, seen = text.upper(), set()
                    for k in range(len(ORDER)):
                        _search(k, text, capitals, 0, len(text), seen, out)
                    passages += [held[bisect_right(starts, start) - 1][0] for start in out[4][offsets[-1] :]]
                    offsets.append(len(out[0]))
                matches = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out[:4], _MATCH_TYPES, strict=True)], _MATCH.fieldNames())
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (matches, pa.array(passages, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *lists], names=schema.names)

    found = df.select(*columns, texts_col).mapInArrow(run, schema)
    found = found.select(*columns, "_passages", F.posexplode("_matches").alias("place", "_match"))
    return found.select(*columns, F.get("_passages", F.col("place")).alias("passage"), "place", *_span(F.col("_match")))


def _matched(df: DataFrame, text_col: str, *, tailed: bool = False) -> DataFrame:
    """``df`` with ``_matches``, the distinct citations in each text: the first of each raw text, by kind and position. If it is ``tailed``, its column ``tail`` goes on from the
    text, but has no matches of its own; a number for each kind in ``skips`` says where the search begins, and the new column ``ends`` how far the last match
    of each kind, or what was skipped, reaches over the line end behind the text. One pass, in batches of bounded size."""
    schema = T.StructType([*df.schema.fields, T.StructField("_matches", T.ArrayType(_MATCH)), *([T.StructField("ends", T.ArrayType(T.IntegerType()))] if tailed else [])])
    kinds = range(len(ORDER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * _BATCH / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                texts = columns[text_col].to_pylist()
                tails, skips = (columns[c].to_pylist() for c in ("tail", "skips")) if tailed else ([""] * len(texts), [(0,) * len(ORDER)] * len(texts))
                out, offsets, ends = ([], [], [], []), [0], []
                for text, tail, skip in zip(texts, tails, skips, strict=True):
                    size, both = len(text or ""), (text or "") + tail
                    capitals, seen = both.upper(), set()
                    ends.append([max(0, _search(k, both, capitals, skip[k], size, seen, out) - size - 1) for k in kinds])
                    offsets.append(len(out[0]))
                matches = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, _MATCH_TYPES, strict=True)], _MATCH.fieldNames())
                more = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), matches), *([pa.array(ends, pa.list_(pa.int32()))] if tailed else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return df.mapInArrow(run, schema)


def _span(m: Column) -> list[Column]:
    """The columns of a match's span, and the priority of its kind."""
    of = lambda *kinds: m["k"].isin(*(ORDER.index(kind) for kind in kinds))
    a, title = m["a"], normalise_title(m["b"])
    case = F.concat(F.lit("G.R. No. "), F.when(ascii_upper(a).startswith("L-"), F.concat(F.lit("L-"), F.substring(a, 3, 1000))).otherwise(a))
    return [
        F.when(of("case"), "case").otherwise("statute").alias("kind"),
        m["raw"].alias("raw"),
        F.when(of("case"), case).alias("case_citation"),
        F.when(of("irr", "act"), a).when(of("provision"), F.nullif(F.regexp_extract(title, "(?i)" + PATTERNS["act_in_title"], 1), F.lit(""))).alias("act_number"),
        F.when(of("constitution"), "1987 Constitution").when(of("irr"), F.concat(F.lit("IRR of RA "), a)).when(of("provision"), title).alias("statute_title"),
        F.when(of("constitution"), F.concat_ws("-", a, m["b"])).when(of("provision"), ascii_upper(a)).alias("provision_no"),
        m["k"].alias("priority"),
    ]


def owned_spans(rows: DataFrame) -> DataFrame:
    """Rows with ``text``, ``tail`` and ``skips`` (a number for each kind) with ``spans``, the distinct citations that start in the text, for ``placed_spans``, and
    ``ends``: how far the last of each kind, or what was skipped, reaches over the line end behind the text."""
    return _matched(rows, "text", tailed=True).drop("skips", "text", "tail").withColumnRenamed("_matches", "spans")


def placed_spans(rows: DataFrame, columns: list[str], matches: str | Column = "spans") -> DataFrame:
    """A row for each of the ``matches`` of each row, with its ``place``, the columns of its span, and the priority of its kind."""
    return rows.select(*columns, F.posexplode(matches).alias("place", "_match")).select(*columns, "place", *_span(F.col("_match")))


def _spans(df: DataFrame, text_col: str, max_spans: int | None) -> DataFrame:
    """As ``extract_citations``, with the priority of each span's kind."""
    kept = "_matches" if max_spans is None else F.slice("_matches", 1, max_spans)
    return placed_spans(_matched(df, text_col), [c for c in df.columns if c != text_col], kept)


_SPAN = ("kind", "raw", "case_citation", "act_number", "statute_title", "provision_no")


def extract_citations(df: DataFrame, text_col: str = "text", *, max_spans: int | None = MAX_SPANS) -> DataFrame:
    """A row for each distinct citation of each row of ``df``: its columns but the text, and kind, raw, case_citation, act_number, statute_title, provision_no, place.

    Cases come first, then the constitution, provisions, implementing rules and
    bare acts; a raw text counts once, and ``max_spans`` of a row are kept (None:
    all).
    """
    return _spans(df, text_col, max_spans).drop("priority")


#: Length of the runs of characters by which titles that contain a hint are found.
GRAM = 6


def _by_shuffle(df: DataFrame) -> DataFrame:
    """The side of a join that is never sent whole to all: Spark judges by a small file's bytes what may be a large table of keys."""
    return df.hint("merge")


def _grams(key: Column, length: Column | int) -> Column:
    """Distinct runs of ``length`` characters of a key; none if it is shorter."""
    last = F.length(key) - length + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(key, k, length)))).otherwise(F.array().cast("array<string>"))


def titles_with(hints: DataFrame, keys: DataFrame) -> DataFrame:
    """For each ``title_key`` of ``hints`` that some key of ``keys`` (id, key) contains: of how many identifiers, and the least.

    A hint of up to GRAM characters is one of the keys' runs of that length, which
    are counted beforehand. A longer one meets the keys that share its rarest run
    of GRAM characters, and is then looked for in them; a run that all its keys
    share is in more titles than the hint only if no rarer run tells them apart. Titles are cut into runs only for hints that ask for them; ``hints`` is read several times.
    """
    shorter, longer = hints.agg(F.count_if(F.length("title_key") <= GRAM), F.count_if(F.length("title_key") > GRAM)).first()
    counts = [F.countDistinct("id").alias("n"), F.min("id").alias("title_id")]
    short = hints.filter(F.length("title_key") <= GRAM)
    runs = keys.select("id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: _grams(F.col("key"), n)))).alias("title_key"))
    short = short.join(_by_shuffle(runs.groupBy("title_key").agg(*counts)), "title_key")
    own = keys.select("id", "key", F.explode(_grams(F.col("key"), GRAM)).alias("gram"))
    asked = hints.filter(F.length("title_key") > GRAM).select("title_key", F.explode(_grams(F.col("title_key"), GRAM)).alias("gram"))
    frequency = own.groupBy("gram").agg(F.count("*").alias("frequency"))
    # a hint with a run that no title has is in none; the inner join drops the run, and the search below the hint
    rarest = asked.join(_by_shuffle(frequency), "gram").groupBy("title_key").agg(F.min_by("gram", F.struct("frequency", "gram")).alias("gram"))
    long = rarest.join(_by_shuffle(own), "gram").filter(F.contains("key", F.col("title_key"))).groupBy("title_key").agg(*counts)
    asked_for = [found.select("title_key", "n", "title_id") for found, n in ((short, shorter), (long, longer)) if n]
    return reduce(DataFrame.union, asked_for) if asked_for else short.select("title_key", "n", "title_id").filter(F.lit(False))


def resolve_spans(spans: DataFrame, statutes: DataFrame, cases: DataFrame, *, use_titles: bool = True) -> DataFrame:
    """Spans with ``statute_id`` and ``case_id`` of what they cite, null where that is unknown or ambiguous.

    ``spans`` needs a unique ``span_id``, and is read several times. Acts resolve
    by number (the least identifier), else by title: an exact key, else one that
    contains the hint's; only a single statute counts. Titles are looked for once
    for each distinct hint, cases once for each distinct citation. Spans without a
    key are spread by their identifiers, so that no task gets them all.
    """

    def look_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
        spread = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col("span_id")))  # no key starts so
        return rows.withColumn("_key", spread).join(_by_shuffle(found.withColumnRenamed(key, "_key")), "_key", "left").drop("_key")

    by_number = statutes.filter("act_number is not null").groupBy("act_number").agg(F.min("id").alias("number_id"))
    keyed = look_up(spans, "act_number", by_number)
    hints = None
    if use_titles:
        keyed = keyed.withColumn("title_key", F.when(F.col("number_id").isNull() & (F.col("kind") == "statute"), F.nullif(norm_key(F.col("statute_title")), F.lit(""))))
        keys = statutes.select("id", F.explode(F.array("short_title", "official_title")).alias("title"))
        keys = keys.select("id", norm_key(F.col("title")).alias("key")).filter("key <> ''").distinct()
        hints = written(keyed.select("title_key").filter("title_key is not null").distinct(), release=True)
    if hints is not None and not hints.isEmpty():
        exact = hints.join(_by_shuffle(keys.withColumnRenamed("key", "title_key")), "title_key").groupBy("title_key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("title_id"))
        within = titles_with(written(hints.join(_by_shuffle(exact), "title_key", "left_anti"), release=True), keys)
        keyed = look_up(keyed, "title_key", exact.union(within).filter("n = 1").drop("n")).drop("title_key")
    else:
        keyed = keyed.drop("title_key").withColumn("title_id", F.lit(None).cast("long"))
    tail = F.regexp_extract("case_citation", r"([0-9]+)\D*\z", 1)
    cited = spans.select("case_citation", norm_key(F.col("case_citation")).alias("case_key"), tail.alias("tail")).filter("case_citation is not null").distinct()
    known = cases.select(norm_key(F.col("citation")).alias("case_key"), F.col("id").alias("found_case"), F.col("citation").alias("found_citation"))
    best = cited.join(_by_shuffle(known), "case_key").filter(F.contains("found_citation", F.col("tail"))).groupBy("case_citation").agg(F.min("found_case").alias("case_id"))
    keyed = look_up(keyed, "case_citation", best)
    return keyed.withColumn("statute_id", F.when(F.col("kind") == "statute", F.coalesce("number_id", "title_id"))).drop("number_id", "title_id")


#: What a span is resolved by.
_REFERENCE = ("kind", "act_number", "statute_title", "case_citation")


def _cited(spans: DataFrame, statutes: DataFrame, cases: DataFrame) -> DataFrame:
    """Spans with ``cited_id``. Each distinct reference is resolved once; then all spans meet what was found in one join."""
    references = spans.select(*_REFERENCE).distinct().withColumn("span_id", F.to_json(F.struct(*_REFERENCE)))
    found = resolve_spans(written(references, release=True), statutes, cases)
    found = found.select(*_REFERENCE, F.when(F.col("kind") == "case", F.col("case_id")).otherwise(F.col("statute_id")).alias("cited_id")).filter("cited_id IS NOT NULL")
    whole = F.concat_ws("\u0001", *(F.coalesce(c, F.lit("\u0002")) for c in _REFERENCE)).alias("_reference")  # no reference has these
    found = written(found.select(whole, "cited_id"), release=True)
    rest = [c for c in spans.columns if c not in _REFERENCE]
    return spans.select(*rest, whole).join(_by_shuffle(found), "_reference", "left").select(*rest, F.substring_index("_reference", "\u0001", 1).alias("kind"), "cited_id")


@dataclass(frozen=True)
class Graph:
    """Edges between entities, and how many spans led to them."""

    edges: DataFrame
    counters: DataFrame


EDGE_COLUMNS = ("citing_kind", "citing_id", "cited_kind", "cited_id", "cited_reference")


def first_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each (citing, cited) pair: the first by ``order``, which should be total."""
    pair = Window.partitionBy("citing_kind", "citing_id", "cited_kind", "cited_id").orderBy(*order)
    return edges.withColumn("_place", F.row_number().over(pair)).filter("_place = 1").select(*EDGE_COLUMNS)


def build_graph(sources: DataFrame, statutes: DataFrame, cases: DataFrame, *, max_spans: int | None = None, over_borders: bool = True) -> Graph:
    """Edges from texts ``sources`` (citing_kind, citing_id, text): entities that cite themselves give none, and only the first reference to an entity is kept.
    All citations of an entity count, unless a caller bounds them by ``max_spans``.

    With a column ``passage`` an entity's text comes in several rows, in order of
    it: spans are those of the rows' text joined by line ends (see ``borders``).
    Where no citation runs over a row's end, ``over_borders`` may be false: rows are then searched alone.
    With a column ``texts`` in place of ``text`` an entity's one row holds all its passages in order, and they are searched as one text (see ``listed_spans``).
    """
    if "texts" in sources.columns:
        order = ("place",)
        spans = listed_spans(sources)
        spans = spans if max_spans is None else spans.filter(F.col("place") < max_spans)
    elif "passage" in sources.columns:
        from .borders import border_spans

        entity, order = ("citing_kind", "citing_id"), ("priority", "passage", "place")
        spans = border_spans(sources) if over_borders else _spans(sources, "text", None)
        if max_spans is not None:  # ranks up to a bound are cut in tasks before anything is shuffled
            least = F.min(F.struct(*order, *(c for c in _SPAN if c != "raw"))).alias("span")  # aggregated in tasks first: a raw text may be in every passage
            spans = spans.groupBy(*entity, "raw").agg(least).select(*entity, "raw", "span.*")
            spans = spans.withColumn("_rank", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).filter(F.col("_rank") <= max_spans).drop("_rank")
    else:
        order = ("place",)
        spans = extract_citations(sources, "text", max_spans=max_spans)
    spans = written(spans.select("citing_kind", "citing_id", "raw", *order, *_REFERENCE), release=True)  # texts are read once
    found = written(_cited(spans, statutes, cases), release=True)  # edges and counters both read it
    found = found.withColumns({"cited_kind": F.col("kind"), "cited_reference": F.col("raw")})
    good = F.col("cited_id").isNotNull() & ~((F.col("citing_kind") == F.col("cited_kind")) & (F.col("citing_id") == F.col("cited_id")))
    edges = first_edges(found.filter(good), [F.col(c) for c in order])
    counted = found.select("citing_kind", "citing_id", "raw", good.alias("good"))
    counted = counted.distinct() if "passage" in order and max_spans is None else counted  # a raw text counts once for its entity
    good = F.col("good")
    counters = counted.agg(F.count("*").alias("spans"), F.count_if(good).alias("resolved"), F.count_if(~good | good.isNull()).alias("unresolved"))
    return Graph(edges, counters.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges_inserted")))))  # one row each


def missing_edges(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges that a second run would add: none, if nothing changed."""
    return fresh.join(existing, ["citing_kind", "citing_id", "cited_kind", "cited_id"], "left_anti")
