"""Sections, passages and headers of normalised texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import BLANK, EDGE, REST_OF_LINE, SPACE, ascii_upper, content_hash, first_iso_date, normalise_whitespace, trim_space
from quern.functions.text import SPACES as _WHITE

PASSAGE_CHARS, ISSUANCE_CHARS, TITLE_CHARS = 2000, 2500, 200

# What numbers a heading line, and the forms and agencies of issuances.
_NUMBERED = rf"(?:(?:ARTICLE|ART\.?){BLANK}+([IVXLCDM]+|[0-9]+)|(?:SECTION|SEC\.?){BLANK}+([0-9]+))\.?{BLANK}*"
TAX_FORMS = (
    ("Revenue Regulations", "RR", rf"(?i)^(?:REVENUE{SPACE}+)?REGULATIONS?{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+-[0-9]{{4}}){EDGE}"),
    ("Revenue Memorandum Circular", "RMC", rf"(?i)^REVENUE{SPACE}+MEMORANDUM{SPACE}+CIRCULAR{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+-[0-9]{{4}}){EDGE}"),
    ("Revenue Memorandum Order", "RMO", rf"(?i)^REVENUE{SPACE}+MEMORANDUM{SPACE}+ORDER{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+-[0-9]{{4}}){EDGE}"),
    ("Revenue Memorandum Ruling", "RMR", rf"(?i)^REVENUE{SPACE}+MEMORANDUM{SPACE}+RULING{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+-[0-9]{{4}}){EDGE}"),
)
AGENCY_FORMS = (
    ("Department Order", rf"(?i)^(?:DEPARTMENT{SPACE}+)?ORDER{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Memorandum Circular", rf"(?i)^MEMORANDUM{SPACE}+CIRCULAR{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Memorandum Order", rf"(?i)^MEMORANDUM{SPACE}+ORDER{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Circular", rf"(?i)^CIRCULAR{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Ordinance", rf"(?i)^ORDINANCE{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Resolution", rf"(?i)^RESOLUTION{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?){EDGE}"),
    ("Advisory", rf"(?i)^ADVISORY{SPACE}+(?:NO\.?{SPACE}*)?([0-9]+(?:-[0-9]{{2,4}})?)?{EDGE}"),
    ("Guidelines", rf"(?i)^GUIDELINES{SPACE}+(?:ON|FOR|IN|NO\.?{SPACE}*)?(){EDGE}"),
)
AGENCIES = (
    ("DOLE", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+LABOR|{EDGE}DOLE{EDGE}"),
    ("DTI", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+TRADE|{EDGE}DTI{EDGE}"),
    ("CSC", rf"(?i)CIVIL{SPACE}+SERVICE{SPACE}+COMMISSION|{EDGE}CSC{EDGE}"),
    ("DBM", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+BUDGET|{EDGE}DBM{EDGE}"),
    ("COA", rf"(?i)COMMISSION{SPACE}+ON{SPACE}+AUDIT|{EDGE}COA{EDGE}"),
    ("DENR", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+ENVIRONMENT|{EDGE}DENR{EDGE}"),
    ("DOF", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+FINANCE|{EDGE}DOF{EDGE}"),
    ("SEC", rf"(?i)SECURITIES{SPACE}+AND{SPACE}+EXCHANGE|{EDGE}SEC{EDGE}"),
    ("GSIS", rf"(?i)GOVERNMENT{SPACE}+SERVICE{SPACE}+INSURANCE|{EDGE}GSIS{EDGE}"),
    ("SSS", rf"(?i)SOCIAL{SPACE}+SECURITY{SPACE}+SYSTEM|{EDGE}SSS{EDGE}"),
    ("PhilHealth", r"(?i)PHILHEALTH"),
    ("Pag-IBIG", rf"(?i)PAG(?:-|{SPACE})?IBIG"),
    ("BSP", rf"(?i)BANGKO{SPACE}+SENTRAL|{EDGE}BSP{EDGE}"),
    ("DOJ", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+JUSTICE|{EDGE}DOJ{EDGE}"),
    ("DICT", rf"(?i)DEPARTMENT{SPACE}+OF{SPACE}+INFORMATION|{EDGE}DICT{EDGE}"),
)
TAX_AGENCY, OTHER_AGENCY, OTHER_FORM, UNKNOWN = "BIR", "National Government Agency", "Other Issuance", "UNKNOWN"


def segment_provisions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each section of each text: the other columns, and place, number, heading, body.

    A text is split once, before each heading line, and each section is read once,
    so the work follows the text's length and nothing is shuffled. Lines are
    trimmed; those before the first heading are dropped; a heading's own text is
    also the first line of its body; sections with neither heading nor body are
    dropped.
    """
    text = F.concat(F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, rf"(?<!{BLANK}){BLANK}++(?=\n|\z)", ""), rf"(?<=\n){BLANK}+", "")
    # no line starts with a tab now, so one marks headings; split() compiles its pattern anew for each row, so it gets a plain one
    marked = F.regexp_replace(text, rf"(?i)\n(?={_NUMBERED}{REST_OF_LINE}(?:\n|\z))", "\n\t")
    # the first holds what comes before any heading
    sections = F.filter(F.split(marked, "\n\t"), lambda s, k: (k > 0) & ~s.rlike(rf"(?i)^{_NUMBERED}{SPACE}*\z"))
    others = [c for c in df.columns if c != text_col]
    number = ascii_upper(F.concat(*(F.regexp_extract("_section", rf"(?i)^{_NUMBERED}", k) for k in (1, 2))))
    heading = F.regexp_extract("_section", rf"(?i)^{_NUMBERED}({REST_OF_LINE})", 3)
    body = F.regexp_replace("_section", rf"(?i)\A{_NUMBERED}", "")
    rows = df.select(*others, F.posexplode(sections).alias("place", "_section"))
    return rows.select(*others, "place", number.alias("number"), trim_space(heading).alias("heading"), trim_space(body).alias("body"))


def normalise_statute(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with normalised text and content_hash, their sections, each with its text's content_hash)."""
    clean = df.withColumn(text_col, normalise_whitespace(F.col(text_col))).withColumn("content_hash", content_hash(F.col(text_col)))
    return clean, segment_provisions(clean, text_col)


def repeated_numbers(sections: DataFrame, *keys: str) -> DataFrame:
    """Section numbers that a text has more than once, which a unique key would refuse."""
    return sections.groupBy(*keys, "number").agg(F.count("*").alias("n")).filter("n > 1")


@lru_cache(16)
def _cutter(most: int) -> re.Pattern[str]:
    """The longest start of a long paragraph that ends after a sentence, at a blank, or anywhere; the first two only beyond 60 % of ``most``."""
    reach = f"{{{int(0.6 * most) + 1},{most}}}"
    return re.compile(rf"(?s).{reach}\.(?= )|.{reach}(?= )|.{{{most}}}")


def _pieces(text: str, most: int) -> Iterator[tuple[str, bool, int]]:
    """Paragraphs, long ones cut: (piece, whether it starts a passage in any case, how much room it leaves if it does)."""
    for paragraph in (p for p in text.split("\n\n") if p.strip(_WHITE)):
        rest, whole = paragraph, len(paragraph) <= most
        while len(rest) > most:
            piece = _cutter(most).match(rest)[0]
            yield piece.strip(_WHITE), True, 0
            rest = rest[len(piece) :].strip(_WHITE)
        if rest:
            yield rest, not whole, most - len(rest) - (2 if whole else 0)


def pack(text: str, most: int) -> list[str]:
    """Passages of at most ``most`` characters (a sentence's end or line breaks may add a few): whole paragraphs while they fit, and cuts of longer ones."""
    passages: list[list[str]] = []
    room = 0
    for piece, fresh, left in _pieces(text, most):
        if fresh or len(piece) + 2 > room:
            passages.append([])
            room = left
        else:
            room -= len(piece) + 2
        passages[-1].append(piece)
    return ["\n\n".join(p) for p in passages]


_PASSAGES = T.ArrayType(T.StructType([T.StructField("passage_no", T.IntegerType()), T.StructField("body", T.StringType())]))


def passages(text: Column, most: int = PASSAGE_CHARS) -> Column:
    """Array of (passage_no, body). Packing depends on all before it, so it is a vectorised UDF; texts are independent."""

    @F.pandas_udf(_PASSAGES)
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"passage_no": k + 1, "body": b} for k, b in enumerate(pack(t or "", most))])

    return packed(normalise_whitespace(F.coalesce(text, F.lit(""))))


def chunk_into_passages(df: DataFrame, text_col: str = "text", *, max_chars: int = PASSAGE_CHARS) -> DataFrame:
    """A row for each passage: the other columns, passage_no and body."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.explode(passages(F.col(text_col), max_chars)).alias("p")).select(*others, "p.passage_no", "p.body")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_space), lambda x: x != "")


def _first_form(lines: Column, forms: list[tuple[str, str]]) -> Column:
    """Of the first line that any pattern fits: (form, number, line); null without one. Patterns are tried in order."""
    fit = lambda line: F.coalesce(*(F.when(line.rlike(p), F.struct(F.lit(name).alias("form"), F.regexp_extract(line, p, 1).alias("number"), line.alias("line"))) for name, p in forms))
    return F.try_element_at(F.filter(F.transform(lines, fit), lambda x: x.isNotNull()), F.lit(1))


def _title(lines: Column, matched: Column, cue: str) -> Column:
    pattern = rf"(?i)^(?:{cue}){SPACE}*:"
    subject = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    other = F.try_element_at(F.filter(lines, lambda x: ~x.eqNullSafe(matched)), F.lit(1))
    return F.coalesce(trim_space(F.regexp_replace(subject, pattern, "")), F.substring(other, 1, TITLE_CHARS))


def _issuance(df: DataFrame, text_col: str, head: int, forms: list[tuple[str, str]], reference: Column, cue: str, agency: Column) -> DataFrame:
    rows = df.withColumn("_text", normalise_whitespace(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn("_all", _lines(F.col("_text"))).withColumn("_form", _first_form(F.slice("_all", 1, head), forms)).withColumn("_head", F.array_join(F.slice("_all", 1, head), "\n"))
    return rows.withColumns(
        {
            "agency": agency,
            "issuance_type": F.coalesce("_form.form", F.lit(OTHER_FORM)),
            "reference_no": F.coalesce(reference, F.lit(UNKNOWN)),
            "title": _title(F.col("_all"), F.col("_form.line"), cue),
            "issue_date": first_iso_date(F.col("_text")),
            "content_hash": content_hash(F.col("_text")),
        }
    ).drop("_text", "_all", "_form", "_head")


def _override(df: DataFrame, overrides: dict[str, str] | None) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in (overrides or {}).items() if v is not None})


def normalise_issuance(df: DataFrame, text_col: str = "text", overrides: dict[str, str] | None = None) -> DataFrame:
    """Form, reference, title, date and hash of tax issuances, from their first six lines; overrides win."""
    codes = F.create_map(*(F.lit(x) for name, code, _ in TAX_FORMS for x in (name, code)))
    reference = F.concat(codes[F.col("_form.form")], F.lit(" "), F.col("_form.number"))
    return _override(_issuance(df, text_col, 6, [(n, p) for n, _, p in TAX_FORMS], reference, "subject|re", F.lit(TAX_AGENCY)), overrides)


def normalise_agency_issuance(df: DataFrame, text_col: str = "text", overrides: dict[str, str] | None = None) -> DataFrame:
    """The same for other agencies, from their first eight lines; the agency is the first whose hint is there."""
    agency = F.coalesce(*(F.when(F.col("_head").rlike(p), F.lit(name)) for name, p in AGENCIES), F.lit(OTHER_AGENCY))
    reference = F.trim(F.concat(F.col("_form.form"), F.lit(" "), F.col("_form.number")))
    return _override(_issuance(df, text_col, 8, list(AGENCY_FORMS), reference, "subject|re|title", agency), overrides)
