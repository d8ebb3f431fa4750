"""Title and main text of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import normalise_whitespace

MIN_TEXT = 120
#: Bytes of pages about which a task parses before it hands on their texts.
_BATCH = 4 << 20

# Where articles are looked for, best first, on two kinds of sites.
SELECTORS = ("article.entry-content", ".entry-content", ".post-content", "article", "#content", ".content")
TABLE_SELECTORS = (".post_content", ".node-body", "td[valign='top']", "td", "body")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset(("script", "style"))


class _Page(HTMLParser):
    """Text of the first element that each selector fits, of the first h1, and of the body; scripts and styles are no text."""

    def __init__(self, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.tests = [_selector(s) for s in selectors] + [_selector("h1"), _selector("body")]
        self.texts: list[list[str] | None] = [None] * len(self.tests)
        self.open: list[tuple[str, list[int]]] = []
        self.current: set[int] = set()
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        own = []
        values = dict(attrs)
        for k, test in enumerate(self.tests):
            if self.texts[k] is None and test(tag, values):
                self.texts[k] = []
                own.append(k)
        self.current.update(own)
        self.open.append((tag, own))
        self.skipped += tag in _SKIPPED

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, own = self.open.pop()
                self.current.difference_update(own)
                self.skipped -= t in _SKIPPED
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            for k in self.current:
                self.texts[k].append(data)


def _selector(s: str):
    """A test for ``tag``, ``.class``, ``tag.class``, ``#id`` or ``tag[attribute='value']``."""
    if "[" in s:
        tag, _, rest = s.partition("[")
        name, _, value = rest.rstrip("]").partition("=")
        return lambda t, a: t == tag and a.get(name) == value.strip("'\"")
    if s.startswith("#"):
        return lambda t, a: a.get("id") == s[1:]
    tag, dot, cls = s.partition(".")
    if dot:
        return lambda t, a: (not tag or t == tag) and cls in (a.get("class") or "").split()
    return lambda t, a: t == tag


def article(html: str | None, selectors: tuple[str, ...] = SELECTORS, least: int = MIN_TEXT) -> tuple[str | None, str]:
    """(title, text before white space is normalised): the first selector with enough text wins, else the body."""
    page = _Page(selectors)
    page.feed(html or "")
    page.close()
    texts = [None if t is None else "".join(t) for t in page.texts]
    main = next((t for t in texts[:-2] if t is not None and len(t.strip()) >= least), None)
    if main is None or not main.strip():
        main = texts[-1] if texts[-1] is not None else ""
    title = (texts[-2] or "").strip()
    return title or None, main


def extract_article(df: DataFrame, html_col: str = "html", *, selectors: tuple[str, ...] = SELECTORS, least: int = MIN_TEXT) -> DataFrame:
    """``df`` without its HTML, with ``title`` and normalised ``text``."""
    others = [c for c in df.columns if c not in (html_col, "title", "text")]
    rows = df.select(*others, F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * _BATCH / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = [article(p.as_py(), selectors, least) for p in batch.columns[-1]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=schema.names)

    return rows.mapInArrow(read, schema).withColumn("text", normalise_whitespace(F.col("text")))
