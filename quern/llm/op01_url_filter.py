"""URL filter: a trie over reversed host labels and path segments, with longest match between allow and block entries.

A rule fits its host and all its subdomains if the url's path starts with the
rule's path. The longest rule string (host + path) wins; of two of the same
length the one with the longer host; of an allow and a block entry for the same
place the block. Urls without a fitting rule get the default verdict.

The trie goes to the tasks if it has at most ``BROADCAST_RULES`` rules; more are
matched by an equi-join on (host suffix, whole leading path segments), which
gives the same verdicts without a broadcast.

A null url, or one without ``://``, has an empty host and path and fits no rule;
empty hosts and hosts with empty labels are plain strings. Urls may be of any
length; repeated rows are judged one by one; other columns are not read. A table
without rows gives one without rows, and without rules every url has the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches

BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or not self.host or "/" in self.host or not self.path.startswith("/"):
            raise ValueError(f"not a rule: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule from ``host/path``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate({c: c + 32 for c in range(65, 91)}), slash + path or "/")


class _Paths:
    """Path segments below one host: a segment ends with its slash; a rule's last part may end inside a segment."""

    __slots__ = ("below", "parts", "rule", "sizes")

    def __init__(self):
        self.below: dict[str, _Paths] = {}
        self.rule: Rule | None = None  # its path ends just here
        self.parts: dict[str, Rule] = {}  # rules that end inside the next segment
        self.sizes: list[int] = []

    def add(self, path: str, rule: Rule) -> None:
        head, slash, rest = path.partition("/")
        if slash:
            self.below.setdefault(head, _Paths()).add(rest, rule)
        elif not path:
            self.rule = _stronger(self.rule, rule)
        else:
            self.parts[path] = _stronger(self.parts.get(path), rule)
            self.sizes = sorted({len(x) for x in self.parts}, reverse=True)

    def longest(self, path: str) -> Rule | None:
        node, at, best = self, 0, None
        while node is not None:
            best = node.rule or best
            end = path.find("/", at)
            stop = len(path) if end < 0 else end
            best = next((node.parts[path[at : at + n]] for n in node.sizes if n <= stop - at and path[at : at + n] in node.parts), best)
            node, at = (node.below.get(path[at:end]), end + 1) if end >= 0 else (None, at)
        return best


def _stronger(old: Rule | None, new: Rule) -> Rule:
    return new if old is None or new.verdict == "block" else old


class Trie:
    """Hosts by reversed labels; at each label the path rules of that host."""

    __slots__ = ("below", "paths")

    def __init__(self, rules: Iterable[Rule] = ()):
        self.below: dict[str, Trie] = {}
        self.paths: _Paths | None = None
        for rule in rules:
            node = self
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, Trie())
            node.paths = node.paths or _Paths()
            node.paths.add(rule.path, rule)

    def match(self, host: str, path: str) -> Rule | None:
        node, best = self, None
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            rule = node.paths and node.paths.longest(path)
            if rule and (best is None or len(rule.text) >= len(best.text)):  # a deeper host wins ties
                best = rule
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", *, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per row of ``df``: its identifier, host, path, rule (host + path of the rule, or null) and verdict."""
    host, path = url_parts(df[url_col].cast("string"))
    rows = df.select(df[id_col].alias("id"), host.alias("host"), path.alias("path"))
    found = _by_trie(rows, rules, default) if len(rules) <= broadcast_rules else _by_join(rows, rules, default)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def _by_trie(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Trie(rules))  # at most BROADCAST_RULES rules

    def make():
        trie = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r and r.text for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())], names=["id", "host", "path", "rule", "verdict"])

        return step

    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _by_join(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by joins: each url offers its host suffixes with the leading parts of its path that are as long as some rule's.

    A rule waits at its own host and path, so a url meets only rules that fit it, however many share a host or a folder.
    """
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.array(*(F.lit(k) for k in sorted({len(r.path) for r in rules})))
    heads = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    offers = places.filter("path <> ''").select("host", "path", F.explode(hosts).alias("rule_host")).select("host", "path", "rule_host", F.explode(heads).alias("rule_path"))
    size = F.length("rule_host") + F.length("rule_path")
    best = offers.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("deep"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))  # "block" is after "allow"
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
