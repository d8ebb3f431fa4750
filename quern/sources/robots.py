"""robots.txt rules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_robots(content: str) -> list[tuple[str, str | None]]:
    """(agent, disallowed prefix) in order; an agent without prefixes has one row with null."""
    rules: dict[str, list[str]] = {}
    agent = None
    for line in (x.strip() for x in content.splitlines()):
        name, colon, value = line.partition(":")
        if not colon or line.startswith("#"):
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agent = value.lower()
            rules.setdefault(agent, [])
        elif name == "disallow" and agent is not None and value:
            rules[agent].append(value)
    return [(a, p) for a, prefixes in rules.items() for p in (prefixes or [None])]


def rules_table(spark: SparkSession, content: str) -> DataFrame:
    return spark.createDataFrame(parse_robots(content), "agent string, prefix string")


def rules_for_agent(rules: DataFrame, user_agent: str) -> DataFrame:
    """(prefix) of the group with the longest name that the agent starts with, else of ``*``."""
    fit = rules.filter((F.col("agent") != "*") & F.startswith(F.lit(user_agent.lower()), F.col("agent")) | (F.col("agent") == "*"))
    size = F.when(F.col("agent") == "*", -1).otherwise(F.length("agent"))
    best = fit.agg(F.max_by("agent", size).alias("agent"))
    return fit.join(F.broadcast(best), "agent").filter("prefix IS NOT NULL").select("prefix")  # best is one row


def url_path(url: Column) -> Column:
    """A url's path, ``/`` if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))


def allowed_pages(pages: DataFrame, rules: DataFrame, url_col: str = "url", *, most_prefixes: int = 10_000) -> DataFrame:
    """Pages whose path starts with no disallowed prefix. Up to ``most_prefixes`` are tested in the plan, more are joined."""
    rules = rules.select("prefix").filter("prefix <> ''").distinct()
    prefixes = [r["prefix"] for r in rules.limit(most_prefixes + 1).collect()]
    if len(prefixes) > most_prefixes:
        return _allowed_by_join(pages, rules, url_col)
    bad = F.lit(False)
    for p in sorted(prefixes):
        bad = bad | url_path(F.col(url_col)).startswith(p)
    return pages.filter(~bad)


def _allowed_by_join(pages: DataFrame, rules: DataFrame, url_col: str) -> DataFrame:
    """The same by equality: each distinct path offers its leading parts, no longer than the longest prefix."""
    longest = rules.agg(F.max(F.length("prefix"))).first()[0]
    ends = F.sequence(F.lit(1), F.least(F.length("_path"), F.lit(longest)))
    parts = F.transform(ends, lambda k: F.substring(F.col("_path"), F.lit(1), k))
    offers = pages.select(url_path(F.col(url_col)).alias("_path")).distinct().select("_path", F.explode(parts).alias("prefix"))
    bad = offers.join(rules, "prefix", "left_semi").select("_path").distinct()
    return pages.join(bad, url_path(F.col(url_col)) == F.col("_path"), "left_anti")


def url_host(url: Column) -> Column:
    """A url's host as written, empty if it has none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def rules_of_hosts(files: DataFrame, user_agent: str) -> DataFrame:
    """(host, prefix) that each host's file (host, content) forbids to an agent: of the group with the longest name that the agent starts with, else of ``*``.

    Lines are numbered in their file; a rule belongs to the last agent line before it, which is the last one
    that a window over the file carries down. Groups of one name count together, as in ``parse_robots``. A file is a bounded text, and has a window of its own.
    """
    lines = files.select("host", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]")).alias("place", "line"))
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    parts = lines.withColumn("line", line).filter(~F.startswith("line", F.lit("#")) & F.contains("line", F.lit(":")))
    name, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")))
    said = parts.select("host", "place", name.alias("name"), value.alias("value")).filter(F.col("name").isin("user-agent", "disallow"))
    down = Window.partitionBy("host").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("agent", F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(down)).filter("agent IS NOT NULL")
    fits = (F.col("agent") == "*") | F.startswith(F.lit(user_agent.lower()), F.col("agent"))
    said = said.filter(fits).withColumn("size", F.when(F.col("agent") == "*", -1).otherwise(F.length("agent")))
    best = said.withColumn("best", F.max("size").over(Window.partitionBy("host"))).filter("size = best")
    return best.filter((F.col("name") == "disallow") & (F.col("value") != "")).select("host", F.col("value").alias("prefix")).distinct()


def allowed_by_host(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Pages whose path starts with no prefix that ``rules`` (host, prefix) has for their host. Each distinct path offers the leading parts of the lengths that
    its host's prefixes have, so nothing is compared with all rules of a host."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    lengths = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # a host's prefixes have few lengths
    asked = pages.select(host.alias("_host"), path.alias("_path")).distinct().join(lengths.withColumnRenamed("host", "_host"), "_host")
    offers = asked.select("_host", "_path", F.explode(F.filter("lengths", lambda n: n <= F.length("_path"))).alias("n")).select("_host", "_path", F.substring(F.col("_path"), F.lit(1), F.col("n")).alias("prefix"))
    bad = offers.join(rules.withColumnRenamed("host", "_host"), ["_host", "prefix"], "left_semi").select("_host", "_path").distinct()
    return pages.withColumns({"_host": host, "_path": path}).join(bad, ["_host", "_path"], "left_anti").drop("_host", "_path")
