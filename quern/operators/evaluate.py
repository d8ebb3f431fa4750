"""Golden questions: reading them, matching answers, and summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import EDGE, SPACE, trim_space

LONG_ANSWER = 8

GOLDEN_SCHEMA = "question string, answer string, plan struct<tool: array<struct<_name: string, _args: string>>>"


def normalise_answer(c: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return trim_space(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))


def answer_matches(text: Column, answer: Column) -> Column:
    """Whether a text has an answer: long ones anywhere, short ones with a digit not inside a number, other short ones as whole words; never an empty one."""
    hay, needle = normalise_answer(text), normalise_answer(answer)
    quoted = F.regexp_replace(needle, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    number = F.regexp_like(hay, F.concat(F.lit("(?<![0-9])"), quoted, F.lit("(?![0-9])")))
    word = F.regexp_like(hay, F.concat(F.lit(EDGE), quoted, F.lit(EDGE)))
    return F.when(needle == "", F.lit(False)).when(F.length(needle) >= LONG_ANSWER, F.contains(hay, needle)).when(needle.rlike("[0-9]"), number).otherwise(word)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, plan (array of tool and its arguments as a map), in order."""
    rows = spark.read.format("xml").option("rowTag", "qa_pair").schema(GOLDEN_SCHEMA).load(path)
    steps = F.transform("plan.tool", lambda t: F.struct(t["_name"].alias("tool"), F.from_json(t["_args"], "map<string,string>").alias("args")))
    return rows.select(F.trim("question").alias("question"), F.trim("answer").alias("answer"), steps.alias("plan"))


def outcome(matched: Column, covered: Column) -> Column:
    """pass: the answer is there; cover: it is not, and the corpus lacked coverage; fail: it is not, though the corpus had coverage."""
    return F.when(matched, "pass").when(~covered, "cover").otherwise("fail")


def summarise(df: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """One row: passed, coverage, failed, total and exit code (1: failures; 2: nothing passed for want of coverage; else 0)."""
    n = lambda v: F.count_if(F.col(outcome_col) == v)
    sums = df.agg(n("pass").alias("passed"), n("cover").alias("coverage"), n("fail").alias("failed"), F.count("*").alias("total"))
    return sums.withColumn("exit_code", F.when(F.col("failed") > 0, 1).when((F.col("coverage") > 0) & (F.col("passed") == 0), 2).otherwise(0))
