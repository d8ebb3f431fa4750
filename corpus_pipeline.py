"""The corpus pipeline: five stages over documents, each reading all that its predecessor kept.

language ID -> exact de-duplication -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE.
All but the last stage return the columns of documents; the last returns token counts and ids' digests.

Null and empty texts, and those without a letter, have no language and go in the first stage, as do all documents where
none has a label; in later stages they would count as equal, be near to nothing, contain no benchmark words and have no tokens. Rows with a
null or repeated doc_id are documents like others; of equal texts the one with the largest doc_id stays. Texts may be of any length. Other columns
go through as they are, whatever their names. A table without rows gives one without rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.op04_exact_dedup import exact_groups
from quern.llm.op05_bpe import round_trip_digests
from quern.llm.op06_language import identify, train
from quern.llm.op08_decontaminate import find_contamination
from quern.llm.op09_ngram_join import keyed_rows, least_members, ngram_join
from quern.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` as operators pass them on."""
    return [F.col(f"keep_{c}").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; the model learns from a bounded sample of their own labels."""
    judged = identify(docs, train(docs, F.lit(True)), passing=docs.columns)
    return judged.filter("accepted").select(_own(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_groups(docs, keep="largest", passing=docs.columns).filter("kept").select(_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays; one with a null doc_id only if no other of its class has one."""
    if (keyed := keyed_rows(docs, "doc_id")) is not None:
        kept = least_members(keyed, "doc_id", ngram_join(keyed, "row_key"), "class_id").select(F.col("least_key").alias("row_key"))
        return keyed.join(kept, "row_key", "left_semi").select(docs.columns)
    return docs.join(ngram_join(docs).filter("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=None, passing=docs.columns)
    return found.filter(F.size("spans") == 0).select(_own(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and of the decoded bytes."""
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Language ID and the join's MinHash can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
