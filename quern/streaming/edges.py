"""First-wins edges from a stream of references that come in any order.

The state of a pair is its least reference so far; a late row with a lesser one replaces it. Spark keeps
it in its state store, keyed and partitioned by pair, and each batch gives out the pairs that changed. These
go to a folder of the batch's number, so a replayed batch writes the same rows again, and readers take each pair's least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAIR = ("citing_kind", "citing_id", "cited_kind", "cited_id")


def least_references(rows: DataFrame, order: list[str]) -> DataFrame:
    """(pair, least) of a stream or table of references; ``order`` should be total."""
    return rows.groupBy(*PAIR).agg(F.min(F.struct(*order, "cited_reference")).alias("least"))


def keep_first_edges(rows: DataFrame, order: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Run over what has come, and write the pairs whose first reference changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return least_references(rows, order).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_edges(spark: SparkSession, table: str) -> DataFrame:
    """The edges as they are now: one for each pair."""
    return spark.read.parquet(table).groupBy(*PAIR).agg(F.min("least").alias("least")).select(*PAIR, "least.cited_reference")
