"""Structured Streaming ingest: seed lines as they arrive, each source once, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.schemas import SEED


def seed_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 100) -> DataFrame:
    """New seed lines of a folder, with the time when they were read."""
    rows = spark.readStream.schema(SEED).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.filter("kind IS NOT NULL AND record IS NOT NULL").withColumn("seen_at", F.current_timestamp())


def first_of_source(rows: DataFrame, watermark: str = "7 days") -> DataFrame:
    """The first line of each (kind, source, content); state older than the watermark is dropped."""
    keyed = rows.withColumns({"source_url": F.col("record.sourceUrl"), "content_hash": F.col("record.contentHash")})
    return keyed.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["kind", "source_url", "content_hash"])


def ingest(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, partitioned by kind, what is not yet there; a batch that is replayed adds nothing, nor do lines without a source or hash whose like is there."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = ["kind", "source_url", "content_hash"]
        batch = batch.dropDuplicates(keys)
        try:
            there = spark.read.parquet(table).select(*keys)  # three narrow columns
            same = (batch["kind"] == there["kind"]) & batch["source_url"].eqNullSafe(there["source_url"]) & batch["content_hash"].eqNullSafe(there["content_hash"])
            batch = batch.join(there, same, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("append").partitionBy("kind").parquet(table)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
