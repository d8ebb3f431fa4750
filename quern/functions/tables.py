"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a folder of this process if Spark runs in this process alone, as in tests; on a cluster an error."""
    global _own_folder
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


#: Tables of at most so many bytes are spread.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, as a small file of one row group lies in one partition. Beyond SPREAD_BYTES, by Spark's own estimate, nothing is shuffled."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that no other table has."""
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage, and those of all steps add up."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


def written(df: DataFrame, *, release: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, and safe from lost executors. With ``release`` its shuffle files go at once."""
    path = new_folder(df.sparkSession)
    with releasing(df.sparkSession) if release else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
