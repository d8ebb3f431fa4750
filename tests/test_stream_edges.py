"""First-wins edges of a stream in any order against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import citations
from quern.streaming import edges

SCHEMA = "citing_kind string, citing_id long, cited_kind string, cited_id long, cited_reference string, at long"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_ends_equal(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [("case", rng.randrange(6), "statute", rng.randrange(4), f"ref {k}", k) for k in range(200)]
    rows += [("case", None, "statute", 1, None, 500), ("case", None, "statute", 1, "later", 501)]
    want = sorted(map(str, citations.first_edges(spark.createDataFrame(rows, SCHEMA), [F.col("at")]).collect()))
    rng.shuffle(rows)
    for start in range(0, len(rows), 50):
        spark.createDataFrame(rows[start : start + 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if start == 100:  # a stop, and a start from the checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            edges.keep_first_edges(stream, ["at"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    edges.keep_first_edges(stream, ["at"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(map(str, edges.first_edges(spark, f"{tmp_path}/out").collect())) == want
