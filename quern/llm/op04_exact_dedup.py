"""Exact de-duplication by content sort, in DataFrame operations only.

Rows are range-partitioned by their normalised text at splitters that Spark
samples, sorted externally within each range, and equal neighbours are compared
in full: the window's key is the text itself. A splitter holds a text's first
``PREFIX`` characters and two numbers, never more, so what reaches the driver
does not follow the length of texts: where many texts begin alike, a fingerprint
says to which range they go.

A text whose copies would fill more than half of an average partition is dealt
over as many parts as it needs, by a hash of the identifier, which the range
partitioner can send to different tasks. It is found by one count of fingerprints beforehand (pre-aggregated in each
task). Each part is sorted and compared like any text; then the first rows of a
text's parts are compared in full with each other, and each row learns through
its part what they found. Without such texts there is no second step.

Texts are read three times: for the count, for Spark's sample, and for the sort.

Nulls count as the empty text. Repeated rows (even with equal identifiers) are
members of their group like any other; a null identifier never stays if its
group has another. An empty table gives an empty result. Columns other than the
two named are not read, so clashing names do no harm. Length is no limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import written

#: Characters of a text in a splitter, and bytes that a row has beside its text.
PREFIX, ROW_BYTES = 64, 100
#: Parts of hot texts go to all tasks up to this number of rows of about 150 bytes each.
BROADCAST_PARTS = 200_000


def hot_texts(rows: DataFrame, partitions: int) -> tuple[DataFrame, int] | None:
    """(print, parts) of texts whose copies fill more than half of one of ``partitions`` partitions, and the number of all their parts; None if there are none. At most 2 * partitions texts, and twice as many parts."""
    copies = written(rows.groupBy("print").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("size")))
    share = (copies.agg(F.sum("size")).first()[0] or 0) / (2 * partitions)
    hot = copies.filter((F.col("n") > 1) & (F.col("size") > share)).select("print", F.ceil(F.col("size") / F.lit(max(share, 1.0))).cast("int").alias("parts"))
    n = hot.agg(F.sum("parts")).first()[0]
    return (hot, n) if n else None


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalise: Callable[[Column], Column] | None = None, keep: str = "smallest", partitions: int | None = None, passing: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: which identifier of equal texts stays, the ``smallest`` or the
    ``largest``. ``normalise``: a column function applied to the text first. Each
    column c in ``passing`` is returned as keep_c. ``partitions``: how many the
    session shuffles to, unless another number is given.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    kept_columns = [f"keep_{c}" for c in passing or []]
    rows = df.select(df[id_col].alias("doc_id"), (normalise(text) if normalise else text).alias("text"), *(df[c].alias(f"keep_{c}") for c in passing or []))
    rows = rows.withColumn("print", F.xxhash64("text"))
    found = hot_texts(rows, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    by = ["prefix", "print"]
    columns = ["doc_id", "text", F.substring("text", 1, PREFIX).alias("prefix"), "print", *kept_columns]
    if found:
        by.append("part")
        parts = found[0] if found[1] > BROADCAST_PARTS else F.broadcast(found[0])
        rows = rows.join(parts, "print", "left")
        columns.append(F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("part"))
    ranged = rows.select(*columns).repartitionByRange(*([partitions] if partitions else []), *by)
    # one order for all three, so one external sort; the window's key holds the whole text
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    same = Window.partitionBy(*by, "text").orderBy(order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(same)
    seen = ranged.select(
        "doc_id",
        *by[1:],
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        rank.alias("rank"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        *([F.when(F.col("part").isNotNull() & (rank == 1), F.col("text")).alias("head")] if found else []),
        *kept_columns,
    )
    if found:
        seen = written(seen)
        heads = seen.filter("head IS NOT NULL").select("head", "print", "part", "text_sha256", "keep_id", "group_size")
        texts = heads.groupBy("head").agg(best("keep_id").alias("hot_keep"), F.sum("group_size").alias("hot_size"))  # whole texts are compared
        answers = heads.join(texts, "head").select("print", "part", "text_sha256", "hot_keep", "hot_size")
        seen = seen.drop("head").join(answers if found[1] > BROADCAST_PARTS else F.broadcast(answers), ["print", "part", "text_sha256"], "left").withColumns(
            {
                "rank": F.when(F.col("hot_size").isNotNull() & ~F.col("keep_id").eqNullSafe(F.col("hot_keep")), F.lit(2)).otherwise(F.col("rank")),
                "keep_id": F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("keep_id")),
                "group_size": F.coalesce("hot_size", "group_size"),
            }
        )
    kept = (F.col("rank") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return seen.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *kept_columns)
