"""Bounded samples of rows to train on: chosen by a hash of the whole row, so that neither repeated identifiers nor copies weigh on the choice.

``choose`` takes the least distinct hashes of each kind; ``gather`` reads the texts of
those, once each, turns them into features in tasks, and brings to the driver as many as a number
of bytes holds. Copies of a row count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written


def row_hash(*columns: Column, seed: int) -> Column:
    return F.xxhash64(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns), F.lit(seed))


def choose(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, dice): the ``most`` least distinct dice of each kind. ``counts`` has (kind, n, most), few rows, with about the number of distinct dice."""
    share = F.pmod("dice", F.lit(1 << 30)) / float(1 << 30)
    # most rows go before anything is shuffled: about two times as many hashes of each kind go on as are taken
    near = rows.join(F.broadcast(counts), "kind").filter(share * F.col("n") < 2 * F.col("most") + 100).select("kind", "dice", "most").distinct()
    order = Window.partitionBy("kind").orderBy(F.pmod("dice", F.lit(1 << 30)), "dice")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("most")).select("kind", "dice")


def gather(texts: DataFrame, chosen: DataFrame, features: Callable[[list[bytes]], list[tuple[np.ndarray, ...]]], kinds: tuple[str, ...], limit: int) -> list[tuple]:
    """(kind, x0, x1, ...) of the rows of ``texts`` (dice, text) that ``chosen`` (kind, dice) names, each once, in order of dice.
    ``features`` gives arrays of the element types ``kinds`` for each text. Each kind gets an equal share of ``limit`` bytes; rows are left out from where its share ends."""
    names = [f"x{k}" for k in range(len(kinds))]
    kind_type = chosen.schema["kind"].dataType.simpleString()
    arrow = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # as many as were chosen at most
        for batch in small_batches(batches):
            dice = batch.column(1).to_pylist()
            fresh = [i for i, d in enumerate(dice) if d not in seen and not seen.add(d)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            found = features([x or b"" for x in batch.column(2).cast(pa.large_binary()).to_pylist()])
            cuts = [pa.array(np.concatenate(([0], np.cumsum([len(f[k]) for f in found]))), pa.int32()) for k in range(len(kinds))]
            lists = [pa.ListArray.from_arrays(cuts[k], pa.array(np.concatenate([f[k] for f in found]), arrow[t])) for k, t in enumerate(kinds)]
            size = pa.array([sum(len(f[k]) * arrow[t].bit_width // 8 for k, t in enumerate(kinds)) + 64 for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, *lists], names=["kind", "dice", "size", *names])

    rows = texts.join(F.broadcast(chosen), "dice").select("kind", "dice", "text")  # as many rows as the caller's bound
    made = written(rows.mapInArrow(run, f"kind {kind_type}, dice long, size long, " + ", ".join(f"{n} array<{t}>" for n, t in zip(names, kinds, strict=True))))
    sizes = made.groupBy("kind", "dice").agg(F.min("size").alias("size"))
    share = limit // max(1, chosen.select("kind").distinct().count())
    sofar = F.sum("size").over(Window.partitionBy("kind").orderBy("dice").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("sofar", sofar).filter(F.col("sofar") <= share).select("kind", "dice")
    found = made.join(F.broadcast(fitting), ["kind", "dice"], "left_semi").dropDuplicates(["kind", "dice"]).select("kind", "dice", *names).toArrow()
    order = np.argsort(found["dice"].to_numpy()).tolist()
    kind, columns = found["kind"].to_pylist(), [[x.values.to_numpy().copy() for x in found[n]] for n in names]
    del found
    pa.default_memory_pool().release_unused()  # the driver has little memory to spare
    return [(kind[i], *(c[i] for c in columns)) for i in order]
