"""Citations in texts that come in passages, as in the passages' joined text, without joining them.

Each passage is read with a bounded tail of what follows it, and owns the citations
that start in it. Patterns never match overlapping text, so where a citation runs over a
border, the next passage's search for that kind begins behind its end; only passages after such a citation are searched again.
Passages are sorted in ranges, so a text of any number of passages spans several tasks; from each task only the
beginning of its first text, and one key, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tables import written

from .citations import ORDER, owned_spans, placed_spans

#: Characters of what follows that a passage is read with. A citation that runs over a border is found if it is not longer, blanks included.
TAIL = 512
_KEY = ("citing_kind", "citing_id", "passage")


def with_tails(rows: DataFrame, chars: int = TAIL) -> DataFrame:
    """``rows`` (citing_kind, citing_id, passage, text; passages of a text are in order of ``passage``) with ``tail``, the text after it with line ends between, and ``before``, the passage before it. Null texts are left out."""
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("citing_id", "passage"))
    schema = f"citing_kind string, citing_id {kind}, passage {number}, text string, tail string, before {number}, task int, whole boolean, mark int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size = TaskContext.get().partitionId(), [], []  # rows whose tail may grow, and the length of each tail
        entity = before = first = None
        alone, head, mark, types = True, [], 1, None

        def table(out: list[list]) -> pa.RecordBatch:
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [*types[:3], pa.string(), pa.string(), types[2], pa.int32(), pa.bool_(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*[[*r[:4], "".join(r[4]), *r[5:]] for r in out], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            types, out = batch.schema.types, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != entity:
                    out += held
                    held, size, before = [], [], None
                    alone, mark = first is None, 1 if first is None else 0
                    entity = row[:2]
                    first = first or entity
                piece = "\n" + row[3][:chars]
                for k, r in enumerate(held):
                    r[4].append(piece[: chars - size[k]])
                    size[k] += len(piece)
                full = next((k for k, n in enumerate(size) if n < chars), len(held))  # earlier rows are filled first
                out += held[:full]
                held, size = held[full:], size[full:]
                if entity == first and sum(map(len, head)) < chars:
                    head.append(piece)
                held.append([*row, [], before, task, alone, mark])  # mark 1: the first passage of the task
                size.append(0)
                before, mark = row[2], 0
            if out:
                yield table(out)
        if held:
            for r in held:
                r[8] += 2  # the tail may go on in the next task
            held[-1][8] += 4
            yield table([*held, [*first, None, None, ["".join(head)[:chars]], None, task, alone, 8]])

    columns = rows.select("citing_kind", "citing_id", "passage", "text").filter("text IS NOT NULL")
    found = written(columns.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(scan, schema))
    heads = {r["task"]: r for r in found.filter("mark = 8").collect()}  # a row and a bounded text for each task
    ends = {r["task"]: (r["citing_kind"], r["citing_id"], r["passage"]) for r in found.filter("mark >= 4 AND mark < 8").drop("text", "tail").collect()}
    order = sorted(heads)
    more, before = {}, {}
    for k, task in enumerate(order):
        text = ""
        for after in order[k + 1 :]:
            if (heads[after]["citing_kind"], heads[after]["citing_id"]) != ends[task][:2] or len(text) >= chars:
                break
            text += heads[after]["tail"]
            if not heads[after]["whole"]:
                break
        more[task] = text
        if k and (heads[task]["citing_kind"], heads[task]["citing_id"]) == ends[order[k - 1]][:2]:
            before[task] = ends[order[k - 1]][2]
    spark = rows.sparkSession
    carried = spark.createDataFrame([(t, more[t], before.get(t)) for t in order], f"task int, more string, earlier {number}")
    rest = found.filter("mark < 8").join(F.broadcast(carried), "task")  # a bounded row for each task
    tail = F.when(F.col("mark").bitwiseAND(2) > 0, F.substring(F.concat("tail", "more"), 1, chars)).otherwise(F.col("tail"))
    first = F.when(F.col("mark").bitwiseAND(1) > 0, F.col("earlier")).otherwise(F.col("before"))
    return rest.select(*_KEY, "text", tail.alias("tail"), first.alias("before"))


def _searched(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans`` that each passage owns, and ``ends``: for each kind, how far into the next passage its last citation, or one from before it, reaches."""
    return owned_spans(rows)


def border_spans(rows: DataFrame, chars: int = TAIL) -> DataFrame:
    """(citing_kind, citing_id, passage, place, span...) of citations in passages, as in the passages' text joined by line ends."""
    tailed = written(with_tails(rows, chars).withColumn("skips", F.array(*(F.lit(0) for _ in ORDER))))
    found = written(_searched(tailed))
    reaches = lambda c: reduce(or_, (c[k] > 0 for k in range(len(ORDER))))
    over = found.filter(reaches(F.col("ends"))).select("citing_kind", "citing_id", F.col("passage").alias("before"), F.col("ends").alias("skips"))
    while not over.isEmpty():
        again = written(_searched(tailed.drop("skips").join(over, ["citing_kind", "citing_id", "before"])))
        old = found.select(*_KEY, F.col("ends").alias("old"))
        changed = again.join(old, list(_KEY)).filter(~F.col("ends").eqNullSafe(F.col("old")))
        over = written(changed.select("citing_kind", "citing_id", F.col("passage").alias("before"), F.col("ends").alias("skips")))
        found = written(found.join(again.select(*_KEY), list(_KEY), "left_anti").unionByName(again))
    return placed_spans(found, list(_KEY))
