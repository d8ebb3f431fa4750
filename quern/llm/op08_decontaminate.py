"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table. Each training word has a place in the whole corpus,
a number of which the upper bits name the task that read it and the lower ones
count on through all its texts; between texts lies a gap wider than any search, so
nothing that is looked for can reach over a text's end. A posting list holds a
term's places within one cell of 32,768: (term, cell, places), dealt by (term, a
run of cells) and sorted, so a frequent term's lists lie in many partitions, and
no row is larger than a cell. Words are kept as they are, not as hashes. Beside
the lists stands a directory of where each text begins.

Every window of ``width`` benchmark words is looked up by joins. Its distinct
terms are put in order of their number of places in the index; a window with a
term that is in no text drops out. The lists of its rarest term give candidate
places; these meet the second rarest term's lists by (term, cell), and where a
place of that is close enough, all terms' lists, shifted by their offsets. A
window is an exact phrase if every list has the place it should have. It is near
if some run of up to ``length + slop`` words of the text has all its distinct
words, in any order. Neither texts nor benchmark pass through the driver, and
both may be of any size; only a vocabulary under VOCABULARY_BYTES is sent to
all tasks, so that other words are left out of the index: else all words are
stored, with the same results.

Null and empty texts have no words and match nothing; an empty benchmark leaves
all documents clean; repeated item texts count as items of their own. Items with
a null identifier are searched like all others, but have no place in the lists of
identifiers. Rows with equal identifiers and equal texts have equal results;
otherwise repeated identifiers do no harm, and other columns are not read. A table without
rows gives one without rows. Texts may be of any length: a long one is indexed in slices;
a task may read any number of texts (2**40 words) and there may be 2**23 tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower

from .shared import map_batches, text_or_empty, written
from .words import BLOCK_BYTES, Block, utf8

WINDOW, SLOP, VOCABULARY_BYTES = 10, 4, 4 << 20
#: A place is (task, word of the task) in 23 and PLACE_BITS bits; a run has 2**RUN_BITS places, a cell 2**CELL_BITS; so many places lie between texts.
PLACE_BITS, RUN_BITS, CELL_BITS, GAP = 40, 20, 15, 32
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window number, terms), and the items that have each (window, item)."""
    words = F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(WORD), F.lit(0))
    listed = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    owned = written(listed.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k, width))).alias("terms")).distinct())
    windows = written(owned.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()))
    return windows, windows.join(owned, "terms").select("window", "item")


def vocabulary_hashes(windows: DataFrame, limit: int) -> np.ndarray | None:
    """Sorted hashes of the windows' terms; None if the terms have more than ``limit`` bytes."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    if (terms.agg(F.sum(F.octet_length("term") + 1)).first()[0] or 0) > limit:
        return None
    words = [r["term"].encode() for r in terms.collect()]
    return np.sort(Block([b" ".join(words)]).word_hashes())


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in slices of about ``size`` bytes that end between words."""
    at = 0
    while at < len(text):
        found = _BETWEEN.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _blocks(texts: list[bytes], limit: int) -> Iterator[tuple[bool, Block, np.ndarray, list[tuple[int, int, int]]]]:
    """Blocks of texts: (whether places begin anew, block, place of each of its words, and of the texts that end in it the number, begin and count of words)."""
    held: list[int] = []
    size = 0

    def together() -> tuple[bool, Block, np.ndarray, list[tuple[int, int, int]]]:
        block = Block([texts[i] for i in held])
        first = block.first[:-1] + GAP * np.arange(len(held))
        return True, block, np.arange(len(block.start)) + GAP * block.text_of, list(zip(held, first.tolist(), np.diff(block.first).tolist(), strict=True))

    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield together()
            held, size = [], 0
        if len(text) <= limit:
            held.append(i)
            size += len(text) + 1
            continue
        so_far, left = 0, len(text)
        for part in _slices(text, limit):
            block, fresh = Block([part]), left == len(text)
            left -= len(part)
            places = np.arange(len(block.start)) + so_far
            so_far += len(block.start)
            yield fresh, block, places, [] if left else [(i, 0, so_far)]
    if held:
        yield together()


def _same_words(block: Block, words: np.ndarray, first: np.ndarray) -> bool:
    """Whether each of ``words`` has the length and the outer eight bytes of the word in ``first`` (of up to 16 bytes: is that word)."""
    start, end = block.start[words], block.end[words]
    other, stop = block.start[first], block.end[first]
    if (end - start != stop - other).any():
        return False
    for k in range(8):
        left, right = np.minimum(start + k, end - 1), np.maximum(end - 1 - k, start)
        if (block.folded[left] != block.folded[other + (left - start)]).any() or (block.folded[right] != block.folded[other + (right - start)]).any():
            return False
    return True


def _lists(block: Block, places: np.ndarray, vocabulary: np.ndarray | None, cell_bits: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of a block: terms, cells, where each list begins (with the end), places in order of list."""
    hashes = block.word_hashes()
    words = np.arange(len(hashes))
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
        words = words[vocabulary[at] == hashes] if len(vocabulary) else words[:0]
    number = hashes[words]
    order = np.argsort(number, kind="stable")
    words, number = words[order], number[order]
    run = np.concatenate(([True], number[1:] != number[:-1])) if len(words) else np.zeros(0, bool)
    text = block.folded.tobytes()
    spelt = lambda w: text[block.start[w] : block.end[w]]
    if len(words) and not _same_words(block, words, words[np.flatnonzero(run)[np.cumsum(run) - 1]]):
        names: dict[bytes, int] = {}  # two words with one hash: number the words themselves
        number = np.array([names.setdefault(spelt(w), len(names)) for w in words.tolist()])
        order = np.lexsort((words, number))
        words, number = words[order], number[order]
        run = np.concatenate(([True], number[1:] != number[:-1]))
    places = places[words]
    begin = np.flatnonzero(run | np.concatenate(([True], (places[1:] >> cell_bits) != (places[:-1] >> cell_bits)))) if len(words) else np.zeros(0, np.int64)
    return [spelt(w) for w in words[begin].tolist()], places[begin] >> cell_bits, np.append(begin, len(words)), places


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: np.ndarray | None = None, *, cell_bits: int = CELL_BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index, written: (term, cell, n, places within the cell), and for each text a row without a term: (base, doc_id, print, n_words)."""

    def make():
        task, free = TaskContext.get().partitionId(), [0]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms, cells, sizes, places, texts, begin = [], [], [], [], [], 0
            for fresh, block, local, ended in _blocks(utf8(batch.column(1)), block_bytes):
                begin = -(-free[0] >> cell_bits) << cell_bits if fresh else begin  # at a cell's border
                base = task << PLACE_BITS | begin
                own, cell, cut, at = _lists(block, local + base, vocabulary, cell_bits)
                terms += own
                cells.append(cell)
                sizes.append(np.diff(cut))
                places.append((at & ((1 << cell_bits) - 1)).astype(np.int32))
                texts += [(i, start + base, n) for i, start, n in ended]
                free[0] = max(free[0], begin + max([*(local[-1:] + 1).tolist(), *(start + n for _, start, n in ended[-1:])], default=0) + GAP)
            size, rows = np.concatenate(sizes), pa.array([i for i, _, _ in texts], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.concatenate(places)))
            postings = pa.record_batch([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(np.concatenate(cells), pa.int64()), pa.array(size, pa.int32()), lists], names=["term", "cell", "n", "places"])
            directory = pa.record_batch([pa.array([b for _, b, _ in texts], pa.int64()), batch.column(0).take(rows), batch.column(2).take(rows), pa.array([n for _, _, n in texts], pa.int64())], names=["base", "doc_id", "print", "n_words"])
            both = pa.concat_tables([pa.Table.from_batches([postings]), pa.Table.from_batches([directory])], promote_options="default")
            return both.combine_chunks().to_batches()[0]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    index = map_batches(rows, make, f"term string, cell long, n int, places array<int>, base long, doc_id {kind}, print long, n_words long")
    dealt = index.repartition("term", _run(F.coalesce("cell", F.shiftright("base", cell_bits)), cell_bits))
    return written(dealt.sortWithinPartitions("term", "cell"))


def _run(cell: Column, cell_bits: int) -> Column:
    """The run of cells that are dealt together."""
    return F.shiftright(cell, RUN_BITS - min(cell_bits, RUN_BITS))


def search_index(index: DataFrame, windows: DataFrame, slop: int | None, *, cell_bits: int = CELL_BITS, few_terms: bool = False) -> DataFrame:
    """Matches of windows: (window, place of the rarest term, start, length, exact, near); ``near`` is false if ``slop`` is None. ``few_terms``: the windows' terms are known to fit into every task."""
    lists = index.filter("term IS NOT NULL").select("term", "cell", "n", "places")
    runs = written(lists.groupBy("term", _run(F.col("cell"), cell_bits).alias("run")).agg(F.sum("n").alias("n")))
    frequency = runs.groupBy("term").agg(F.sum("n").alias("frequency"))
    spread = windows.select("window", F.size("terms").alias("length"), F.size(F.array_distinct("terms")).alias("distinct"), F.posexplode("terms").alias("offset", "term"))
    parts = spread.groupBy("window", "length", "distinct", "term").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))  # at most ``width``
    asked = parts.join(frequency, "term").groupBy("window", "length", "distinct").agg(F.array_sort(F.collect_list(F.struct("frequency", "term", "offsets"))).alias("parts"))
    asked = written(asked.filter(F.size("parts") == F.col("distinct")).select("window", "length", "parts"))
    part = lambda k: F.try_element_at("parts", F.lit(k))
    first = asked.select("window", "length", part(1)["term"].alias("term"), part(1)["offsets"][0].alias("first"), part(2)["term"].alias("second"), part(2)["offsets"][0].alias("next"))
    # a window asks for its rarest term run by run, so that the lists of a frequent term meet it in many tasks
    by_run = first.join(runs.select("term", "run"), "term").join(lists.withColumn("run", _run(F.col("cell"), cell_bits)), ["term", "run"])
    found = by_run.withColumn("low", F.explode("places")).withColumn("place", F.shiftleft("cell", cell_bits) + F.col("low")).drop("term", "run", "cell", "low", "n", "places")

    def close(rows: DataFrame, offset: Column, lists: DataFrame) -> DataFrame:
        """Rows with the places of their term that are close enough: where the term at ``offset`` must be if there is no slop, else within reach of the place found."""
        if slop is None:
            low = high = F.col("place") - F.col("first") + offset
        else:
            low, high = F.col("place") - F.col("length") - slop + 1, F.col("place") + F.col("length") + slop - 1
        rows = rows.withColumns({"low": low, "high": high})
        rows = rows.withColumn("cell", F.explode(F.array_distinct(F.array(F.shiftright("low", cell_bits), F.shiftright("high", cell_bits)))))
        begin = F.shiftleft("cell", cell_bits)
        least, most = F.greatest(F.col("low") - begin, F.lit(0)).cast("int"), F.least(F.col("high") - begin, F.lit((1 << cell_bits) - 1)).cast("int")
        rows = rows.join(lists.drop("n"), ["term", "cell"])
        if slop is None:
            rows = rows.filter(F.array_contains("places", least)).withColumn("around", F.array("low"))
        else:
            rows = rows.withColumn("around", F.transform(F.array_intersect("places", F.sequence(least, most)), lambda p: begin + p)).filter(F.size("around") > 0)
        return rows.drop("places", "low", "high", "cell")

    seconds = first.select(F.col("second").alias("term")).filter("term IS NOT NULL").distinct()
    rarer = lists.join(F.broadcast(seconds) if few_terms else seconds, "term", "left_semi")
    pairs = close(found.filter("second IS NOT NULL").withColumnRenamed("second", "term"), F.col("next"), rarer).select("window", "length", "first", "place")
    alone = found.filter("second IS NULL").select("window", "length", "first", "place")
    kept = written(pairs.union(alone).distinct())
    words = windows.select("window", F.posexplode("terms").alias("offset", "term"))
    every = close(kept.join(words, "window"), F.col("offset"), lists)
    right = F.when(F.array_contains("around", F.col("place") - F.col("first") + F.col("offset")), F.col("offset"))
    seen = every.groupBy("window", "length", "first", "place").agg(F.size(F.collect_set(right)).alias("right"), *([F.collect_list(F.struct("offset", "around")).alias("all")] if slop is not None else []))
    near = F.lit(False)
    if slop is not None:
        reach = F.col("length") + slop
        # a run that has all words can begin at a place of one of them, at the place found or up to a reach before it
        starts = F.array_distinct(F.flatten(F.transform("all", lambda x: F.filter(x["around"], lambda p: (p > F.col("place") - reach) & (p <= F.col("place"))))))
        complete = F.size(F.array_distinct(F.transform("all", lambda x: x["offset"]))) == F.col("length")
        has = lambda o, s: F.exists("all", lambda x: (x["offset"] == o) & F.exists(x["around"], lambda p: (p >= s) & (p < s + reach)))
        near = F.when(complete, F.exists(starts, lambda s: F.forall(F.sequence(F.lit(0), F.col("length") - 1), lambda o: has(o, s)))).otherwise(False)
    matches = seen.select("window", "place", (F.col("place") - F.col("first")).alias("start"), "length", (F.col("right") == F.col("length")).alias("exact"), near.alias("near"))
    return matches.filter("exact OR near")


def _with_texts(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with the base of the text that each lies in. The texts and matches of a run of places are read in order."""
    run = lambda c: F.shiftright(c, RUN_BITS)
    texts = index.filter("term IS NULL").select("base", F.explode(F.sequence(run(F.col("base")), run(F.col("base") + F.greatest(F.col("n_words"), F.lit(1)) - 1))).alias("block"))
    texts = texts.select("base", "block", F.greatest("base", F.shiftleft("block", RUN_BITS)).alias("at"))  # a long text is in several
    places = matches.withColumnRenamed("place", "at").withColumn("block", run(F.col("at")))
    both = texts.join(places.select("block").distinct(), "block", "left_semi").unionByName(places, allowMissingColumns=True)
    before = Window.partitionBy("block").orderBy("at", F.col("window").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("base", F.last("base", ignorenulls=True).over(before)).filter("window IS NOT NULL").drop("block", "at")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, width: int = WINDOW, slop: int | None = SLOP, vocabulary_bytes: int = VOCABULARY_BYTES, cell_bits: int = CELL_BITS, block_bytes: int = BLOCK_BYTES, passing: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (word positions [start, end) that are hit), items, near_items (both in order as text).

    With ``passing``, each column c of it is returned as keep_c, and ``n_words`` is not: texts
    without a match are then neither moved nor joined with the index, if Spark can broadcast the others.
    """
    if 2 * (width + (slop or 0)) > min(GAP, 1 << cell_bits) or cell_bits > RUN_BITS:
        raise ValueError("width and slop reach too far for the gap between texts, or for cells")
    windows, owners = benchmark_windows(benchmark, item_col, item_text_col, width)
    vocabulary = vocabulary_hashes(windows, vocabulary_bytes)
    index = build_index(docs, id_col, text_col, vocabulary, cell_bits=cell_bits, block_bytes=block_bytes)
    matches = written(_with_texts(index, written(search_index(index, windows, slop, cell_bits=cell_bits, few_terms=vocabulary is not None))))

    own = Window.partitionBy("base").orderBy("start", "end")
    start = F.col("start") - F.col("base")
    hits = matches.filter("exact").select("base", start.alias("start"), (start + F.col("length")).alias("end")).distinct()
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("base", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = matches.select("base", "window", "exact", "near").distinct().join(owners.filter("item IS NOT NULL"), "window")
    listed = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("item")))).alias(c)
    items = named.groupBy("base").agg(listed("exact"), listed("near")).toDF("base", "items", "near_items")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    answers = [none("spans", "array<struct<start:bigint,end:bigint>>"), none("items", "array<string>"), none("near_items", "array<string>")]
    texts = index.filter("term IS NULL").select("base", "doc_id", "print", "n_words")
    if passing is None:
        return texts.join(spans, "base", "left").join(items, "base", "left").select("doc_id", "n_words", *answers)
    found = texts.join(matches.select("base").distinct(), "base").join(spans, "base", "left").join(items, "base", "left")
    found = found.dropDuplicates(["doc_id", "print"]).select("doc_id", "print", "spans", "items", "near_items")
    rows = docs.select(docs[id_col].alias("own_id"), F.xxhash64(text_or_empty(text_col)).alias("own_print"), *(docs[c].alias(f"keep_{c}") for c in passing))
    rows = rows.join(found, rows["own_id"].eqNullSafe(found["doc_id"]) & (rows["own_print"] == found["print"]), "left")
    return rows.select(F.col("own_id").alias("doc_id"), *answers, *(f"keep_{c}" for c in passing))
