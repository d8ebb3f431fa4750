"""Similarity self-join on word n-grams: a MinHash LSH forest, then exact Jaccard.

Each text is the set of its 5-word shingles (64-bit hashes); texts with equal
sets are one class of copies. A class has one MinHash signature for each of
``trees`` tries. A signature's prefixes, from the shortest that could be needed
to ``depth`` values, are the nodes that it lies under.

Each class looks for its partners from the longest prefixes upwards. A prefix of
k values in one trie meets a partner at the threshold t with probability t**k, so
lengths k1, k2, ... in the tries meet it with 1 - (1 - t**k1)(1 - t**k2)...; as
long as that is under ``recall``, the class shortens one prefix by a value: the
one whose shorter node has the fewest members (by power of two), so that it asks
in sparse nodes before crowded ones. The lengths follow from how the corpus fills
the tries, and every class reaches the recall by its own lookups alone. A
pair is met in a trie if it shares the shorter of its two prefixes there; one met
in several tries is counted in the first only.

All pairs of a node of which one asks there are verified exactly, inside tasks,
by counting shared shingles block against block. A crowded node (``BALL`` members
or more) offers its least member as a centre, and each class takes the least one
offered to it. Classes within half of the allowed distance of one centre form a
ball: as Jaccard distance is a metric, all pairs of a ball are links, which are
counted from its size and never compared. So a large group of very near copies
costs as much as it has members.

What leaves a node is linear in it: how many links each member has, and a star
that connects its linked members. A node over ``BLOCK_ROWS`` members or
``BLOCK_BYTES`` of shingles is cut into chunks, large balls apart, and each pair
of chunks (but two of one ball) is a task of its own, so no task holds a whole
large node. Nodes where the same members ask are not shipped again.

Only members of nodes are read a second time: a bitmap of their hashed
identifiers, of at most FILTER_BITS, spares all other texts the shuffle; with
more members than it can tell apart, a semi-join does.

Texts without words have no links and are their own class. Texts of fewer than
five words, but not none, are one shingle of all their words. Nulls count as
empty. An identifier names one text; its
repeated rows are copies. Each row with a null identifier is a text of its own,
which links and copies like any other; only where all members have none is a
class's or copies' least identifier null. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_batches, small_batches, text_or_empty, written
from .words import blocks, mix, utf8

WIDTH, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 12, 5, 0.999
BLOCK_ROWS, BLOCK_BYTES, FILTER_BITS, BALL = 256, 8 << 20, 1 << 25, 64


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The length to which prefixes are shortened at most: at it, all tries together reach ``recall`` whatever the data."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def shortened(sizes: np.ndarray, shortest: int, threshold: float, recall: float) -> np.ndarray:
    """Of each class and trie, how much longer than the shortest its prefix stays; ``sizes``: members of its nodes (class, trie, length)."""
    n, trees, lengths = sizes.shape
    evidence = -np.log1p(-(threshold ** np.arange(shortest, shortest + lengths)))
    needed = -math.log(1 - recall) - 1e-9
    crowd = np.floor(np.log2(sizes))
    kept, have = np.full((n, trees), lengths - 1), np.full(n, trees * evidence[-1])
    while len(rows := np.flatnonzero(have < needed)):
        own = kept[rows]
        shorter = np.take_along_axis(crowd[rows], np.maximum(own - 1, 0)[..., None], axis=2)[..., 0]
        tree = np.where(own > 0, shorter, np.inf).argmin(axis=1)
        length = own[np.arange(len(rows)), tree]
        have[rows] += evidence[length - 1] - evidence[length]
        kept[rows, tree] -= 1
    return kept


def prefix_keys(hashes: np.ndarray, at: np.ndarray, seeds: np.ndarray, shortest: int) -> np.ndarray:
    """Hashes of the prefixes of each set's signatures, of ``shortest`` values up to all in ``seeds``: (set, trie, length). Sets begin at ``at``."""
    trees, depth, _ = seeds.shape
    keys = np.zeros((len(at), trees, depth - shortest + 1), dtype=np.uint64)
    for t in range(trees):
        key = np.full(len(at), t + 1, dtype=np.uint64)
        for k, (add, times) in enumerate(seeds[t], 1):
            # the order of (h ^ a) * b, high bits first, stands for a random permutation
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ add) * times, at))
            if k >= shortest:
                keys[:, t, k - shortest] = key
    return keys


def _seeds(trees: int, depth: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, (trees, depth, 2), dtype=np.uint64) | np.uint64(1)


def _lists(keys: np.ndarray) -> pa.ListArray:
    flat = keys.reshape(len(keys), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], type=pa.int32()), pa.array(flat.ravel()))


def text_shingles(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block, sorted, and where each text's begin (with the end)."""
    hashes, owner = block.shingle_hashes(width)
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(block.n_texts + 1))


def signatures(df: DataFrame, seeds: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, shortest: int) -> DataFrame:
    """doc_id, n (distinct shingles), two fingerprints of the set, and for each trie the hash of its shortest prefix; null if the text has no words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_out, a_out, b_out, keys_out = [], [], [], []
            for _, block in blocks(utf8(batch.column(1))):
                hashes, cut = text_shingles(block, width)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                keys = np.zeros((block.n_texts, len(seeds)), dtype=np.uint64)
                prints = np.zeros((2, block.n_texts), dtype=np.uint64)
                if len(full):
                    at = cut[:-1][full]
                    prints[0, full] = np.add.reduceat(mix(hashes), at)
                    prints[1, full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(0x5851F42D4C957F2D)), at)
                    keys[full] = prefix_keys(hashes, at, seeds[:, :shortest], shortest)[:, :, 0]
                n_out.append(n)
                a_out.append(prints[0].view(np.int64))
                b_out.append(prints[1].view(np.int64))
                keys_out.append(keys.view(np.int64))
            n = np.concatenate(n_out)
            none = n == 0
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(a_out), mask=none), pa.array(np.concatenate(b_out), mask=none), _lists(np.concatenate(keys_out))],
                names=["doc_id", "n", "print_a", "print_b", "keys"],
            )

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, n long, print_a long, print_b long, keys array<long>")


def _bitmap(chosen: DataFrame) -> np.ndarray | None:
    """A bit for each hashed identifier in ``chosen``, at most FILTER_BITS / 8 bytes; None if that is too few to tell rows apart."""
    n = chosen.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    if n > bits // 4:
        return None
    bit = chosen.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def shingle_sets(df: DataFrame, seeds: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, shortest: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """The identifier, the set's first fingerprint and size, its prefixes' hashes (by trie, then length), and its sorted distinct shingles as packed 64-bit integers; only for rows whose bit is set, if there is a bitmap, and only for texts with words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if bitmap is not None:
                bit = batch.column(2).to_numpy() % (64 * len(bitmap))
                batch = batch.filter(pa.array((bitmap[bit // 64] >> (bit % 64)) & 1 == 1))
            prints, sizes, keys, packed, rows = [], [], [], [], []
            for first, block in blocks(utf8(batch.column(1))):
                hashes, cut = text_shingles(block, width)
                full = np.flatnonzero(np.diff(cut))
                if not len(full):
                    continue
                at = cut[:-1][full]
                prints.append(np.add.reduceat(mix(hashes), at).view(np.int64))
                sizes.append(np.diff(cut)[full])
                keys.append(prefix_keys(hashes, at, seeds, shortest).view(np.int64))
                packed += [hashes[cut[k] : cut[k + 1]].tobytes() for k in full]
                rows.append(first + full)
            if not rows:
                return None
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(prints)), pa.array(np.concatenate(sizes), pa.int64()), _lists(np.concatenate(keys)), pa.array(packed, pa.binary())], names=[id_col, "print_a", "n", "keys", "shingles"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_or_empty(text_col).alias("text"), *([F.xxhash64(id_col).alias("hash")] if bitmap is not None else []))
    return map_batches(rows, make, f"{id_col} {kind}, print_a long, n long, keys array<long>, shingles binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right`` (with each of ``left`` if None)."""
    sets = left if right is None else left + right
    if len(sets) == 2:
        a, b = sets
        both = np.concatenate((a, b))
        both.sort()
        k = int((both[1:] == both[:-1]).sum())
        return np.array([[len(a), k], [k, len(b)]]) if right is None else np.array([[k]])
    sizes = [len(x) for x in sets]
    values, element = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(element, minlength=len(values))
    column = np.cumsum(times > 1) - 1
    shared = times[element] > 1
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    column = column[element[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    m, n = len(left), len(sets)
    counts = np.zeros((m, m if right is None else n - m), dtype=np.float32)  # exact below 2**24 per slab
    total = np.zeros(counts.shape, dtype=np.int64)
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        slab = np.zeros((n, min(4096, last - lo)), dtype=np.float32)
        slab[row[a:b], column[a:b] - lo] = 1
        np.matmul(slab[:m], (slab[:m] if right is None else slab[m:]).T, out=counts)
        total += counts.astype(np.int64)
    if right is None:
        np.fill_diagonal(total, sizes)
    return total


def _links(tree: int, length: int, threshold: float, left: list[tuple], right: list[tuple] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of linked pairs that are met here and in no earlier trie, and not of one ball. A member is (id, keys by trie and length, kept lengths, ball, set)."""
    other = left if right is None else right
    shared = shared_counts([x[4] for x in left], None if right is None else [x[4] for x in right])
    n, m = np.array([len(x[4]) for x in left]), np.array([len(x[4]) for x in other])
    linked = shared >= threshold * (n[:, None] + m[None, :] - shared) - 1e-9
    if right is None:
        linked &= np.tri(len(left), k=-1, dtype=bool).T
    balls, theirs = np.array([x[3] for x in left], dtype=object), np.array([x[3] for x in other], dtype=object)
    if any(b is not None for b in balls) and any(b is not None for b in theirs):
        numbers = {b: k for k, b in enumerate({*balls, *theirs} - {None})}
        a, b = np.array([numbers.get(x, -1) for x in balls]), np.array([numbers.get(x, -2) for x in theirs])
        linked &= a[:, None] != b[None, :]
    i, j = np.nonzero(linked)
    if len(i):
        mine, their = np.array([x[2] for x in left])[i], np.array([x[2] for x in other])[j]
        both = np.minimum(mine, their)
        keys, others = np.array([x[1] for x in left])[i], np.array([x[1] for x in other])[j]
        new = both[:, tree] == length
        rows = np.arange(len(i))
        for t in range(tree):
            new &= keys[rows, t, both[:, t]] != others[rows, t, both[:, t]]
        i, j = i[new], j[new]
    return i, j


def _star(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` members the least member that links connect it with."""
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(threshold: float, trees: int, lengths: int):
    """An Arrow pass over rows sorted by (node, chunk pair): a row for each linked member, with its number of new links and its star's centre."""

    def group(at: int, same: bool, rows: list[tuple]) -> list[tuple]:
        left, right = (rows, None) if same else ([x for x in rows if x[5]], [x for x in rows if not x[5]])
        if not left or right == []:
            return []
        members = left + (right or [])
        i, j = _links(at // lengths, at % lengths, threshold, left, right)
        if not len(i):
            return []
        j = j if same else j + len(left)
        degree = np.bincount(i, minlength=len(members)) + np.bincount(j, minlength=len(members))
        centre = _star(len(members), i, j)
        return [(members[k][0], int(degree[k]), members[centre[k]][0]) for k in np.flatnonzero(degree)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, kind = None, [], [], None

        def flush():
            if key is not None and len(rows) > 1:
                out.extend(group(key[0], key[2] == key[3], rows))

        for batch in small_batches(batches):
            kind = batch.column(0).type
            for rep, at, node, lo, hi, mine, ball, keys, kept, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (at, node, lo, hi):
                    flush()
                    key, rows = (at, node, lo, hi), []
                rows.append((rep, np.array(keys).reshape(trees, lengths), np.array(kept), ball, np.frombuffer(packed, dtype=np.uint64), mine == lo))
            if len(out) > 10_000:
                yield _linked(out, kind)
                out = []
        flush()
        if out:
            yield _linked(out, kind)

    def _linked(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        rep, degree, centre = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(rep, kind), pa.array(degree, pa.int64()), pa.array(centre, kind)], names=["rep", "degree", "centre"])

    return run


def _kept_lengths(sets: DataFrame, shortest: int, trees: int, lengths: int, threshold: float, recall: float) -> DataFrame:
    """rep, n, keys, and of each trie how much longer than the shortest the prefix stays."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, trees, lengths)
            kept = shortened(sizes, shortest, threshold, recall)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(kept.astype(np.int32))], names=["rep", "n", "keys", "kept"])

        return step

    under = sets.select("rep", "n", F.posexplode("keys").alias("at", "node"))
    crowds = under.groupBy("at", "node").agg(F.count("*").alias("size")).filter("size > 1")
    own = F.array_sort(F.collect_list(F.struct("at", "node", F.coalesce("size", F.lit(1)).alias("size"))))  # trees * lengths values
    seen = under.join(crowds, ["at", "node"], "left").groupBy("rep", "n").agg(own.alias("own"))
    kind = sets.schema["rep"].dataType.simpleString()
    return map_batches(seen.select("rep", "n", F.col("own.node").alias("keys"), F.col("own.size").alias("size")), make, f"rep {kind}, n long, keys array<long>, kept array<int>")


def _balls(sets: DataFrame, offers: DataFrame, threshold: float) -> DataFrame:
    """(rep, ball) of classes within half of the allowed distance of the least centre in ``offers`` (rep, centre). Centres are copied once for each BLOCK_ROWS classes."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = []
            for mine, centre in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(mine, dtype=np.uint64), np.frombuffer(centre, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(2 * (len(a) + len(b) - 2 * both) <= (1 - threshold - 1e-12) * (len(a) + len(b) - both))
            return pa.RecordBatch.from_arrays(batch.columns[:2], names=["rep", "ball"]).filter(pa.array(near))

        return step

    least = offers.groupBy("rep").agg(F.min("centre").alias("centre"))
    copies = least.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("copies"))
    centres = copies.join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("middle")), "centre")
    centres = centres.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asked = least.join(copies, "centre").withColumn("copy", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int")).drop("copies")
    rows = asked.join(sets.select("rep", "shingles"), "rep").join(centres, ["centre", "copy"]).select("rep", "centre", "shingles", "middle")
    kind = sets.schema["rep"].dataType.simpleString()
    return map_batches(rows, make, f"rep {kind}, ball {kind}")


def _chunked(under: DataFrame) -> DataFrame:
    """Rows (rep, n, at, node, ball) dealt to the chunk pairs of their nodes: at, node, rep, ball, lo, hi, mine. A ball of half a block or more has chunks of its own, and no pairs of them."""
    node = Window.partitionBy("at", "node")
    tally = under.groupBy("at", "node", "ball").agg(F.count("*").alias("m"), F.sum("n").alias("load"))
    small = F.sum("m").over(node) <= BLOCK_ROWS
    tally = tally.withColumn("own", ~small & F.col("ball").isNotNull() & (F.col("m") >= BLOCK_ROWS // 2))
    tally = tally.withColumns({c: F.when(F.col("own"), F.col(c)).otherwise(F.sum(F.when(~F.col("own"), F.col(c))).over(node)) for c in ("m", "load")})
    tally = tally.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("load") * 8 / BLOCK_BYTES)).cast("int"))
    mixed = F.coalesce(F.max(F.when(~F.col("own"), F.col("chunks"))).over(node), F.lit(0))
    before = F.coalesce(F.sum(F.when(F.col("own"), F.col("chunks"))).over(node.orderBy(F.col("own"), "ball").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = mixed + F.coalesce(F.sum(F.when(F.col("own"), F.col("chunks"))).over(node), F.lit(0))
    tally = tally.select("at", "node", F.col("ball").alias("of"), "own", "chunks", F.when(F.col("own"), mixed + before).otherwise(F.lit(0)).cast("int").alias("first"), total.cast("int").alias("total"))
    u, t = under.alias("u"), tally.alias("t")
    placed = u.join(t, (F.col("u.at") == F.col("t.at")) & (F.col("u.node") == F.col("t.node")) & F.col("u.ball").eqNullSafe(F.col("t.of")))
    placed = placed.select("u.*", "own", "first", "chunks", "total", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("chunks"))).cast("int").alias("mine"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda j: ~F.col("own") | (j < F.col("first")) | (j >= F.col("first") + F.col("chunks")))
    placed = placed.withColumn("other", F.explode(others))
    return placed.select("at", "node", "rep", "ball", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")


def keyed_rows(df: DataFrame, id_col: str) -> DataFrame | None:
    """``df``, written, with a text ``row_key``: of the identifier, or of the row where that is null; None if no identifier is null."""
    if df.filter(df[id_col].isNull()).isEmpty():
        return None
    own = F.concat(F.lit("="), df[id_col].cast("string"))
    return written(df.withColumn("row_key", F.coalesce(own, F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")))))


def least_members(keyed: DataFrame, id_col: str, found: DataFrame, group: str) -> DataFrame:
    """Of each ``group`` of a join by ``row_key`` its least identifier (nulls last) and that row's key: group, least_id, least_key."""
    ids = keyed.select(F.col("row_key"), F.col(id_col).alias("own_id")).distinct()
    members = found.select(F.col("doc_id").alias("row_key"), group).distinct().join(ids, "row_key")
    least = F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "row_key")).alias("least")
    return members.groupBy(group).agg(least).select(group, F.col("least.own_id").alias("least_id"), F.col("least.row_key").alias("least_key"))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links, copy_id, n_copies, n_shingles.

    ``copy_id`` is the least identifier with the same set of shingles and
    ``n_copies`` how many rows have it; ``n_links`` counts the other sets at the
    threshold or above; ``class_id`` is the least identifier that links and
    copies connect the row with.
    """
    keyed = keyed_rows(df.select(df[id_col].alias("own_id"), df[text_col].alias("text")), "own_id")
    if keyed is not None:
        found = written(ngram_join(keyed, "row_key", "text", width=width, threshold=threshold, trees=trees, depth=depth, recall=recall))
        ids = keyed.select(F.col("row_key").alias("doc_id"), F.col("own_id")).distinct()
        classes = least_members(keyed, "own_id", found, "class_id").select("class_id", F.col("least_id").alias("class_least"))
        same = least_members(keyed, "own_id", found, "copy_id").select("copy_id", F.col("least_id").alias("copy_least"))
        found = found.join(ids, "doc_id").join(classes, "class_id").join(same, "copy_id")
        return found.select(F.col("own_id").alias("doc_id"), F.col("class_least").alias("class_id"), "n_links", F.col("copy_least").alias("copy_id"), "n_copies", "n_shingles")
    shortest = shortest_prefix(threshold, trees, depth, recall)
    lengths, seeds = depth - shortest + 1, _seeds(trees, depth)
    docs = written(signatures(df, seeds, id_col, text_col, width=width, shortest=shortest))
    copies = ["n", "print_a", "print_b"]
    # copies are merged in each task before the shuffle; equal sets have equal keys
    reps = written(docs.filter("n > 0").groupBy(*copies).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min("keys").alias("keys")))

    # classes that share a shortest prefix with another; all others have no partner that any longer one could meet
    forest = reps.select("rep", F.posexplode("keys").alias("tree", "node"))
    shared = forest.groupBy("tree", "node").agg(F.count("*").alias("size")).filter("size > 1").select("tree", "node")
    chosen = written(forest.join(shared, ["tree", "node"], "left_semi").select("rep").distinct())
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("rep"), F.col(text_col).alias("text"))
    bits = _bitmap(chosen)
    if bits is None:
        texts = texts.join(chosen, "rep", "left_semi")
    found = shingle_sets(texts, seeds, "rep", width=width, shortest=shortest, bitmap=bits)
    found = found.join(chosen.join(reps.select("rep", "print_a"), "rep"), ["rep", "print_a"])
    sets = written(found.dropDuplicates(["rep"]).select("rep", "n", "keys", "shingles"))

    lookups = written(_kept_lengths(sets.drop("shingles"), shortest, trees, lengths, threshold, recall))
    under = lookups.select("rep", "n", "kept", F.posexplode("keys").alias("at", "node")).withColumn("more", F.expr(f"kept[at div {lengths}] - at % {lengths}"))
    under = under.filter("more >= 0").select("rep", "n", "at", "node", (F.col("more") == 0).alias("asks"))
    own = F.xxhash64("rep", "asks")
    nodes = under.groupBy("at", "node").agg(F.count("*").alias("size"), F.min("rep").alias("centre"), F.count_if("asks").alias("asking"), F.sum(F.pmod(own, F.lit(1 << 40))).alias("sum"), F.bit_xor(own).alias("members"))
    nodes = nodes.filter("size > 1 AND asking > 0").groupBy("size", "sum", "members").agg(F.min(F.struct("at", "node", "centre")).alias("g"))  # the same members ask: the first trie's node stands for all
    members = written(under.join(nodes.select("g.*", "size"), ["at", "node"]).select("rep", "n", "at", "node", "size", "centre"))
    balls = _balls(sets, members.filter(F.col("size") >= BALL).select("rep", "centre"), threshold)
    sizes = balls.groupBy("ball").agg(F.count("*").alias("ball_size"))
    balls = written(balls.join(sizes, "ball").filter("ball_size > 1").select("rep", "ball", "ball_size"))
    dealt = _chunked(members.select("rep", "n", "at", "node").join(balls.select("rep", "ball"), "rep", "left"))
    dealt = dealt.join(lookups.select("rep", "keys", "kept").join(sets.select("rep", "shingles"), "rep"), "rep")
    dealt = dealt.select("rep", "at", "node", "lo", "hi", "mine", "ball", "keys", "kept", "shingles")
    pairs = ["at", "node", "lo", "hi"]
    verified = written(dealt.repartition(*pairs).sortWithinPartitions(*pairs, "rep").mapInArrow(_verify(threshold, trees, lengths), f"rep {kind}, degree long, centre {kind}"))
    degrees = verified.select("rep", "degree").union(balls.select("rep", F.col("ball_size") - 1)).groupBy("rep").agg(F.sum("degree").alias("n_links"))
    # a ball's members hang on the least of their part of it, and those on its least: no node of the graph has all of a large ball as neighbours
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("ball_size") / BLOCK_ROWS))
    hung = balls.select("rep", "ball", part.alias("part"))
    heads = hung.groupBy("ball", "part").agg(F.min("rep").alias("head"))
    edges = [verified.select(F.col("rep").alias("a"), F.col("centre").alias("b")), hung.join(heads, ["ball", "part"]).select("rep", "head"), heads.select("head", "ball")]
    classes = connected_components(edges[0].union(edges[1]).union(edges[2]))
    found = reps.join(degrees, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select(*copies, F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("rep").alias("copy_id"), "n_copies")
    out = docs.drop("keys").join(found, copies, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"))
