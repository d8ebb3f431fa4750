"""Conversation prefix trie with count-min screening of prefix digests.

Conversations that begin with the same turns share trie nodes. Turns become narrow
rows first: a digest of role and text, and a length; texts are never shuffled.
Rows are sorted in ranges by conversation and place, so that a very long conversation
spans several tasks; each task continues a digest of all turns so far, an
exponential sum modulo a prime of 127 bits, which can be continued across a border afterwards
from one row of each task.

A count-min sketch of all prefixes' digests then screens them. Its cells never count
too little, so an estimate of one proves that a single conversation has the prefix: its
node is finished on the spot, and so is every tail under it. Only prefixes that the sketch leaves
in doubt are shuffled, grouped by digest and counted exactly. The sketch holds at most SKETCH_CELLS
cells; a table with more prefixes shuffles more of them, with the same result.

Sums over subtrees need no walk down the trie. A node belongs to its least member; the nodes that a
conversation owns are a tail of its path. So a conversation adds to each node above what it owns the turns it
repeats from there, and one leaf if its end is a childless node of its own: two joins, however deep
the trie is. Lists of a node's ending conversations are hashed from sorted chunks, in one pass without holding
them; hashing one list is sequential by nature, so a task does that for packed chunks, not rows.

Turns are ordered by ``turn``, null first, then by their digest. Null roles and texts are empty. Rows without a
conversation identifier belong to none and are left out. A table without rows has no nodes, not even a
root. Repeated rows are turns of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_or_empty, written

PRIME, BASE, START = (1 << 127) - 1, 0x5D3C9E1B7A4F60825B1E97C3D4A86F13, 1
#: Rows of the sketch, cells of all rows at most (one byte each), cells of one part of it, and conversation identifiers of one chunk.
ROWS, SKETCH_CELLS, PART, CHUNK = 4, 1 << 26, 1 << 16, 1 << 15

_PATHS = "task int, conv long, depth long, key binary, digest binary, parent binary, chars long, before long, last boolean, first long, edge boolean"


def _packed(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turn_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, chars): the digest and the length of each turn."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))
    return df.filter(df[conv_col].isNotNull()).select(df[conv_col].cast("long").alias("conv"), df[turn_col].alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))


def paths(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row of (conv, *order, key, chars) with its depth in its conversation, the digests of the prefix that it ends and of the one
    before, the characters before it, and whether it is the last. A row without a key is the conversation's root, of depth 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, first = TaskContext.get().partitionId(), None, None
        conv = depth = digest = before = None
        for batch in batches:
            out = [held] if held else []
            for c, key, chars in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != conv:
                    if first is None:
                        first = c
                    if out:
                        out[-1][8] = True
                    conv, depth, digest, before = c, 0, START, 0
                parent = None
                if key is not None:
                    parent, depth = _packed(digest), depth + 1
                    digest = (digest * BASE + int.from_bytes(key[:15], "big")) % PRIME
                out.append([task, c, depth, key, _packed(digest), parent, chars, before, False, None, False])
                before += chars
            if out:
                held = out.pop()
            if out:
                yield table(out)
        if held:
            held[9:] = [first, True]
            yield table([held])

    def table(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PATHS.split(", ")])

    dealt = rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    local = written(dealt.select("conv", "key", "chars").mapInArrow(scan, _PATHS))
    carry, ended = _carried(local)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            task, conv = columns["task"].to_numpy(), columns["conv"].to_numpy()
            last = columns["last"].to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(columns["edge"].to_numpy(zero_copy_only=False)).tolist():
                last[i] = int(task[i]) in ended
            todo = [i for t in set(task.tolist()) & carry.keys() for i in np.flatnonzero((task == t) & (conv == carry[t][0])).tolist()]
            if todo:
                depth, before = columns["depth"].to_numpy().copy(), columns["before"].to_numpy().copy()
                digest, parent = columns["digest"].to_pylist(), columns["parent"].to_pylist()
                for i in todo:
                    _, n, start, chars = carry[int(task[i])]
                    digest[i] = _packed(_continued(start, digest[i], int(depth[i])))
                    parent[i] = _packed(_continued(start, parent[i], int(depth[i]) - 1))
                    depth[i] += n
                    before[i] += chars
                columns |= {"depth": pa.array(depth), "before": pa.array(before), "digest": pa.array(digest, pa.binary()), "parent": pa.array(parent, pa.binary())}
            columns["last"] = pa.array(last)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    kept = [c for c in _PATHS.split(", ") if c.split()[0] not in ("task", "first", "edge")]
    names = [c.split()[0] for c in kept]
    return local.mapInArrow(finish, ", ".join(kept))


def _continued(start: int, digest: bytes, depth: int) -> int:
    """The digest of ``depth`` turns that were summed from START, as it is if they follow turns of digest ``start``."""
    return (int.from_bytes(digest, "big") + (start - START) * pow(BASE, depth, PRIME)) % PRIME


def _carried(local: DataFrame) -> tuple[dict[int, tuple[int, int, int, int]], set[int]]:
    """From one row of each task: by task the state (conv, depth, digest, characters) of the conversation that goes on in it, and the tasks at whose end a conversation ends."""
    edges = sorted(tuple(r) for r in local.filter("edge").select("task", "first", "conv", "depth", "digest", "before", "chars").collect())
    carry, ended, open_state = {}, set(), None
    for k, (task, first, conv, depth, digest, before, chars) in enumerate(edges):
        if open_state and open_state[0] == first:
            carry[task] = open_state
        n, start, sofar = carry[task][1:] if task in carry and conv == first else (0, START, 0)
        open_state = conv, n + depth, _continued(start, digest, depth), sofar + before + chars
        if k + 1 == len(edges) or edges[k + 1][1] != conv:
            ended.add(task)
    return carry, ended


def _cells(digests: pa.Array, width: int) -> np.ndarray:
    """Of each digest its cell in each row of the sketch."""
    words = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u4").reshape(-1, 4).astype(np.int64)
    return (words[:, :ROWS] & (width - 1)) + width * np.arange(ROWS)


def count_min(digests: DataFrame, cells: int = SKETCH_CELLS) -> np.ndarray:
    """A count-min sketch of the column ``digest`` whose cells stop at two. Tasks hand on the cells they have met, by part; parts are added up in tasks."""
    n = max(1, digests.count())
    width = 1 << min(max(10, (4 * n - 1).bit_length()), max(10, (cells // ROWS).bit_length() - 1))
    part = min(PART, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(ROWS * width, dtype=np.uint8)
        for batch in batches:
            cell, times = np.unique(_cells(batch.column(0), width), return_counts=True)
            met[cell] = np.minimum(met[cell] + np.minimum(times, 2), 2)
        for at in range(0, len(met), part):
            if (found := np.flatnonzero(met[at : at + part])).size:
                yield pa.RecordBatch.from_arrays([pa.array([at // part], pa.int32()), pa.array([(found * 2 + met[at + found] - 1).astype("<u4").tobytes()])], names=["part", "met"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(part, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(np.stack((total > 0, total > 1)), axis=1).tobytes()])], names=["part", "met"])

        for batch in batches:
            for p, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != at:
                    if at is not None:
                        yield done()
                    at, total = p, np.zeros(part, dtype=np.uint8)
                found = np.frombuffer(met, dtype="<u4")
                total[found >> 1] = np.minimum(total[found >> 1] + (found & 1) + 1, 2)
        if at is not None:
            yield done()

    parts = digests.select("digest").mapInArrow(count, "part int, met binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, met binary")
    sketch = np.zeros(ROWS * width, dtype=np.uint8)
    for r in parts.toLocalIterator():
        one, two = np.unpackbits(np.frombuffer(r["met"], dtype=np.uint8).reshape(2, -1), axis=1)[:, :part]
        sketch[r["part"] * part : (r["part"] + 1) * part] = one + two
    return sketch


def screened(prefixes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``prefixes`` (conv, depth, digest, parent, chars, before, last) with ``one`` and ``parent_one``: the sketch proves that no other conversation has the prefix, or the one before it."""
    width, sent = len(sketch) // ROWS, prefixes.sparkSession.sparkContext.broadcast(sketch)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for name in ("digest", "parent"):
                digests = batch.column(name)
                real = digests.is_valid().to_numpy(zero_copy_only=False)
                one = np.zeros(len(real), dtype=bool)
                one[real] = (sent.value[_cells(digests.drop_null(), width)] < 2).any(axis=1)
                flags.append(pa.array(one))
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "one", "parent_one"])

    rows = prefixes.select("conv", "depth", "digest", "parent", "chars", "before", "last")
    return rows.mapInArrow(judge, "conv long, depth long, digest binary, parent binary, chars long, before long, last boolean, one boolean, parent_one boolean")


def list_digests(members: DataFrame) -> DataFrame:
    """(digest, conv) to (digest, ends_sha256): SHA-256 of each digest's identifiers, ascending, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["digest", "low", "said"])

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (digest != at or len(held) == CHUNK):
                    yield chunk()
                    held = []
                at = digest
                held.append(conv)
        if held:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])
        for batch in small_batches(batches):
            for digest, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != at:
                    if sha:
                        yield done()
                    at, sha = digest, hashlib.sha256()
                    sha.update(said.encode())
                else:
                    sha.update(f",{said}".encode())
        if sha:
            yield done()

    chunks = members.select("digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(pack, "digest binary, low long, said string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "low").select("digest", "said").mapInArrow(hashed, "digest binary, ends_sha256 string")


def with_heads(df: DataFrame, source: Column, length: Column, most: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, place, key, chars) of conversations whose first ``length`` turns (``most`` at most) are those of the conversation ``source``;
    both are columns of ``conv``. Each conversation also has a row of place 0 without a key."""
    turns = paths(turn_rows(df, conv_col, turn_col, role_col, text_col), ["turn", "key"]).select("conv", F.col("depth").alias("place"), "key", "chars")
    own = turns.filter(F.col("place") > length)
    convs = turns.filter("place = 1").select("conv")
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv", "source")
    led = convs.withColumns({"source": source, "length": length}).filter("length > 0").join(heads, "source").filter(F.col("place") <= F.col("length")).select("conv", "place", "key", "chars")
    roots = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(led).unionByName(roots)


def rooted_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows for ``prefix_trie`` of conversations as they are."""
    return with_heads(df, F.col("conv"), F.lit(0), 0, conv_col, turn_col, role_col, text_col)


def prefix_trie(rows: DataFrame, *, sketch_cells: int = SKETCH_CELLS) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv, place, key, chars): digest, conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = written(paths(rows, ["place"]).drop("key"))
    judged = screened(prefixes, count_min(prefixes, sketch_cells))
    tails = judged.filter("one")
    shared = written(judged.filter("NOT one").drop("one", "parent_one"))

    ends = F.when(F.col("last"), F.col("conv"))
    groups = shared.groupBy("digest").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(ends).alias("n_ends"), F.min(ends).alias("end"))
    groups = written(groups)
    children = groups.select(F.col("parent").alias("digest")).union(tails.filter("NOT parent_one").select("parent")).filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n_children"))
    children = written(children)

    # of each conversation: the characters of the turns whose nodes others own, and whether its end is a leaf of its own
    owners = written(groups.select("digest", "conv_id", "n_ends").join(children, "digest", "left").select("digest", "conv_id", "n_ends", F.col("n_children").isNull().alias("childless")))
    placed = shared.join(owners, "digest")
    mine = F.col("conv") == F.col("conv_id")
    told = placed.groupBy("conv").agg(F.sum(F.when(~mine, F.col("chars")).otherwise(0)).alias("repeated"), F.max(F.when(F.col("last"), mine & F.col("childless"))).alias("leaf"))
    told = written(told.select("conv", "repeated", F.coalesce("leaf", F.lit(True)).alias("leaf")))  # else its end is in a tail
    sums = shared.join(told, "conv").groupBy("digest").agg(F.sum(F.greatest(F.lit(0), F.col("repeated") - F.col("before"))).alias("saved_tokens"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"))
    many = list_digests(shared.filter("last").join(owners.filter("n_ends > 1").select("digest"), "digest", "left_semi"))

    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    whole = groups.join(children, "digest", "left").join(sums, "digest").join(many, "digest", "left")
    whole = whole.select("digest", "conv_id", "depth", "parent", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", sha(F.coalesce(F.col("end").cast("string"), F.lit("")))).alias("ends_sha256"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ended = sha(F.when(F.col("last"), F.col("conv").cast("string")).otherwise(""))
    single = tails.select("digest", F.col("conv").alias("conv_id"), "depth", F.when(~F.col("parent_one"), F.col("parent")).alias("parent"), F.when(F.col("parent_one"), F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ended.alias("ends_sha256"))
    asked = whole.filter("parent IS NOT NULL").unionByName(single.filter("parent IS NOT NULL")).drop("parent_conv_id")
    known = groups.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rest = whole.filter("parent IS NULL").unionByName(single.filter("parent IS NULL"))
    # a parent outside the groups was proved to be of one conversation, so its child, in doubt or not, is of the same one
    asked = asked.join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return asked.unionByName(rest).drop("parent")
