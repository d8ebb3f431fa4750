"""The prefix trie against SQL and a plain trie in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import op11_prefix_trie as trie
from quern.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(paths):
    """Nodes of {conv: [(role, text), ...]} by their prefixes."""
    nodes, members = {}, defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(p))
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        nodes[p] = (min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(str, nodes.values()))


def ordered(rows):
    """Paths of (conv, turn, role, text) rows without ties."""
    paths = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths[c].append((role or "", text or ""))
    return paths


def found(df):
    return sorted(str(tuple(r)) for r in df.select(COLUMNS).collect())


def random_rows(rng, convs=60, longest=7):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c * 37 - 500, t * 3 - 5 if t else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hí", None, "", "hi there"])))
    rng.shuffle(rows)
    return rows


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(map(str, con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_trie']})").fetchall()))
    assert found(QUERIES["op11_prefix_trie"](spark, sf_dir)) == want


@pytest.mark.parametrize("cells", [4, trie.SKETCH_CELLS])
def test_equals_a_plain_trie(spark, cells):
    """With a sketch of any size: the smaller it is, the more goes to exact grouping."""
    rows = random_rows(random.Random(cells))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.prefix_trie(trie.rooted_turns(df), sketch_cells=cells)) == plain(ordered(rows))


def test_prefixes_in_doubt_below_proved_ones(spark):
    """A sketch of middling size proves most prefixes and leaves children of proved ones in doubt: none is lost."""
    rows = [(c, t, "u", f"t{t % 2}" if c % 3 == 0 else f"{c}-{t}") for c in range(150) for t in range(1 + c % 4)]
    rows += [(c, 5 + t, "a", f"{c}:{t}") for c in range(0, 150, 3) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.prefix_trie(trie.rooted_turns(df), sketch_cells=1024)) == plain(ordered(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yy"])) for c in [0, 1, 5, 99, 100, 103, 107, 250, 251, -5, -150] for t in range(rng.randint(1, 7))]
    rows += [(c, 0, "u", "x") for c in range(350, 360)]
    own = ordered(rows)
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    source = {c: int(c - (abs(c) % 100) * (1 if c >= 0 else -1)) for c in own}
    want = plain({c: own.get(source[c], [])[: head[c]] + own[c][head[c] :] for c in own})
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == want
    assert any(not own.get(source[c], [])[: head[c]] + own[c][head[c] :] for c in own)  # a turnless one is among them


def test_long_and_equal_conversations_over_many_tasks(spark):
    """Conversations far longer than a task's range, one a copy of the other's beginning, and many equal ones."""
    rows = [(7, t, "u", f"t{t % 5}") for t in range(900)] + [(3, t, "u", f"t{t % 5}") for t in range(700)]
    rows += [(c, t, "u", "same") for c in range(100, 220) for t in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(trie.prefix_trie(trie.rooted_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    paths = ordered(rows)
    assert len(got) == 1 + 900 + 3
    d = len(paths[3])
    saved = sum(len(x[1]) for x in paths[3]) + 3 * 119 * 4
    none = hashlib.sha256(b"").hexdigest()
    assert str((3, 0, None, 122, 2, 2, saved, none)) in got
    assert str((3, d, 3, 2, 1, 1, 2, hashlib.sha256(b"3").hexdigest())) in got
    assert str((7, 900, 7, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())) in got
    assert str((100, 3, 100, 120, 0, 1, 119 * 4, hashlib.sha256(",".join(map(str, range(100, 220))).encode()).hexdigest())) in got


def test_lists_are_hashed_from_chunks(spark, monkeypatch):
    members = [(bytes([k]) * 16, c) for k in range(3) for c in range(-20, 40 * k)]
    random.Random(1).shuffle(members)
    monkeypatch.setattr(trie, "CHUNK", 7)
    got = {bytes(r[0]): r[1] for r in trie.list_digests(spark.createDataFrame(members, "digest binary, conv long")).collect()}
    assert got == {bytes([k]) * 16: hashlib.sha256(",".join(map(str, range(-20, 40 * k))).encode()).hexdigest() for k in range(3)}


def test_the_sketch_never_counts_too_little(spark):
    rng = random.Random(5)
    digests = [rng.randbytes(16) for _ in range(500)]
    rows = [(0, 1, d, None, 0, 0, False) for d in digests + digests[:200]]
    df = spark.createDataFrame(rows, "conv long, depth long, digest binary, parent binary, chars long, before long, last boolean")
    for cells in (4, 4096, 1 << 20):
        flagged = trie.screened(df, trie.count_min(df, cells)).filter("one").select("digest").collect()
        assert not {bytes(r[0]) for r in flagged} & set(digests[:200])
    assert len(flagged) > 250  # and a large one proves nearly all others


def test_ties_repeats_nulls_and_empty_tables(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (2, 0, "u", "a"), (None, 0, "u", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, depth string")
    got = found(trie.prefix_trie(trie.rooted_turns(df)))
    assert len(got) == 4 and all(f", {d}, " in got[d] and ", 2, " in got[d] for d in range(4))  # equal rows in any order: one path
    assert trie.prefix_trie(trie.rooted_turns(df.filter(F.lit(False)))).count() == 0
