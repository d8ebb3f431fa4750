r"""Transcript parsing into canonical chat turns.

A hidden Markov model has a state for each role. Each line of a transcript is an
observation: its speaker marker, if it has one (``User:``, ``### Assistant``,
``[system]``, ``<|user|>`` and the like, or a column of the caller's with the
speaker's name), how long the row's text is, whether it has several lines, and
whether it asks. At a row's first line and at a
marked line the speaker may change; elsewhere the same one goes on. Viterbi recovers the
most likely roles of a whole conversation, and each run of lines of one role in
a row is rendered as one canonical turn.

The tables of the model (who begins, who follows whom, which role has which kind
of row) can be learned from conversations whose roles are known: counts over at
most ``LEARN_ROWS`` rows of whole conversations in order of a hash, added to the
given tables as if those were ``PRIOR`` rows. The roles of the rows that are
parsed are never read.

A conversation may be of any length: its rows are range-partitioned and sorted
by their total order, and each partition's share of it (a part) is cut after
every ``SEGMENT`` rows or ``SEGMENT_CHARS`` characters, whatever their turn
numbers. A first pass gives for each segment the best score from each role before
it to each role at its end. These small tables are composed ``FAN`` at a time,
level by level, until each part has one; then roles are fixed level by level
downwards, and a last pass decodes each segment between its two roles. That is
exact Viterbi. No task holds more of a conversation than a segment's text, or
``FAN`` tables, or one table of each part.

A null text is one empty line. A null turn comes first. Rows of one turn are
taken in order of marker, then text (of texts with ``PREFIX`` equal characters,
their fingerprint); repeated rows are turns of their own. Rows
with a null conversation form one conversation. An unknown marker counts as
none. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

ROLES = ("system", "user", "assistant")
SEGMENT, SEGMENT_CHARS, FAN = 64, 1 << 20, 256
#: So many characters of a text are in the sampled splitters; rows with more in common are told apart by a fingerprint.
PREFIX = 256

#: Names that speakers go by.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "developer"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "student", "prompt"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "agent", "chatbot", "support"),
}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_MARK = re.compile(r"^\s*(?:#+\s*|[*_]+)?[\[(<]?\|?\s*(?:im_start\|>)?\s*([A-Za-z]+)\s*(?:\|>|[\])>])?(?:[*_]+)?\s*(:|：|$|(?<=[>\])]))\s*(?:[*_]+\s*)?")

#: Bounds of length classes; a row's kind is its class, whether it has several lines, and whether it asks.
LENGTHS = (40, 100, 200, 350, 600)
KINDS = 4 * (len(LENGTHS) + 1)
LEARN_ROWS, PRIOR = 20_000, 20
# log-probabilities: that a speaker goes on within a row, and of another role's marker in a line or in the marker column
STAY = np.log([[0.998, 0.001, 0.001], [0.001, 0.998, 0.001], [0.001, 0.001, 0.998]])
LINE_MARK, COLUMN_MARK = math.log(0.005), math.log(1e-6)

_BY_LENGTH = np.array([[0.15, 0.30, 0.25, 0.20, 0.08, 0.02], [0.20, 0.30, 0.22, 0.16, 0.08, 0.04], [0.05, 0.08, 0.10, 0.12, 0.20, 0.45]])
_BY_LINES = np.array([[0.7, 0.3], [0.55, 0.45], [0.25, 0.75]])
_BY_QUESTION = np.array([[0.98, 0.02], [0.75, 0.25], [0.92, 0.08]])


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the first speaker, of who follows whom, and of each role's kinds of rows."""

    start: np.ndarray
    follow: np.ndarray
    kinds: np.ndarray


GIVEN = Model(
    np.log([0.30, 0.65, 0.05]),
    np.log([[0.02, 0.93, 0.05], [0.02, 0.05, 0.93], [0.02, 0.93, 0.05]]),
    np.log((_BY_LENGTH[:, :, None, None] * _BY_LINES[:, None, :, None] * _BY_QUESTION[:, None, None, :]).reshape(3, KINDS)),
)


def row_kind(text: str) -> int:
    return 4 * sum(len(text) >= n for n in LENGTHS) + 2 * ("\n" in text) + ("?" in text)


def learn(df: DataFrame, learnable: Column, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role", *, most: int = LEARN_ROWS) -> Model:
    """The model from rows that are ``learnable`` and have a known role; the given one, if there are none."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    kind = sum((4 * (F.length(text) >= n).cast("int") for n in LENGTHS), F.lit(0)) + 2 * text.contains("\n").cast("int") + text.contains("?").cast("int")
    rows = df.filter(learnable & df[role_col].isin(*ROLES) & df[conv_col].isNotNull()).select(df[conv_col].cast("string").alias("conv"), df[turn_col].cast("long").alias("turn"), df[role_col].alias("role"), kind.alias("kind"), F.xxhash64(text).alias("print"))
    sample = rows.orderBy(F.xxhash64("conv"), "conv", "turn", "print", "role").limit(most).toArrow().to_pydict()  # a bounded sample of labelled rows
    start, follow, kinds = (PRIOR * np.exp(t) for t in (GIVEN.start, GIVEN.follow, GIVEN.kinds))
    before: tuple[str | None, int] = (None, -1)
    for conv, role, row in zip(sample["conv"], sample["role"], sample["kind"], strict=True):
        k = ROLES.index(role)
        kinds[k, row] += 1
        if conv == before[0]:
            follow[before[1], k] += 1
        else:
            start[k] += 1
        before = (conv, k)
    return Model(*(np.log(t / t.sum(axis=-1, keepdims=True)) for t in (start, follow, kinds)))


def marker(line: str) -> tuple[int, str]:
    """(role number or -1, the line without its marker)."""
    found = _MARK.match(line)
    if not found or (role := _ROLE_OF.get(found[1].lower())) is None:
        return -1, line
    bare = found[0].strip()
    if found[2] not in (":", "：") and bare.isalpha():  # a plain word alone on its line is no marker
        return -1, line
    return role, line[found.end() :]


def observe(text: str, mark: str | None, model: Model = GIVEN) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each line: emission of each role, whether the speaker may change there, and the line without its marker."""
    lines = (text or "").split("\n")
    emission, turns, bare = np.zeros((len(lines), 3)), np.zeros(len(lines), dtype=bool), []
    for k, line in enumerate(lines):
        role, rest = marker(line)
        bare.append(rest)
        if role >= 0:
            emission[k] += np.where(np.arange(3) == role, 0, LINE_MARK)
            turns[k] = True
    turns[0] = True
    emission[0] += model.kinds[:, row_kind(text or "")]
    if (role := _ROLE_OF.get((mark or "").strip().lower(), -1)) >= 0:
        emission[0] += np.where(np.arange(3) == role, 0, COLUMN_MARK)
    return emission, turns, bare


def transfer(emission: np.ndarray, turns: np.ndarray, first: bool, model: Model = GIVEN) -> np.ndarray:
    """Best score from each role before the lines to each role at the last; ``first``: nothing is before."""
    score = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
    for k in range(len(emission)):
        if first and k == 0:
            score = np.tile(model.start + emission[0], (3, 1))
        else:
            score = (score[:, :, None] + (model.follow if turns[k] else STAY)).max(axis=1) + emission[k]
    return score


def decode(emission: np.ndarray, turns: np.ndarray, entry: int, leave: int, model: Model = GIVEN) -> list[int]:
    """The best roles of the lines between the role before (-1: none) and the last line's role."""
    score, back = None, np.zeros((len(emission), 3), dtype=np.int64)
    for k in range(len(emission)):
        if k == 0:
            score = (model.start if entry < 0 else (model.follow if turns[0] else STAY)[entry]) + emission[0]
        else:
            step = score[:, None] + (model.follow if turns[k] else STAY)
            back[k] = step.argmax(axis=0)
            score = step.max(axis=0) + emission[k]
    path = [leave]
    for k in range(len(emission) - 1, 0, -1):
        path.append(int(back[k][path[-1]]))
    return path[::-1]


def _segments(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    key, rows = None, []
    for batch in small_batches(batches):
        for row in batch.to_pylist():
            own = tuple(row[n] for n in names[:keys])
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield key, rows


_CUT = "conv string, part int, segment long, place int, turn long, mark string, text string, begin array<double>, later array<double>"
_CUT_TYPES = (("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("place", pa.int32()), ("turn", pa.int64()), ("mark", pa.string()), ("text", pa.string()), ("begin", pa.list_(pa.float64())), ("later", pa.list_(pa.float64())))
_TABLE = (("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("begin", pa.list_(pa.float64())), ("later", pa.list_(pa.float64())))
_ENDS = (("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()))


def _batch(rows: list[tuple], schema: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


def _cut(batches: Iterator[pa.RecordBatch], size: int, model: Model) -> Iterator[pa.RecordBatch]:
    """First pass, over a range of sorted rows: the rows with their segments, and after each segment a row (place -1) of its 9 scores as the first of a conversation, and 9 as a later one."""
    part, out, held = TaskContext.get().partitionId(), [], 0
    conv, segment, seen, chars = None, 0, [], 0

    def table() -> tuple:
        emission, turns = np.concatenate([p[0] for p in seen]), np.concatenate([p[1] for p in seen])
        return (conv, part, segment, -1, None, None, None, transfer(emission, turns, True, model)[0].tolist(), transfer(emission, turns, False, model).ravel().tolist())

    for batch in small_batches(batches):
        for row in batch.to_pylist():
            if seen and (row["conv"] != conv or len(seen) == size or chars >= SEGMENT_CHARS):
                out.append(table())
                segment, seen, chars = segment + 1, [], 0
            if row["conv"] != conv:
                conv, segment = row["conv"], 0
            out.append((conv, part, segment, len(seen), row["turn"], row["mark"], row["text"], None, None))
            seen.append(observe(row["text"], row["mark"], model)[:2])
            chars += len(row["text"] or "")
            held += len(row["text"] or "")
            if len(out) >= 2000 or held >= 4 << 20:
                yield _batch(out, _CUT_TYPES)
                out, held = [], 0
    if seen:
        out.append(table())
    if out:
        yield _batch(out, _CUT_TYPES)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each block of segments as one."""
    out = []
    for (conv, part, block), rows in _segments(batches, ("conv", "part", "block"), 3):
        begin, later = np.array(rows[0]["begin"]), np.array(rows[0]["later"]).reshape(3, 3)
        for row in rows[1:]:
            step = np.array(row["later"]).reshape(3, 3)
            begin, later = (begin[:, None] + step).max(axis=0), (later[:, :, None] + step).max(axis=1)
        out.append((conv, part, block, begin.tolist(), later.ravel().tolist()))
        if len(out) == 5000:
            yield _batch(out, _TABLE)
            out = []
    if out:
        yield _batch(out, _TABLE)


def _through(rows: list[dict], entry: int, leave: int | None) -> list[tuple]:
    """Of each table the role before it and at its end, on the best way from the role before all (-1: none) to the last one's (None: the best)."""
    score, back = np.array(rows[0]["begin"]) if entry < 0 else np.array(rows[0]["later"]).reshape(3, 3)[entry], []
    for row in rows[1:]:
        step = score[:, None] + np.array(row["later"]).reshape(3, 3)
        back.append(step.argmax(axis=0).tolist())
        score = step.max(axis=0)
    ends = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        ends.append(b[ends[-1]])
    ends = ends[::-1]
    return [(row["conv"], row["part"], row["segment"], before, at) for row, before, at in zip(rows, [entry, *ends], ends, strict=False)]


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass, at the top: of each part of a conversation the role before it (-1: none) and at its end."""
    out = []
    for _, rows in _segments(batches, ("conv",), 1):
        out += _through(rows, -1, None)
        if len(out) > 5000:
            yield _batch(out, _ENDS)
            out = []
    if out:
        yield _batch(out, _ENDS)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass, a level down: tables of a block, after the row that holds its two roles."""
    out = []
    for _, rows in _segments(batches, ("conv", "part", "block"), 3):
        out += _through(rows[1:], rows[0]["entry"], rows[0]["leave"])
        if len(out) > 5000:
            yield _batch(out, _ENDS)
            out = []
    if out:
        yield _batch(out, _ENDS)


def _ends(tables: DataFrame, fan: int) -> DataFrame:
    """Of each segment the role before it (-1: none) and at its end: composed upwards to one table a part, then decided downwards."""
    largest = tables.agg(F.max("segment")).first()[0] or 0
    levels, ends_schema = [tables], "conv string, part int, segment long, entry int, leave int"
    while largest > 0:
        blocks = levels[-1].withColumn("block", F.floor(F.col("segment") / fan).cast("long"))
        blocks = blocks.repartition("conv", "part", "block").sortWithinPartitions("conv", "part", "block", "segment")
        levels.append(blocks.mapInArrow(_compose, "conv string, part int, segment long, begin array<double>, later array<double>"))
        largest //= fan
    ends = levels.pop().repartition("conv").sortWithinPartitions("conv", "part", "segment").mapInArrow(_stitch, ends_schema)
    for level in reversed(levels):
        below = level.withColumns({"block": F.floor(F.col("segment") / fan).cast("long"), "kind": F.lit(1)})
        above = ends.withColumnRenamed("segment", "block").withColumn("kind", F.lit(0))
        both = below.unionByName(above, allowMissingColumns=True).repartition("conv", "part", "block")
        ends = both.sortWithinPartitions("conv", "part", "block", "kind", "segment").mapInArrow(_descend, ends_schema)
    return ends


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


_TURNS = (("conv", pa.string()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()))


def _decoded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Third pass: rows of a segment, after the one that holds its two roles."""
    out = []
    for (conv, _, _), rows in _segments(batches, ("conv", "part", "segment"), 3):
        ends, rows = rows[0], rows[1:]
        parts = [observe(r["text"], r["mark"], model) for r in rows]
        roles = decode(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), ends["entry"], ends["leave"], model)
        at = 0
        for row, (_, _, lines) in zip(rows, parts, strict=True):
            own = roles[at : at + len(lines)]
            at += len(lines)
            begin, part = 0, 0
            for k in range(1, len(lines) + 1):
                if k == len(lines) or own[k] != own[begin]:
                    role, said = ROLES[own[begin]], "\n".join(lines[begin:k])
                    out.append((conv, row["turn"], part, role, said, render(role, said)))
                    begin, part = k, part + 1
        if len(out) > 2000:
            yield _batch(out, _TURNS)
            out = []
    if out:
        yield _batch(out, _TURNS)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", mark: Column | None = None, model: Model = GIVEN) -> DataFrame:
    """One row per recovered turn: conv_id, turn, part (of the row), role, text, rendered. ``mark``: a column with the speaker's name, if there is one."""
    conv, text = df[conv_col], df[text_col].cast("string")
    rows = df.select(
        F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("conv"),
        df[turn_col].cast("long").alias("turn"),
        (mark if mark is not None else F.lit(None)).cast("string").alias("mark"),
        text.alias("text"),
        F.substring(text, 1, PREFIX).alias("prefix"),
        F.xxhash64(text).alias("print"),
        F.monotonically_increasing_id().alias("copy"),  # deals out repeated rows
    )
    order = ["conv", "turn", "mark", "prefix", "print"]
    ranged = rows.repartitionByRange(*order, "copy").sortWithinPartitions(*order).select("conv", "turn", "mark", "text")
    cut = written(ranged.mapInArrow(partial(_cut, size=SEGMENT, model=model), _CUT))  # once, as another sample would give other parts
    ends = _ends(cut.filter("place < 0").select("conv", "part", "segment", "begin", "later"), FAN)
    texts = cut.filter("place >= 0").select("conv", "part", "segment", "place", "turn", "mark", "text")
    both = texts.unionByName(ends.withColumn("place", F.lit(-1)), allowMissingColumns=True)
    both = both.repartition("conv", "part", "segment").sortWithinPartitions("conv", "part", "segment", "place")
    turns = both.mapInArrow(partial(_decoded, model=model), "conv string, turn long, part int, role string, text string, rendered string")
    named = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(df.schema[conv_col].dataType)
    return turns.select(named.alias("conv_id"), "turn", "part", "role", "text", "rendered")
