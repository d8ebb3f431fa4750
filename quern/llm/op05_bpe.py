"""Byte-level BPE by prefix dynamic programming: exact encoding, decoding, appending and editing.

BPE gives every byte string one encoding, and every prefix of a string has one
last token. A token sequence is an encoding exactly if each two neighbours are
one, so the last token of a prefix is the only token that ends there and fits the
last token of the prefix before it. ``PrefixTable`` stores that token for each
prefix of a piece. More bytes can be appended without touching what is stored,
and an edit keeps the table up to the edited byte.

Pieces are the matches of the tokenizer's pattern. A match depends only on the
text from its start to three characters past its end at most, so long texts are
split window by window, and an edit re-splits only from the first piece it could
affect until the borders fall into step again.

Nulls count as empty; an empty text has no tokens. Every row is encoded alone, so
ties, repeated rows and clashing columns do no harm. Texts may be of any length. A table
without rows gives one without rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import map_batches, text_or_empty
from .words import utf8

#: Characters split at once, characters that a match may look past its end, pieces and bytes a piece that the cache keeps, and pairs of tokens.
SPLIT_CHARS, LOOKAHEAD, CACHE_PIECES, CACHE_BYTES, CACHE_PAIRS = 1 << 19, 3, 200_000, 64, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens with their ranks, an automaton that finds them, and which two tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.longest = max(map(len, ranks))
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():  # bytes as the characters of the same numbers
            self.machine.add_word(token.decode("latin-1"), (len(token), rank))
        self.machine.make_automaton()
        self.known: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Encoding by the definition: merge the neighbours of lowest rank, leftmost first. Only ranks under ``below`` count."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that merges never make."""
        if token not in self._halves:
            before = self.merge(self.tokens[token], token)
            self._halves[token] = (before[0], before[1]) if len(before) == 2 else None
        return self._halves[token]

    def alone(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes are encoded as just these two."""
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            known = self.known[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the two tokens' merges, the latest first, and ask each time whether a merge across the border would have come before it."""
        ranks, tokens = self.ranks, self.tokens
        if not (self.alone(left) and self.alone(right)):
            return False
        limit = 1 << 62  # ranks under this may still merge across the border
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left, limit = a[1], left  # at the same rank the merge further left goes first: the one inside ``left``'s place
            else:
                right, limit = b[0], right + 1  # and here the border is further left than the merge inside


class PrefixTable:
    """The last token of each prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        vocabulary, last = self.vocabulary, self.last
        known, fit, alone = vocabulary.known.get, vocabulary.fit, vocabulary.alone
        begin = max(0, len(last) - vocabulary.longest + 1)
        self.data += more
        done = len(last) - begin
        # tokens that end at each place, the longest first; just one of them fits what is before it
        for at, (size, token) in vocabulary.machine.iter(self.data[begin:].decode("latin-1")):
            if at == done:
                before = begin + at - size
                if before >= 0:
                    left = last[before]
                    fits = known(left << 32 | token)
                    if fits is None:
                        fits = fit(left, token)
                else:
                    fits = alone(token)
                if fits:
                    last.append(token)
                    done += 1

    def truncate(self, size: int) -> None:
        del self.data[size:], self.last[size:]

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self._bytes = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._cache = _Cache(self)

    def split(self, text: str, at: int = 0):
        """Lists of pieces of ``text`` from ``at``, which must be a piece's start, window by window."""
        size = SPLIT_CHARS
        while at < len(text):
            window = text[at : at + size]
            pieces = self.pattern.findall(window)
            if at + size < len(text):
                end = len(window)
                while pieces and end > len(window) - LOOKAHEAD:
                    end -= len(pieces.pop())
                if not pieces:
                    size *= 2
                    continue
                at += end
            else:
                at = len(text)
            size = SPLIT_CHARS
            yield pieces

    def encode_piece(self, piece: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        ids = PrefixTable(self.vocabulary, piece.encode()).tokens()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_parts(self, text: str):
        """Packed ids, window by window."""
        for pieces in self.split(text):
            yield b"".join(map(self._cache.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_parts(text)), dtype="<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(self._bytes[np.frombuffer(packed, dtype="<u4")].tolist())

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, dtype="<u4").tobytes()).decode("utf-8", errors="replace")


class _Cache(dict):
    """Packed ids of short pieces: the young generation, with the one before it, so that pieces in use stay while old ones go."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.encoder.encode_piece(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(2)
def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """An encoder that the tasks of one worker share, with what it has cached."""
    return Encoder(read_ranks(ranks_path), pattern)


class EditableText:
    """A text with its pieces and their prefix tables, kept exact under appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of text[start:end]; returns how many pieces were encoded anew."""
        old_starts, old_tables, shift = self.starts, self.tables, len(new) - (end - start)
        self.text = text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep + 1 < len(old_starts) and old_starts[keep + 1] <= start - LOOKAHEAD:
            keep += 1
        at = old_starts[keep] if old_starts else 0
        spare = old_tables[keep] if old_tables and old_starts[keep] < end else None  # else it may be needed whole later
        later = {old_starts[k] + shift: k for k in range(keep, len(old_starts)) if old_starts[k] >= end}
        self.starts, self.tables, made = old_starts[:keep], old_tables[:keep], 0
        for pieces in self.encoder.split(text, at):
            for piece in pieces:
                if at >= start + len(new) and at in later:  # in step again: the rest is as it was
                    k = later[at]
                    self.starts += [s + shift for s in old_starts[k:]]
                    self.tables += old_tables[k:]
                    return made
                data = piece.encode()
                table = PrefixTable(self.encoder.vocabulary)
                if spare is not None:  # the first piece keeps the table of what it still begins with
                    same = next((i for i, (a, b) in enumerate(zip(data, spare.data, strict=False)) if a != b), min(len(data), len(spare.data)))
                    spare.truncate(same)
                    table, spare, data = spare, None, data[same:]
                table.append(data)
                self.starts.append(at)
                self.tables.append(table)
                at += len(piece)
                made += 1
        return made

    def tokens(self) -> list[int]:
        return [t for table in self.tables for t in table.tokens()]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int). ``ranks_path`` is read by each task, so it must be there on every machine."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(b"".join(encoder.encode_parts(t.decode())), dtype="<i4") for t in utf8(batch.column(1))]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the ids' bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [encoder.decode_bytes(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")), make, f"doc_id {kind}, bytes binary")


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes they decode to; ids never leave the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, ids, decoded = [], [], []
            for text in utf8(batch.column(1)):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for packed in encoder.encode_parts(text.decode("utf-8", "replace")):
                    n += len(packed) // 4
                    a.update(packed)
                    b.update(encoder.decode_bytes(packed))
                count.append(n)
                ids.append(a.hexdigest())
                decoded.append(b.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    rows = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
