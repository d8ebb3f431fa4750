"""SentencePiece encoding and decoding by a merge-type prefix table.

A BPE model merges the two neighbours whose joint piece has the best score, the
leftmost first, until none is left. That gives every string one encoding, every
prefix of it one last token, and a sequence of tokens is an encoding exactly if
each two neighbours are one. ``PrefixTable`` therefore stores one token for each
prefix: an Aho-Corasick automaton names the pieces that end there, and a test of
pairs, which undoes the merges of both from the latest on, keeps the one that
fits what is before it. Ids are recovered backwards from the end. This needs a
vocabulary of merge type: each piece must be made by merging, and no later than its parts' own
merges; others are refused when the model is read.

Spaces become U+2581 and one is put before the text, as the model's normaliser
does. Merges can't cross from a character to a following U+2581 if no piece does, nor a
character that is in no piece, so a text is split there, and short words are kept
in a cache. Characters without a piece become their UTF-8 bytes' tokens. Where a
word is very long, all prefixes that may still matter soon have a common ancestor;
what lies before it is given out and dropped, so the table stays short.

Nulls count as empty, and an empty text has no tokens. A table without rows gives
one without rows. Rows are encoded one by one, whole, at any length; ties, repeated
rows and columns of clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .op05_bpe import _Cache
from .shared import map_batches, text_or_empty
from .words import utf8

SPACE = "▁"
#: Characters split at once, characters of a word after which the table is cut, pairs of tokens that are kept.
WINDOW_CHARS, TABLE_CHARS, CACHE_PAIRS = 1 << 19, 1 << 15, 1_000_000


class PieceVocabulary:
    """Pieces with the order of their merges, an automaton that finds them, and which two may be neighbours."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        """``pieces``: (piece, score, id); a higher score merges earlier, equal scores from the left."""
        self.ids = {piece: i for piece, _, i in pieces}
        order = {s: k + 1 for k, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.rank = {i: order[s] if len(piece) > 1 else 0 for piece, s, i in pieces}  # no merge makes a character
        self.token = {i: piece for piece, _, i in pieces}
        self.letters = {c for piece in self.ids for c in piece}
        for c in sorted(self.letters - set(self.ids)):  # part of pieces, but none itself: a token of this table only
            own = -1 - len(self.token)
            self.ids[c], self.token[own], self.rank[own] = own, c, 0
        self.size = {i: len(piece) for i, piece in self.token.items()}
        self.longest = max(self.size.values())
        self.machine = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.machine.add_word(piece, (len(piece), i))
        self.machine.make_automaton()
        self.known: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for piece, i in self.ids.items():
            left, right = self._last_merge(piece) if len(piece) > 1 else (None, None)
            if len(piece) > 1 and (left is None or max(self.rank[left], self.rank[right]) > self.rank[i]):
                raise ValueError(f"not a vocabulary of merge type: {piece!r}")
            self.halves[i] = (left, right) if len(piece) > 1 else None

    def groups(self, most: int = 20) -> list[set[str]]:
        """The characters that pieces have beside each other, without U+2581: no merge joins two groups. Beyond ``most`` the smallest are one."""
        group = {c: {c} for c in self.letters}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                if SPACE not in (a, b) and group[a] is not group[b]:
                    small, large = sorted((group[a], group[b]), key=len)
                    large |= small
                    group.update(dict.fromkeys(small, large))
        ordered = sorted({id(g): g - {SPACE} for g in group.values()}.values(), key=lambda g: (-len(g), min(g, default="")))
        return [g for g in [*ordered[: most - 1], set().union(*ordered[most - 1 :])] if g]

    def merges(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Encoding by the definition: the parts before each merge and its place, then the parts left and -1."""
        parts = list(text)
        rank = lambda s: self.rank[self.ids[s]] if s in self.ids else 1 << 62
        while True:
            best, at = min(((rank(a + b), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 62, -1))
            if best == 1 << 62:
                yield parts, -1
                return
            yield parts, at
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def _last_merge(self, piece: str) -> tuple[int | None, int | None]:
        before: list[str] = []
        for parts, at in self.merges(piece):
            if at < 0:
                return (self.ids[before[0]], self.ids[before[1]]) if len(parts) == 1 else (None, None)
            before = parts
        return None, None

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens' characters are encoded as just these two."""
        key = left << 32 ^ right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            known = self.known[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, the latest first, and ask each time whether a merge across the border would have come before it."""
        token, ids, rank, halves = self.token, self.ids, self.rank, self.halves
        limit = 1 << 62  # merges of a rank under this may still come, across the border
        while True:
            across = ids.get(token[left] + token[right])
            if across is not None and rank[across] < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                left, limit = a[1], rank[left]  # at one rank the merge inside ``left`` is further left than the border
            else:
                right, limit = b[0], rank[right] + 1  # and the border further left than the merge inside ``right``


class PrefixTable:
    """The last token of each prefix of a word, and the ids that are settled."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.vocabulary, self.settled = vocabulary, []
        self.base, self.tail = 0, ""  # the table begins with the prefix of base + 1 characters
        self.last: list[int] = []
        self.done = 0  # characters whose tokens are in ``settled``

    def append(self, more: str) -> None:
        last, known, fit = self.last, self.vocabulary.known.get, self.vocabulary.fit
        text, next_at = self.tail + more, len(self.tail)
        shift = len(last) - next_at  # from a place in the text to one in the table
        start = -1 - self.base  # the table's place of the prefix without characters
        for at, (size, token) in self.vocabulary.machine.iter(text):
            if at == next_at:  # else the token of this prefix is known already
                before = at + shift - size
                if before != start:
                    left = last[before]
                    fits = known(left << 32 ^ token)
                    if fits is None:
                        fits = fit(left, token)
                    if not fits:
                        continue
                last.append(token)
                next_at += 1
        self.tail = text[1 - self.vocabulary.longest :]

    def settle(self) -> None:
        """Give out the tokens before the common ancestor of all prefixes that a later token can follow."""
        end, size = self.base + len(self.last), self.vocabulary.size
        heads = set(range(max(self.done, end - self.vocabulary.longest), end + 1))
        while len(heads) > 1 and (top := max(heads)) > self.done:
            heads.remove(top)
            heads.add(top - size[self.last[top - self.base - 1]])
        if (cut := max(heads)) > self.done:
            self._give(cut)
            del self.last[: cut - self.base - 1]  # the prefix that ends at the cut stays
            self.base = cut - 1

    def _give(self, end: int) -> None:
        out, at, stop, last, size = [], end - self.base - 1, self.done - self.base - 1, self.last, self.vocabulary.size
        while at > stop:
            out.append(last[at])
            at -= size[out[-1]]
        self.settled += reversed(out)
        self.done = end

    def tokens(self) -> list[int]:
        self._give(self.base + len(self.last))
        return self.settled


class PieceEncoder:
    """Text to ids and back, as one sentencepiece BPE model does."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(map(model.is_unused, plain)) or sum(map(model.is_byte, range(size))) != 256 or model.normalize(" á  b ") != "▁▁á▁▁b▁":
            raise ValueError("only models with byte tokens, the identity normaliser, a leading space and no unused pieces")
        self.vocabulary = PieceVocabulary([(model.id_to_piece(i), model.get_score(i), i) for i in plain])
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = np.array([b""] * size, dtype=object)
        for i in plain:
            self.surface[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        self.surface[model.unk_id()] = " ⁇ ".encode()
        self.is_byte = np.zeros(size, dtype=bool)
        self.is_byte[self.bytes] = True
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.decimal = np.array([str(i).encode() for i in range(size)], dtype=object)
        self.crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.vocabulary.ids)
        known = "".join(map(re.escape, sorted(self.vocabulary.letters - {SPACE})))
        lead, words = ("", [f"{SPACE}{known}"]) if self.crossing else (f"{SPACE}*", ["".join(map(re.escape, sorted(g))) for g in self.vocabulary.groups()])
        self.pattern = re.compile("|".join([*(f"{lead}[{w}]+" for w in words), f"{SPACE}+", f"[^{SPACE}{known}]+"]))
        self._cache = _Cache(self)

    def encode_piece(self, word: str) -> bytes:
        """The ids of a word, or of a run of characters that are in no piece, as little-endian unsigned 32-bit integers."""
        if (whole := self.vocabulary.ids.get(word, -1)) >= 0:
            return self.packed[whole]
        if word[-1] not in self.vocabulary.letters:
            return np.array([self.bytes[b] for b in word.encode()], dtype="<u4").tobytes()
        table = PrefixTable(self.vocabulary)
        for at in range(0, len(word), TABLE_CHARS):
            if at:
                table.settle()
            table.append(word[at : at + TABLE_CHARS])
        packed, token = self.packed, self.vocabulary.token
        return b"".join([packed[t] if t >= 0 else b"".join([packed[self.bytes[b]] for b in token[t].encode()]) for t in table.tokens()])

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Packed ids, window by window; windows begin with spaces."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while at < len(text):
            end = -1 if self.crossing else text.find(SPACE, at + WINDOW_CHARS)
            while 0 < end < len(text) and text[end - 1] == SPACE:  # a run of spaces stays whole
                end -= 1
            window = text[at:] if end <= at else text[at:end]
            at += len(window)
            yield b"".join(map(self._cache.__getitem__, self.pattern.findall(window)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_parts(text)), dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The ids' text in UTF-8. ``first``: they begin the text, so one leading space is the model's own. Bytes that are no character become U+FFFD, one by one."""
        parts = self.surface[ids]
        if first and len(parts) and parts[0][:1] == b" " and not self.is_byte[ids[0]]:
            parts[0] = parts[0][1:]
        single = self.is_byte[ids]
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
            for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                run = b"".join(parts[begin:end].tolist())
                parts[begin:end] = b""
                parts[begin] = _mended(run)
        return b"".join(parts.tolist())

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, dtype=np.int64)).decode()


def _mended(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            if at + size <= len(run):
                out.append(run[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(2)
def encoder_of(model_path: str) -> PieceEncoder:
    """An encoder that the tasks of one worker share, with what it has cached."""
    return PieceEncoder(model_path)


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int). ``model_path`` is read by each task, so it must be there on every machine."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(b"".join(encoder.encode_parts(t.decode("utf-8", "replace"))), dtype="<i4") for t in utf8(batch.column(1))]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the ids' text; null ids count as none."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")), make, f"doc_id {kind}, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids joined by commas and of the text they decode to; ids never leave the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = encoder_of(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, said, decoded = [], [], []
            for text in utf8(batch.column(1)):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for packed in encoder.encode_parts(text.decode("utf-8", "replace")):
                    ids = np.frombuffer(packed, dtype="<u4")
                    a.update((b"," if n else b"") + b",".join(encoder.decimal[ids].tolist()))
                    b.update(encoder.decode_bytes(ids, first=not n))
                    n += len(ids)
                count.append(n)
                said.append(a.hexdigest())
                decoded.append(b.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(said), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    rows = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
