"""Word and shingle hashing over whole blocks of text with numpy.

A block is the concatenation of several UTF-8 texts, each followed by one zero
byte, so nothing computed inside a block can cross a text boundary. A-Z are
folded to a-z; a word is a maximal run of 0-9, a-z and bytes from 0x80 up, that
is, of every code point outside ASCII punctuation and control characters.

Hashes are 64-bit polynomial sums modulo 2**64 over a fixed random table, mixed
at the end. They are the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that one block holds, if it does not hold a single longer text.
BLOCK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 * BLOCK_BYTES:  # a giant text does not pin its table
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Block:
    """Words of several texts: where they are, whose they are, and their hashes.

    ``start``/``end`` are byte offsets of words in ``raw``; ``text_of`` is the
    index of each word's text; ``first`` has, for each text and one past the
    last, the index of its first word.
    """

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        self.raw = np.frombuffer(b"\x00".join([*texts, b""]), dtype=np.uint8)
        self.folded = _FOLD[self.raw]
        inside = _IS_WORD[self.folded]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # each text ends in a zero byte
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.text_start)
        self._sums: np.ndarray | None = None

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def _prefix_sums(self) -> np.ndarray:
        if self._sums is None:
            sums = np.zeros(len(self.folded) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self.folded] * _powers(_BASE, len(self.folded)), out=sums[1:])
            self._sums = sums
        return self._sums

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the folded bytes in each [start, end)."""
        sums = self._prefix_sums()
        return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(self.folded) + 1)[start])

    def word_hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def shingle_hashes(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text index) of each run of ``width`` words. A text with fewer words, but not none, is one shingle."""
        hashes = self.word_hashes() if hashes is None else hashes
        counts, owner = np.diff(self.first), self.text_of
        mixed = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for j in range(width):
            mixed += hashes[j : j + len(mixed)] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
        whole = owner[: len(mixed)] == owner[width - 1 :] if len(mixed) else np.zeros(0, dtype=bool)
        short = np.flatnonzero((counts > 0) & (counts < width))
        extra = np.array([(int(counts[t]) + sum(int(h) * pow(_BASE, 2 * j + 3, 1 << 64) for j, h in enumerate(hashes[self.first[t] : self.first[t + 1]]))) % (1 << 64) for t in short], dtype=np.uint64)
        return mix(np.concatenate((mixed[whole], extra))), np.concatenate((owner[: len(mixed)][whole], short))


def blocks(texts: Iterable[bytes]) -> Iterator[tuple[int, Block]]:
    """(index of the first text, block) over texts in order, about BLOCK_BYTES at a time; a longer text has a block of its own."""
    held: list[bytes] = []
    at = size = 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BLOCK_BYTES:
            yield at, Block(held)
            held, at, size = [], i, 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield at, Block(held)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
