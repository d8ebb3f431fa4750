"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates, for each end position, the vocabulary's
pieces that end there, longest first. The dynamic programme keeps for each
position the best score and the number of tokens on the best path; pieces
themselves are not kept. Tie rule: at one end the earliest start wins, as in
unigram tokenizers, which only replace a path by a strictly better one. A
character that no piece of one character covers may be an unknown piece with the
least score less 10; runs of unknown characters become their UTF-8 bytes if
``byte_fallback`` holds, else one unknown token.

Text is split at spaces as with a "metaspace" pre-tokenizer: every space is
written as U+2581 and starts a word, and one is put before a text that does not
begin with it. Counts of short words are kept in a bounded cache.

The public vocabulary files hold ranks, not probabilities, so ``zipf_scores``
gives each piece the logarithm of its Zipf share.

Nulls count as empty, and an empty text has no tokens. Rows are counted one by
one, whole, at any length: of a long word without spaces only as many places are kept as the longest
piece has characters. Ties, repeated rows and other columns do no harm, and a table without rows gives one without rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches, text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY, CACHE_WORDS, CACHE_CHARS, WINDOW_CHARS, LONG_WORD = 10.0, 200_000, 64, 1 << 20, 1 << 12


def zipf_scores(pieces: list[str]) -> list[tuple[str, float]]:
    """Pieces in order of frequency, with the logarithm of 1/rank over the harmonic sum."""
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return [(p, -math.log(k + 1) - total) for k, p in enumerate(pieces)]


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class TokenCounter:
    def __init__(self, scored: list[tuple[str, float]], *, byte_fallback: bool = True):
        self.machine = ahocorasick.Automaton()
        for piece, score in scored:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.longest = max(len(p) for p, _ in scored)
        self.unknown = min(s for _, s in scored) - UNKNOWN_PENALTY
        self.covered = frozenset(p for p, _ in scored if len(p) == 1)
        self.byte_fallback = byte_fallback
        self._cache: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        if n > LONG_WORD:
            return self._count_long(word)
        if self.covered.issuperset(word):  # no character can be unknown
            best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (length, gain) in self.machine.iter(word):  # ends in order, at each the longest first
                start = last + 1 - length
                if best[start] + gain > best[last + 1]:
                    best[last + 1], count[last + 1] = best[start] + gain, count[start] + 1
            return count[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.machine.iter(word):
            ends[last + 1].append(match)
        best, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            score, tokens, unknown, single = -math.inf, 0, False, False
            for length, gain in ends[end]:  # longest first: the earliest start wins ties
                if best[end - length] + gain > score:
                    score, tokens = best[end - length] + gain, count[end - length] + 1
                single = single or length == 1
            if not single and best[end - 1] + self.unknown > score:
                score, unknown = best[end - 1] + self.unknown, True
                tokens = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.byte_fallback else not open_unknown[end - 1])
            best[end], count[end], open_unknown[end] = score, tokens, unknown
        return count[n]

    def _count_long(self, word: str) -> int:
        """The same with only as many places as the longest piece has characters."""
        size = self.longest + 1
        best, count, open_unknown = [0.0] * size, [0] * size, [False] * size
        matches = groupby(self.machine.iter(word), key=itemgetter(0))
        last, found = next(matches, (-1, ()))
        for end in range(1, len(word) + 1):
            score, tokens, unknown, single = -math.inf, 0, False, False
            if last + 1 == end:
                for _, (length, gain) in found:  # longest first: the earliest start wins ties
                    before = (end - length) % size
                    if best[before] + gain > score:
                        score, tokens = best[before] + gain, count[before] + 1
                    single = single or length == 1
                last, found = next(matches, (-1, ()))
            before = (end - 1) % size
            if not single and best[before] + self.unknown > score:
                score, unknown = best[before] + self.unknown, True
                tokens = count[before] + (len(word[end - 1].encode("utf-8", "replace")) if self.byte_fallback else not open_unknown[before])
            best[end % size], count[end % size], open_unknown[end % size] = score, tokens, unknown
        return count[len(word) % size]

    def count(self, text: str) -> int:
        """Tokens of a text, word by word in windows."""
        if not text:
            return 0
        total, at, cache = 0, 0, self._cache
        text = text.replace(" ", SPACE)
        while at < len(text):
            end = text.find(SPACE, at + WINDOW_CHARS)
            window = text[at:] if end < 0 else text[at:end]
            at += len(window)
            for rest in (window[1:] if window[0] == SPACE else window).split(SPACE):
                n = cache.get(rest)
                if n is None:
                    n = self._old.get(rest)
                    if n is None:
                        n = self.count_word(SPACE + rest)
                    if len(rest) <= CACHE_CHARS:
                        if len(cache) >= CACHE_WORDS:  # words in use come back from the generation before
                            self._cache, self._old = {}, cache
                            cache = self._cache
                        cache[rest] = n
                total += n
        return total


@lru_cache(2)
def counter_of(model_path: str, byte_fallback: bool) -> TokenCounter:
    """A counter that the tasks of one worker share, with what it has cached."""
    return TokenCounter(zipf_scores(read_pieces(model_path)), byte_fallback=byte_fallback)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, byte_fallback: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens. ``model_path`` is read by each task, so it must be there on every machine."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        counter = counter_of(model_path, byte_fallback)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, n_tokens long")
