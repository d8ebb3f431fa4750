"""Token counts and byte-level BPE against the public libraries."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from quern.llm import op03_token_count as count
from quern.llm import op05_bpe as bpe

ODD = ["", " ", "  a", "a  b ", "▁x", "\n\n  x\t y  ", "😀😀 é", "漢字 ok", "a" * 3000, " " * 2000 + "z", "I'll don't 'tis ''re", "\x00\x01", "don'", "x" + " " * 9]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def exact(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_unigram_counts():
    scored = count.zipf_scores(count.read_pieces(P.path("piece_bpe_32k.model")))
    mine = count.TokenCounter(scored)
    library = Tokenizer(models.Unigram([*scored, ("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256))], len(scored), True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=count.SPACE, prepend_scheme="always", split=True)
    rnd = random.Random(1)
    for t in ODD + ["".join(rnd.choice("the ing é😀\n▁erx") for _ in range(rnd.randrange(30))) for _ in range(500)]:
        assert mine.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_ties_and_unknown_runs():
    scored = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.5), ("ab", -2.5)]
    mine = count.TokenCounter(scored, byte_fallback=False)
    library = Tokenizer(models.Unigram([*scored, ("<unk>", 0.0)], len(scored), False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=count.SPACE, prepend_scheme="always", split=True)
    rnd = random.Random(2)
    for _ in range(1000):
        t = "".join(rnd.choice("aab xé") for _ in range(rnd.randrange(14)))
        assert mine.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_counts_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the thing"), (3, "the thing"), (4, "the " * 300_000)], "doc_id int, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(tuple(r) for r in count.count_tokens(df, P.path("piece_bpe_32k.model")).collect())
    assert got[0] == (1, 0) and got[1] == (2, 0) and got[2] == got[3] and got[4][1] >= 300_000
    assert count.count_tokens(df.filter("false"), P.path("piece_bpe_32k.model")).isEmpty()


def test_encoding(ranks, exact, monkeypatch):
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 7)
    mine, rnd = bpe.Encoder(ranks, P.PATTERN), random.Random(1)
    for t in ODD + ["".join(rnd.choice("ab 'rel\n .1éß") for _ in range(rnd.randrange(60))) for _ in range(800)]:
        ids = mine.encode(t)
        assert ids == exact.encode_ordinary(t), t
        assert mine.decode(ids) == t


def test_neighbours(ranks):
    v, rnd = bpe.Vocabulary(ranks), random.Random(2)
    for _ in range(4000):
        a, b = rnd.randrange(len(ranks)), rnd.randrange(len(ranks))
        assert v.fit(a, b) == (v.merge(v.tokens[a] + v.tokens[b]) == [a, b])


def test_appends_and_edits(ranks, exact):
    mine, rnd = bpe.Encoder(ranks, P.PATTERN), random.Random(3)
    table, text = bpe.PrefixTable(mine.vocabulary), b""
    for part in (b"hel", b"lo", b"", b"wor", b"ldwideweb" * 30):
        table.append(part)
        text += part
        assert table.tokens() == mine.vocabulary.merge(text)
    letters = "ab 'rel\n .1é"
    for _ in range(200):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(80)))
        edited = bpe.EditableText(mine, text)
        for _ in range(4):
            a = rnd.randrange(len(text) + 1)
            b, new = min(len(text), a + rnd.randrange(4)), "".join(rnd.choice(letters) for _ in range(rnd.randrange(5)))
            text = text[:a] + new + text[b:]
            edited.replace(a, b, new)
            assert edited.text == text and edited.tokens() == exact.encode_ordinary(text)
        edited.append(" tail")
        assert edited.tokens() == exact.encode_ordinary(text + " tail")
    big = bpe.EditableText(mine, "some words here " * 500)
    assert big.replace(4000, 4001, "Q") < 12  # only pieces near the edit


def test_bpe_tables(spark, exact):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "Hello  world's é😀\n", "Hello  world's é😀\n", "long text " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit("x"))
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(df, path, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = exact.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(df, path, P.PATTERN)
    decoded = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode_documents(encoded, path, P.PATTERN).collect()}
    assert decoded == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.round_trip_digests(df.filter("false"), path, P.PATTERN).isEmpty()


def test_long_words_are_counted_in_a_window(monkeypatch):
    rng = random.Random(3)
    for fallback in (True, False):
        short = count.TokenCounter([("a", -1.0), ("ab", -1.5), ("abc", -2.5), ("b", -1.2), ("▁", -0.5), ("▁a", -1.1), ("cab", -3.0)], byte_fallback=fallback)
        words = ["▁" + "".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 60))) for _ in range(400)]
        want = [short.count_word(w) for w in words]
        monkeypatch.setattr(count, "LONG_WORD", 0)
        assert [short.count_word(w) for w in words] == want
        monkeypatch.undo()
    word = "▁" + "abcé" * 250_000
    tracemalloc.start()
    short.count_word(word)
    assert tracemalloc.get_traced_memory()[1] < 6 << 20  # the automaton reads a copy of four bytes a character
    tracemalloc.stop()
