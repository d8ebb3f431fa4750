"""SentencePiece against the public library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import op12_sentencepiece as pieces
from quern.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b \n", "\x00x", "é é ﬁ", "漢字 😀😀 \n\n x", "▁▁ a ▁", "</s><0x0A><s><unk>", "don't 12345 ...", " \t\r\n", "​﻿x", "=-" * 500, "ab" * 3000, "a" + " " * 70 + "b"]


@pytest.fixture(scope="module")
def both():
    return pieces.encoder_of(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(both, text):
    ours, theirs = both
    ids = theirs.encode(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids)


def test_odd_texts_and_runs_of_spaces(both):
    for text in [*ODD, *(" " * n for n in range(120)), *("x" + " " * n + "y" for n in range(60))]:
        check(both, text)


def test_random_pieces_and_letters(both):
    rng = random.Random(12)
    known = [both[1].id_to_piece(i) for i in range(259, 32000)]
    for _ in range(3000):
        check(both, "".join(rng.choice(known) for _ in range(rng.randint(1, 8))).replace("▁", " "))
        check(both, "".join(rng.choice("ab nteri▁\n.,é ") for _ in range(rng.randint(1, 30))))


def test_decoding_any_ids(both):
    rng = random.Random(13)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000))) for _ in range(rng.randint(0, 9))]
        assert both[0].decode(ids) == both[1].decode(ids)


def test_long_words_are_settled_in_parts(both, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHARS", 40)
    monkeypatch.setattr(pieces, "WINDOW_CHARS", 100)
    rng = random.Random(14)
    for text in ["a" * 3000, "ab" * 777, " " * 500, "x" + " " * 300 + "yz"]:
        check(both, text)
    for _ in range(100):
        check(both, "".join(rng.choice(["er", "in", "t", "the", "ing", "q", " ", "\n"]) for _ in range(300)))


def test_table_of_a_long_word_stays_short(both):
    table = pieces.PrefixTable(both[0].vocabulary)
    for _ in range(50):
        table.append("straightforwardness" * 100)
        table.settle()
        assert len(table.last) < 200


def test_unmergeable_vocabulary_is_refused():
    with pytest.raises(ValueError):
        pieces.PieceVocabulary([("a", -3.0, 0), ("b", -3.0, 1), ("c", -3.0, 2), ("abc", -1.0, 3)])
    small = pieces.PieceVocabulary([("a", -3.0, 0), ("ab", -1.0, 1), ("abb", -2.0, 2)])  # b is no piece
    table = pieces.PrefixTable(small)
    table.append("abbab")
    assert [small.token[t] for t in table.tokens()] == ["abb", "ab"]


def test_query_equals_the_library(spark, sf_dir, both):
    found = {r["doc_id"]: r for r in QUERIES["op12_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = both[1].encode(d["text"] or "")
        r = found[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(both[1].decode(ids)))


def test_nulls_empty_tables_and_other_columns(spark, both):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "a b", None)], "doc_id long, text string, ids string")
    got = pieces.encode_documents(df, PATH)
    assert sorted((str(r[0]), r[1]) for r in got.collect()) == [("1", []), ("1", []), ("2", both[1].encode("a b")), ("None", both[1].encode("a b"))]
    back = pieces.decode_documents(got.union(spark.createDataFrame([(9, None)], got.schema)), PATH)
    assert sorted(r["text"] for r in back.collect()) == ["", "", "", "a b", "a b"]
    assert pieces.round_trip_digests(df.filter(F.lit(False)), PATH).count() == 0
    assert {r["n_tokens"] for r in pieces.round_trip_digests(df, PATH).collect()} == {0, 2}
