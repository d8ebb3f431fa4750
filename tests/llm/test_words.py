import re

import numpy as np

from quern.llm.words import BLOCK_BYTES, Block, blocks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_words_and_texts():
    texts = ["", "Hello, WORLD 42!", "été É x", "a" * 50, "...", "one two"]
    block = Block([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = slice(block.first[i], block.first[i + 1])
        words = [block.folded[a:b].tobytes().decode() for a, b in zip(block.start[own], block.end[own])]
        assert words == WORD.findall(fold(t))


def test_hashes_do_not_depend_on_place():
    a = Block([b"alpha beta"]).word_hashes()
    b = Block([b"zzz", b"", b"x beta Alpha"]).word_hashes()
    assert a[0] == b[3] and a[1] == b[2] and len(set(b)) == 4


def test_shingles():
    block = Block([b"a b c d e f", b"a b", b"", b"A, b. C d e"])
    hashes, owner = block.shingle_hashes(5)
    by = {i: set(hashes[owner == i].tolist()) for i in range(4)}
    assert [len(by[i]) for i in range(4)] == [2, 1, 0, 1] and by[3] < by[0] and not by[1] & by[0]


def test_blocks_cover_all_texts():
    texts = [b"x" * n for n in (10, BLOCK_BYTES + 5, 0, BLOCK_BYTES // 2, BLOCK_BYTES // 2, 7)]
    seen = []
    for at, block in blocks(texts):
        assert at == len(seen)
        seen += [block.raw[a : b - 1].tobytes() for a, b in zip(block.text_start[:-1], block.text_start[1:])]
    assert seen == texts
    assert np.array_equal(Block([]).first, [0])
