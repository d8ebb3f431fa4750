"""Spelling variants: words grouped under more frequent words that are one edit away.

Words are counted over all documents, then compared by PartEnum signatures. A
word's multiset of letters is a binary vector with one dimension for each
occurrence of a letter; one replaced letter changes two dimensions, one inserted or deleted
letter one. The letters are partitioned into groups of about equal use, and
signatures enumerate the choices of groups that may hold the changes: words of
one length agree on all but two of FIVE groups for some choice, words whose lengths
differ by one on all but one of FOUR. Words with equal length class, choice and
letters in the other groups are joined by that signature, and each candidate is verified by its
edit distance. The signatures lose no pair: wherever two dimensions differ, some choice leaves out their groups.

A signature that more than CROWD words share is made longer, exactly: one edit
leaves the first or the second half of a word as it is, so the crowd is joined by signature and either
half. Nothing is ever compared with all members of a large group, and nothing is capped.

Each word's form is its near word of largest count, if it has at least ``ratio``
times the word's own; ties go to the least word in code-point order. Counts
grow along forms, so following them ends; roots are found by pointer jumping in a number of rounds
that grows with the logarithm of the longest chain.

Null and empty texts have no words; a null identifier counts as an empty string
where the rule for spellings reads it. A table without rows gives no words. Repeated
rows count again; other columns are not read. Texts may be of any length: they are
read window by window, and each task keeps at most TASK_WORDS counts before it hands them on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_or_empty, written
from .words import utf8

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
FIVE, FOUR, CROWD = 5, 4, 32
WINDOW_CHARS, TASK_WORDS = 1 << 20, 300_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_END = re.compile("[^A-Za-zÀ-ÿ]")

Spelling = Callable[[str, str], str]


def drop_letter(every: int = 97) -> Spelling:
    """The rule (identifier, run) -> word that leaves out one letter of a run if the run's checksum in its document is a multiple of ``every``."""

    def spell(doc: str, run: str) -> str:
        h = zlib.crc32(f"{doc}:{run}".encode())
        return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]

    return spell


def count_words(df: DataFrame, spelling: Spelling | None = None, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, as ``spelling`` gives them, that have enough letters and occurrences."""

    def rows(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for part in _windows(text.lower().decode("utf-8", "replace")):  # bytes: only A-Z change
                    found = Counter(RUN.findall(part))
                    for w, n in found.items() if spelling is None else ((spelling(doc, w), n) for w, n in found.items()):
                        if len(w) >= least_length:
                            counts[w] += n
                    if len(counts) >= TASK_WORDS:
                        yield rows(counts)
                        counts = Counter()
        if counts:
            yield rows(counts)

    texts = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("doc"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _windows(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        found = _END.search(text, at + WINDOW_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def letter_groups(words: DataFrame, n: int) -> list[str]:
    """The words' letters in ``n`` groups of about equal use, the most used first. Only one row for each letter reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n")).collect()
    groups, use = [""] * n, [0] * n
    for r in sorted(letters, key=lambda r: (-r["n"], r["letter"])):
        least = use.index(min(use))
        groups[least] += r["letter"]
        use[least] += r["n"]
    return groups


def _signatures(kind: int, length: Column, sorted_letters: Column, groups: list[str], free: int) -> list[Column]:
    """One for each choice of ``free`` groups that are left open: a hash of the length class, the choice and the letters in the other groups."""
    alone = [F.translate(sorted_letters, "".join(groups[:i] + groups[i + 1 :]), "") for i in range(len(groups))]
    return [F.xxhash64(F.lit(kind), length, F.lit(k), *(alone[i] for i in kept)) for k, kept in enumerate(combinations(range(len(groups)), len(groups) - free))]


#: Roles of a row: compared with words of its own length, with longer ones, with shorter ones.
EQUAL, SHORT, LONG = 0, 1, 2


def near_pairs(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Each two words at an edit distance of exactly one, once: (a, n_a, b, n_b). ``words`` has distinct (word, n)."""
    five, four = letter_groups(words, FIVE), letter_groups(words, FOUR)
    letters, length = F.array_join(F.array_sort(F.split("word", "")), ""), F.char_length("word")
    known = words.select("word", "n", length.alias("length"), letters.alias("letters"))
    roles = [(EQUAL, _signatures(EQUAL, F.col("length"), F.col("letters"), five, 2)), (SHORT, _signatures(SHORT, F.col("length"), F.col("letters"), four, 1)), (LONG, _signatures(SHORT, F.col("length") - 1, F.col("letters"), four, 1))]
    listed = F.array(*(F.struct(F.lit(role).alias("role"), s.alias("key")) for role, signatures in roles for s in signatures))
    signed = known.select("word", "n", F.explode(listed).alias("s")).select("s.key", "s.role", "word", "n")
    shared = signed.withColumn("crowd", F.expr("count(*) OVER (PARTITION BY key)")).filter("crowd > 1")

    size = F.char_length("word") - F.when(F.col("role") == LONG, 1).otherwise(0)  # of the shorter word, whose halves count
    half = (size / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.char_length("word") - (size - half) + 1, size - half).alias("part")))
    crowded = shared.filter(F.col("crowd") > crowd).withColumn("half", F.explode(halves)).select(F.xxhash64("key", "half.side", "half.part").alias("key"), "role", "word", "n")

    def joined(rows: DataFrame) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        roles = (F.col("a.role") * 3 + F.col("b.role")).isin(EQUAL * 3 + EQUAL, SHORT * 3 + LONG)
        once = (F.col("a.role") == SHORT) | (F.col("a.word") < F.col("b.word"))
        near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
        return a.join(b, (F.col("a.key") == F.col("b.key")) & roles & once & near).select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))

    return joined(shared.filter(F.col("crowd") <= crowd).drop("crowd")).union(joined(crowded)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles to (word, root): the last word that forms lead to."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(df: DataFrame, spelling: Spelling | None = None, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """One row per word: word, n, n_near (words one edit away), form, form_n, root."""
    words = written(count_words(df, spelling, id_col, text_col, least_length=least_length, least_count=least_count))
    pairs = written(near_pairs(words, crowd=crowd))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("best")).union(pairs.select("b", F.struct(-F.col("n_a"), F.col("a"))))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    held = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("best.form")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n"))
    found = written(found)
    return found.join(roots(found.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
