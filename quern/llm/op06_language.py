"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic
gradient descent (with adaptive steps) in numpy, with calibrated rejection.

Subwords are runs of 2 to 4 bytes of the folded text in which every byte that
cannot belong to a letter is a border mark. Each is hashed to one of ``buckets``
embeddings; a text is the mean of its embeddings, and a linear softmax on that
gives the languages. A temperature is then fitted on rows that training did not
see, so that a score is the probability of being right; a text is rejected if
its score is under ``min_score``, or if it has no letter.

The fit reads a bounded sample: at most PER_LANGUAGE labelled rows of each
language, SAMPLE_ROWS of all, whatever their length, of the LANGUAGES most frequent
languages at most. Rows are chosen by a hash of identifier, text and language, and copies count
once, so repeated or missing identifiers and any number of copies leave the choice as it is. Tasks turn the
sampled texts, whole, into shares of buckets; only these reach the driver, SAMPLE_BYTES of them at most. Rows
of equal texts lie on one side of the split between training and calibration.
Predictions read every whole text; mean and softmax are exact at any length,
block by block.

Null texts and texts without a letter get ``und`` with score 0 and are rejected.
Without any labelled row all texts do. Ties between languages go to the first in
order. Repeated rows are judged one by one; other columns are not read. A table
without rows gives one without rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sample import choose, gather, row_hash
from .shared import map_batches, written
from .words import blocks, utf8

PER_LANGUAGE, SAMPLE_ROWS, LANGUAGES, SAMPLE_BYTES = 400, 8000, 256, 256 << 20
BUCKET_BITS, DIMENSIONS, SIZES, EPOCHS, BATCH, RATE = 17, 8, (2, 3, 4), 5, 16, 0.2
MIN_SCORE = 0.5

_MARK = np.zeros(256, dtype=np.uint32)
_MARK[0x61:0x7B] = np.arange(0x61, 0x7B)
_MARK[0x80:] = np.arange(0x80, 0x100)


def subwords(block, bits: int = BUCKET_BITS):
    """For each size of subword: buckets in order, and where each text's begin and end. A text's first subwords start at the border before it."""
    marks = np.concatenate(([0], _MARK[block.folded])).astype(np.uint32)
    start, end = block.text_start[:-1], block.text_start[1:]
    run = marks
    for size in range(2, SIZES[-1] + 1):
        run = run[:-1] * np.uint32(0x01000193) + marks[size - 1 :]
        if size in SIZES:
            mixed = (run ^ np.uint32(size * 0x9E37)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield mixed >> np.uint32(32 - bits), start, np.maximum(start, end + 2 - size)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # of each bucket for each language: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for at, block in blocks(texts):
            total, count = np.zeros((block.n_texts, len(self.languages))), np.zeros(block.n_texts)
            for bucket, start, end in subwords(block):
                full = np.flatnonzero(end > start)
                if len(full):
                    # pairs (start, end): every second sum is a text's
                    edges = np.stack((start[full], end[full]), axis=1).ravel()
                    values = np.concatenate((self.scores[bucket], np.zeros((1, len(self.languages)), np.float32)))
                    total[full] += np.add.reduceat(values, np.minimum(edges, len(bucket)), axis=0)[::2]
                    count[full] += (end - start)[full]
            out[at : at + block.n_texts] = total / np.maximum(count, 1)[:, None]
        return out + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: distinct buckets and their weights, which sum to 1."""
    out = []
    for _, block in blocks(texts):
        parts = list(subwords(block))
        for i in range(block.n_texts):
            bucket, times = np.unique(np.concatenate([b[s[i] : e[i]] for b, s, e in parts]), return_counts=True)
            out.append((bucket, (times / max(times.sum(), 1)).astype(np.float32)))
    return out


def fit(texts: list[bytes], labels: list[str], seed: int = 1) -> LanguageModel:
    return fit_rows(_rows(texts), labels, [zlib.crc32(t) for t in texts], seed)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], prints: list[int], seed: int = 1) -> LanguageModel:
    """Train on the rows of four of five prints of texts and set the temperature on the others."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    held = np.array(prints) % 5 == 4
    if held.all():
        held[:] = False
    use = np.array([i for i in np.flatnonzero(~held) if len(rows[i][0])], dtype=np.int64)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    weights_seen, bias_seen, embedding_seen = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6), np.full(1 << BUCKET_BITS, 1e-12, np.float32)
    steps, step = max(1, EPOCHS * -(-len(use) // BATCH)), 0
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(use), max(1, -(-len(use) // BATCH))):
            if not len(chosen):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            buckets = np.concatenate([rows[i][0] for i in chosen])
            share = np.concatenate([rows[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            begin = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in chosen])[:-1]))
            hidden = np.add.reduceat(embedding[buckets] * share[:, None], begin, axis=0)
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error = (error / len(chosen)).astype(np.float32)
            for value, seen, slope in ((weights, weights_seen, hidden.T @ error), (bias, bias_seen, error.sum(axis=0))):
                seen += slope * slope
                value -= rate * slope / np.sqrt(seen)
            # each embedding's own step: its slope over the root of its squared slopes so far
            slope = share[:, None] * (error @ weights.T)[owner]
            np.add.at(embedding_seen, buckets, (slope * slope).mean(axis=1))
            np.subtract.at(embedding, buckets, rate * slope / np.sqrt(embedding_seen[buckets])[:, None])
    model = LanguageModel(languages, (embedding @ weights).astype(np.float32), bias.astype(np.float64))
    check = np.flatnonzero(held)
    if len(check):
        logits = np.stack([rows[i][1] @ model.scores[rows[i][0]] + model.bias for i in check])
        grid = np.geomspace(0.02, 20, 61)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).sum()))
    return model


def train(df: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel | None:
    """A model from a bounded sample of the rows for which ``labelled`` holds, or None if there are none."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("kind"), labelled.alias("labelled"))
    rows = rows.filter(F.col("labelled") & F.col("kind").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("kind", row_hash(F.col("kind"), F.col("id"), F.col("text"), seed=6).alias("dice"), "text")
    counts = rows.groupBy("kind").agg(F.approx_count_distinct("dice").alias("n"), F.count("*").alias("all")).orderBy(F.desc("all"), "kind").limit(LANGUAGES)
    most = F.least(F.lit(per_language), F.floor(F.lit(SAMPLE_ROWS) / F.count("*").over(Window.partitionBy())))  # a row for each language
    counts = written(counts.select("kind", "n", most.cast("int").alias("most")))
    shares = lambda texts: [(*row, [zlib.crc32(t)]) for t, row in zip(texts, _rows(texts), strict=True)]
    found = gather(rows.select("dice", "text"), written(choose(rows, counts)), shares, ("int", "float", "long"), sample_bytes)
    if not found:
        return None
    found.sort(key=lambda r: (int(r[3][0]), r[0]))
    return fit_rows([(buckets, shares) for _, buckets, shares, _ in found], [r[0] for r in found], [int(r[3][0]) for r in found])


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", *, min_score: float = MIN_SCORE, passing: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred, score, accepted, and each column c in ``passing`` as keep_c."""
    kind = df.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kept = [df[c].alias(f"keep_{c}") for c in passing or []]
    rows = df.select(df[id_col].alias("doc_id"), F.when(letters, df[text_col]).alias("text"), *kept)
    extra = "".join(f", `keep_{c}` {df.schema[c].dataType.simpleString()}" for c in passing or [])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            real = np.flatnonzero(~np.asarray(batch.column(1).is_null()))
            if model is not None and len(real):
                p = model.probabilities([texts[i] for i in real])
                best = p.argmax(axis=1)
                lang[real] = [model.languages[k] for k in best]
                score[real] = p[np.arange(len(real)), best]
            accepted = (score >= min_score) & (lang != "und")
            columns = [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(accepted.astype(bool)), *batch.columns[2:]]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted", *batch.schema.names[2:]])

        return step

    return map_batches(rows, make, f"doc_id {kind}, lang_pred string, score double, accepted boolean{extra}")
