"""Toxicity by non-negative positive-unlabelled learning in numpy.

Two classifiers are trained from confirmed toxic texts and unlabelled ones by
the same risk, with class prior p and logistic loss l:

    p * mean_toxic l(score) + max(0, mean_unlabelled l(-score) - p * mean_toxic l(-score))

No text is ever taken as confirmed clean. The first is linear in hashed words
and word beginnings, over the root of the text's length; it gives each word a
weight. The second reads a text's summary of those weights: how many words stand
out, how many different ones, how strongly, and how long the text is. Its
probability is the score. Where a batch's corrected risk for unlabelled texts
falls under zero, the step goes back on it, as non-negative estimation asks.

The fit reads bounded samples: at most ``TOXIC_ROWS`` confirmed and
``UNLABELLED_ROWS`` other rows, whatever their length, chosen by a hash of identifier and
text; copies count once, so neither they nor repeated identifiers weigh on the choice. Tasks turn the sampled
texts, whole, into counts of hashed words; only these reach the driver, ``SAMPLE_BYTES`` of
them at most. Scores read every whole text. The prior is the share of confirmed toxic rows among reviewed ones
unless it is given.

Null and empty texts have no words and get the score that the classifier gives
to an empty summary. Without any confirmed toxic row every score is 0. Labels
repeated for one identifier count as toxic if any is. Repeated rows are scored one
by one; other columns are not read. A table without rows gives one without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import choose, gather, row_hash
from .shared import map_batches, text_or_empty, written
from .words import blocks, mix, utf8

TOXIC_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 2000, 6000, 256 << 20
BUCKET_BITS, BEGINNING, EPOCHS, BATCH, RATE, SEEN, STEPS = 18, 5, 8, 128, 0.3, 1e-5, 400


def word_buckets(block) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the bucket of the word and that of its first bytes."""
    shift = np.uint64(64 - BUCKET_BITS)
    whole = block.word_hashes()
    begin = mix(block.hash_spans(block.start, np.minimum(block.end, block.start + BEGINNING)) + np.uint64(BEGINNING))
    return (whole >> shift).astype(np.int64), (begin >> shift).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk_slope(score: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the non-negative risk in each score of a batch of toxic and unlabelled texts."""
    p, u = _sigmoid(score), ~toxic
    n_p, n_u = max(1, toxic.sum()), max(1, u.sum())
    rest = np.logaddexp(0, score[u]).sum() / n_u - prior * np.logaddexp(0, score[toxic]).sum() / n_p
    slope = np.zeros(len(score))
    if rest >= 0:
        slope[toxic] = prior * (p[toxic] - 1) / n_p - prior * p[toxic] / n_p
        slope[u] = p[u] / n_u
    else:  # the estimate overfits: step back from it
        slope[toxic] = prior * p[toxic] / n_p
        slope[u] = -p[u] / n_u
    return slope


def _batches(toxic: np.ndarray, rng: np.random.Generator, epochs: int):
    """Batches that hold both kinds in the sample's shares."""
    n = max(1, len(toxic) // BATCH)
    kinds = [np.flatnonzero(toxic), np.flatnonzero(~toxic)]
    for _ in range(max(epochs, STEPS // n)):
        for parts in zip(*(np.array_split(rng.permutation(k), n) for k in kinds), strict=True):
            if len(parts[0]) and len(parts[1]):
                yield np.concatenate(parts)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of each bucket
    level: float  # a word stands out above this
    mean: np.ndarray
    scale: np.ndarray
    summary_weights: np.ndarray
    bias: float

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 6))
        for at, block in blocks(texts):
            out[at : at + block.n_texts] = _summaries(block, self.weights, self.level)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(((self.summaries(texts) - self.mean) / self.scale) @ self.summary_weights + self.bias)


def _summaries(block, weights: np.ndarray, level: float) -> np.ndarray:
    whole, begin = word_buckets(block)
    strength = weights[whole] + weights[begin]
    out = np.zeros((block.n_texts, 6))
    n = np.diff(block.first)
    high = np.flatnonzero(strength > level)
    owner = np.searchsorted(block.first, high, side="right") - 1
    count = np.bincount(owner, minlength=block.n_texts)
    kinds = np.unique(owner * (1 << BUCKET_BITS) + begin[high]) >> BUCKET_BITS
    different = np.bincount(kinds, minlength=block.n_texts)
    total = np.bincount(owner, weights=strength[high], minlength=block.n_texts)
    length = np.maximum(n, 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.minimum(different, 8)
    out[:, 2] = np.log1p(total)
    out[:, 3] = np.log1p(200 * count / length)
    out[:, 4] = np.log1p(n)
    out[:, 5] = count >= 2
    return out


def counted_words(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct (word bucket, beginning bucket) pairs as one number, and how often each occurs."""
    out = []
    for _, block in blocks(texts):
        whole, begin = word_buckets(block)
        pair = whole << BUCKET_BITS | begin
        out += [np.unique(pair[a:b], return_counts=True) for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
    return out


def _summary(pairs: np.ndarray, times: np.ndarray, weights: np.ndarray, level: float) -> list[float]:
    """As a row of ``_summaries``, from counted words."""
    begin = pairs & ((1 << BUCKET_BITS) - 1)
    strength = weights[pairs >> BUCKET_BITS] + weights[begin]
    high = strength > level
    count, n = int(times[high].sum()), int(times.sum())
    return [np.log1p(count), min(len(np.unique(begin[high])), 8), np.log1p((strength[high] * times[high]).sum()), np.log1p(200 * count / max(n, 1)), np.log1p(n), count >= 2]


def fit(texts: list[bytes], toxic: np.ndarray, prior: float, seed: int = 1) -> ToxicityModel:
    return fit_counts(counted_words(texts), toxic, prior, seed)


def fit_counts(counts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, prior: float, seed: int = 1) -> ToxicityModel:
    """Train both classifiers on the counted words of confirmed toxic and unlabelled texts."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for pairs, times in counts:
        buckets = np.concatenate((pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)))
        bucket, place = np.unique(buckets, return_inverse=True)
        rows.append((bucket, (np.bincount(place, weights=np.concatenate((times, times)), minlength=len(bucket)) / np.sqrt(max(1, times.sum()))).astype(np.float32)))
    # only words of several confirmed texts can tell: with few texts, each has words that no other has
    having = np.bincount(np.concatenate([rows[i][0] for i in np.flatnonzero(toxic)]), minlength=1 << BUCKET_BITS)
    telling = having >= min(3, max(1, int(toxic.sum()) // 4))
    rows = [(b[telling[b]], v[telling[b]]) for b, v in rows]
    weights, seen, bias, bias_seen = np.zeros(1 << BUCKET_BITS, np.float32), np.full(1 << BUCKET_BITS, SEEN, np.float32), 0.0, SEEN
    for chosen in _batches(toxic, rng, EPOCHS):
        bucket = np.concatenate([rows[i][0] for i in chosen])
        value = np.concatenate([rows[i][1] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
        slope = risk_slope(np.bincount(owner, weights=value * weights[bucket], minlength=len(chosen)) + bias, toxic[chosen], prior)
        step = np.bincount(bucket, weights=value * slope[owner], minlength=1 << BUCKET_BITS)
        where = np.flatnonzero(step)
        seen[where] += step[where] ** 2
        weights[where] -= RATE * step[where] / np.sqrt(seen[where]) + 1e-4 * weights[where]
        bias_seen += slope.sum() ** 2
        bias -= RATE * slope.sum() / np.sqrt(bias_seen)
    # the level: what few words of unlabelled texts exceed, and most toxic texts' strongest words do
    strength = lambda pairs: weights[pairs >> BUCKET_BITS] + weights[pairs & ((1 << BUCKET_BITS) - 1)]
    strongest = np.array([strength(counts[i][0]).max() for i in np.flatnonzero(toxic) if len(counts[i][0])])
    level = float(0.4 * np.median(strongest)) if len(strongest) else 1.0
    model = ToxicityModel(weights, max(level, 1e-3), np.zeros(6), np.ones(6), np.zeros(6), 0.0)
    x = np.array([_summary(pairs, times, weights, model.level) for pairs, times in counts], dtype=np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.mean) / model.scale
    w, w_seen, b, b_seen = np.zeros(6), np.full(6, 1e-8), 0.0, 1e-8
    for chosen in _batches(toxic, rng, 6 * EPOCHS):
        slope = risk_slope(x[chosen] @ w + b, toxic[chosen], prior)
        step = x[chosen].T @ slope
        w_seen += step**2
        w -= RATE * step / np.sqrt(w_seen)
        b_seen += slope.sum() ** 2
        b -= RATE * slope.sum() / np.sqrt(b_seen)
    model.summary_weights, model.bias = w, float(b)
    return model


def train(df: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", *, prior: float | None = None, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel | None:
    """A model from rows for which ``learnable`` (of the column ``id``) holds, or None without any confirmed toxic row.

    Rows are chosen first, by a hash of identifier and text; then only the chosen texts are read, and copies count once.
    """
    confirmed = labels.select(labels[label_id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter(learnable & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = confirmed.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    texts = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).filter(learnable).withColumn("dice", row_hash(F.col("id"), F.col("text"), seed=7))
    rows = texts.select("id", "dice").join(confirmed.filter("toxic = 1"), "id", "left").select(F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("kind"), "dice")
    counts = rows.groupBy("kind").agg(F.approx_count_distinct("dice").alias("n")).withColumn("most", F.when(F.col("kind"), TOXIC_ROWS).otherwise(UNLABELLED_ROWS))
    chosen = written(choose(rows, written(counts)))
    if chosen.filter("kind").isEmpty():
        return None
    found = gather(texts.select("dice", "text"), chosen, counted_words, ("long", "long"), sample_bytes)
    toxic = np.array([kind for kind, *_ in found], dtype=bool)
    if not toxic.any():
        return None
    return fit_counts([(pairs, times) for _, pairs, times in found], toxic, min(max(prior, 0.001), 0.9))


def score_texts(df: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, score, predicted (1 from a score of 0.5)."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.scores(utf8(batch.column(1))) if model is not None else np.zeros(batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return step

    return map_batches(df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, score double, predicted int")
