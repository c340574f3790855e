"""Quality scores by supervised subword embeddings.

Words, their character n-grams (within word bounds) and word pairs are hashed into a table of learned vectors; a document is
the average of the vectors of all its features; a softmax layer gives the two classes. Trained by numpy stochastic gradient
descent on a bounded sample of labelled rows. Scoring uses that average and softmax are linear up to the end: each bucket has
one number, each distinct word one sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_held_out, labelled_sample, mix, raw, slices, split_words, sums, text_udf, texts, trained

BITS = 17
DIM = 8
GRAMS = (2, 3, 4)
#: Labelled rows that a model is trained on at most.
TRAIN_ROWS = 4000
REPEAT = 0  # the bucket of a word that follows itself


def word_features(distinct: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams and the whole of each distinct word; their offsets; the words' 64-bit hashes."""
    body, offsets = raw(distinct)
    n = len(offsets) - 1
    lens = np.diff(offsets)
    # each word between marks, 1 and 2
    at = offsets + 2 * np.arange(n + 1)
    framed = np.zeros(len(body) + 2 * n, dtype=np.uint64)
    inside = np.ones(len(framed), dtype=bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    framed[inside] = body
    framed[at[:-1]], framed[at[1:] - 1] = 1, 2
    word = np.repeat(np.arange(n), lens + 2)
    place = np.arange(len(framed)) - at[:-1][word]
    powers = np.cumprod(np.full(int(lens.max(initial=0)) + 2, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
    whole = mix(sums(framed * powers[place], at) if n else np.zeros(0, np.uint64))
    owners, buckets = [np.arange(n)], [whole]
    for k in GRAMS:
        if len(framed) < k:
            continue
        h = np.zeros(len(framed) - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + framed[j : len(framed) - k + 1 + j] + np.uint64(1)
        ok = np.flatnonzero(word[: len(h)] == word[k - 1 :])
        owners.append(word[ok])
        buckets.append(mix(h[ok] + np.uint64(k << 40)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(buckets)[order] >> np.uint64(64 - bits)).astype(np.int64)
    return np.where(bucket == REPEAT, 1, bucket), np.searchsorted(owner[order], np.arange(n + 1)), whole


def pair_buckets(codes: np.ndarray, whole: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word with its predecessor in the text (-1 for first words)."""
    h = whole[codes]
    out = np.full(len(codes), -1, dtype=np.int64)
    if len(codes) > 1:
        b = (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - bits)).astype(np.int64)
        out[1:] = np.where(codes[1:] == codes[:-1], REPEAT, np.where(b == REPEAT, 1, b))
    starts = offsets[:-1]
    out[starts[starts < offsets[1:]]] = -1
    return out


class Model:
    """The number of each bucket (its vector times the difference of the classes' weights) and the bias."""

    def __init__(self, number: np.ndarray, bias: float):
        self.number, self.bias = number.astype(np.float32), float(bias)

    def __call__(self, arr: pa.Array) -> pa.Array:
        """Probability of class 1 for texts without nulls."""
        codes, offsets, distinct = split_words(arr, lower=False)
        if not len(distinct):
            return pa.array(np.full(len(arr), 1 / (1 + np.exp(-self.bias))))
        bucket, at, whole = word_features(distinct)
        number = np.append(self.number, np.float32(0)).astype(np.float64)
        value, count = sums(number[bucket], at), np.diff(at)
        pair = pair_buckets(codes, whole, offsets)
        total = sums(value[codes] + number[pair], offsets)
        n = sums(count[codes] + (pair >= 0), offsets)
        return pa.array(1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias))))


def train(samples: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 1.0, seed: int = 1) -> Model:
    """SGD over documents with a linearly falling rate; vectors of DIM numbers for 2**BITS buckets, softmax over two classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    docs = []
    arr = pa.array(samples, pa.large_string())
    for part in slices(arr):
        codes, offsets, distinct = split_words(texts(part), lower=False)
        bucket, at, whole = word_features(distinct) if len(distinct) else (np.zeros(0, int), np.zeros(1, int), np.zeros(0, np.uint64))
        pair = pair_buckets(codes, whole, offsets)
        for i in range(len(part)):
            lo, hi = offsets[i], offsets[i + 1]
            used, times = np.unique(codes[lo:hi], return_counts=True)
            lens = at[used + 1] - at[used]
            idx = bucket[np.repeat(at[used] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())] if len(used) else bucket[:0]
            feats = np.concatenate((idx, pair[lo:hi][pair[lo:hi] >= 0]))
            w = np.concatenate((np.repeat(times, lens), np.ones(len(feats) - len(idx))))
            ids, back = np.unique(feats, return_inverse=True)
            share = np.bincount(back, w, minlength=len(ids)) if len(ids) else np.zeros(0)
            docs.append((ids, (share / max(share.sum(), 1)).astype(np.float32)))
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            own = vectors[ids]
            hidden = share @ own
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = weights @ p
            weights -= lr * hidden[:, None] * p
            bias -= lr * 0.1 * p
            vectors[ids] = own - (lr * 20) * share[:, None] * back
            step += 1
    return Model(vectors @ (weights[:, 1] - weights[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality from at most `most` labelled rows that aren't held out. Without labels every score is 0.5."""
    return trained(labelled_sample(docs, labels, "quality", mod, rest, most), train)


def score(text: Column | str, model: Model) -> Column:
    """Score of a text from 0 to 1; null counts as empty, whose score is the bias alone."""
    return text_udf(lambda: model, "double")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, rest: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts score alike; rows that repeat repeat."""
    model = fit(docs, labels, mod, rest)
    out = docs.select("doc_id", crc_held_out("doc_id", mod, rest).alias("held_out"), score("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
