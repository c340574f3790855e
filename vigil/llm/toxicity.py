"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a hashed word vector and the mean of the word's hashed character n-gram vectors. All overlapping
windows of a text are scored; the text's score is that of its worst window. In training, the window that scores highest
stands for its document. What a step adds to the gates depends on the word alone, so it is worked out once per distinct word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Seen, crc_held_out, grown, labelled_sample, mix, raw, slices, split_words, text_udf, texts, trained

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 15, 16
#: Lengths of the character n-grams, in bytes, whose mean is the character input.
GRAMS = (3, 5, 7)
DIM, HIDDEN, ATT = 8, 8, 8
#: Labelled rows that a model is trained on at most.
TRAIN_ROWS = 4000
#: Windows worked on at a time.
BLOCK = 4096
#: Words whose inputs a task remembers.
CACHE = 250_000
#: Bytes of distinct words whose character n-grams are worked out at a time; a longer word is worked out in such parts.
WORD_BYTES = 1 << 17
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words without ASCII punctuation at their ends: codes, offsets of the texts, distinct words."""
    codes, offsets, distinct = split_words(arr, lower=True)
    bare = pc.ascii_trim(distinct, characters=PUNCT).dictionary_encode()
    return (np.asarray(bare.indices)[codes] if len(codes) else codes), offsets, bare.dictionary


def row_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of so many consecutive rows each."""
    out = np.zeros((len(n), values.shape[1]), values.dtype)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(n) - n)[full], axis=0)
    return out


def framed(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each between the marks 1 and 2, and their lengths without marks."""
    body, offsets = raw(distinct)
    n = len(offsets) - 1
    at = offsets + 2 * np.arange(n + 1)
    out = np.zeros(len(body) + 2 * n, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    out[inside] = body
    out[at[:-1]], out[at[1:] - 1] = 1, 2
    return out, np.diff(offsets)


def gram_hashes(marked: np.ndarray) -> list[np.ndarray]:
    """For each length, the buckets of the n-grams that begin at each place of marked bytes."""
    out, b = [], marked.astype(np.uint64)
    h = np.zeros(len(b), dtype=np.uint64)
    for k in range(1, max(GRAMS) + 1):
        h = h[: len(b) - k + 1] * np.uint64(0x100000001B3) + b[k - 1 :] + np.uint64(1) if len(b) >= k else h[:0]
        if k in GRAMS:
            out.append((mix(h + np.uint64(k << 40)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
    return out


def word_buckets(marked: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bucket of each word, by a polynomial over its marked bytes."""
    n = len(lens)
    at = np.concatenate(([0], np.cumsum(lens + 2)))
    if n == 1:  # in parts: it may be very long
        total, base, step = np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
        for lo in range(0, len(marked), WORD_BYTES):
            p = np.cumprod(np.full(len(marked[lo : lo + WORD_BYTES]), base))
            total = total + step * (marked[lo : lo + WORD_BYTES].astype(np.uint64) * p).sum(dtype=np.uint64)
            step = step * p[-1]
        sums = np.array([total])
    else:
        powers = np.cumprod(np.full(int(lens.max(initial=0)) + 2, 0x9E3779B97F4A7C15, dtype=np.uint64))
        place = np.arange(len(marked)) - np.repeat(at[:-1], lens + 2)
        sums = np.add.reduceat(marked * powers[place], at[:-1]) if n else np.zeros(0, np.uint64)
    return (mix(sums) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def word_inputs(distinct: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each distinct word: its bucket, and for each length the buckets of its character n-grams and how many it has."""
    marked, lens = framed(distinct)
    left = np.arange(len(marked)) - np.repeat(np.cumsum(lens + 2), lens + 2)  # less by how many bytes are left of its word
    grams = [(h[left[: len(h)] <= -k], np.maximum(lens + 3 - k, 0)) for k, h in zip(GRAMS, gram_hashes(marked), strict=True)]
    return word_buckets(marked, lens), grams


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every overlapping window, and the offsets of the texts among windows; an empty text has one of length 0."""
    lens = np.diff(offsets)
    n = np.maximum(1, -(-(lens - WINDOW) // STRIDE) + 1)
    at = np.concatenate(([0], np.cumsum(n)))
    start = (np.arange(at[-1]) - np.repeat(at[:-1], n)) * STRIDE
    return np.repeat(offsets[:-1], n) + start, np.minimum(WINDOW, np.repeat(lens, n) - start), at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": np.zeros((1 << WORD_BITS, DIM), np.float32), "gram": r(1 << GRAM_BITS, DIM, scale=0.3)}
        for d in "fb":
            self.p |= {f"W{d}": r(2 * DIM, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": r(2 * HIDDEN, ATT), "v": r(ATT), "o": r(2 * HIDDEN), "k": np.array([-2.0], np.float32)}

    def inputs(self, distinct: pa.Array) -> np.ndarray:
        """Input of each distinct word: its vector, and the mean of its n-grams' vectors. Memory does not follow the words' bytes."""
        return np.concatenate([np.zeros((0, 2 * DIM), np.float32), *(self._inputs(part) for part in slices(distinct, WORD_BYTES))])

    def _inputs(self, distinct: pa.Array) -> np.ndarray:
        if len(distinct) == 1:  # in parts that overlap: it may be very long
            marked, lens = framed(distinct)
            total, n, more = np.zeros(DIM, np.float64), 0, max(GRAMS) - 1
            for lo in range(0, len(marked), WORD_BYTES):
                for h in gram_hashes(marked[lo : lo + WORD_BYTES + more]):
                    total += self.p["gram"][h[:WORD_BYTES]].sum(axis=0, dtype=np.float64)
                    n += len(h[:WORD_BYTES])
            return np.concatenate((self.p["word"][word_buckets(marked, lens)], (total / max(n, 1)).astype(np.float32)[None, :]), axis=1)
        bucket, grams = word_inputs(distinct)
        n = np.maximum(sum(c for _, c in grams), 1)[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][bucket], sum(row_sums(self.p["gram"][g], c) for g, c in grams) / n), axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Inputs and what they add to the gates, [words + 1, 3 * HIDDEN]; the last stands for no word."""
        x = np.concatenate((x, np.zeros((1, 2 * DIM), np.float32)))
        return x, {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def forward(self, ids: np.ndarray, there: np.ndarray, gates: dict[str, np.ndarray], keep: bool = False):
        """ids, there: [WINDOW, windows]. Returns the logits and, if kept, all that the way back needs."""
        t, n = ids.shape
        h = HIDDEN
        states = np.empty((t, 2 * h, n), dtype=np.float32)
        kept = {"f": [None] * t, "b": [None] * t}
        full = bool(there.all())
        for k, d in enumerate("fb"):
            u, table = np.ascontiguousarray(self.p[f"U{d}"].T), np.ascontiguousarray(gates[d].T)
            s = np.zeros((h, n), dtype=np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                g = np.take(table, ids[i], axis=1)
                q = u @ s
                zr = sigmoid(g[: 2 * h] + q[: 2 * h])
                c = np.tanh(g[2 * h :] + zr[h:] * q[2 * h :])
                new = c + zr[:h] * (s - c)
                if not full:
                    new = np.where(there[i], new, s)
                if keep:
                    kept[d][i] = (s, zr, q[2 * h :], c)
                s = new
                states[i, k * h : (k + 1) * h] = s
        a = np.tanh(np.matmul(self.p["A"].T, states))  # [t, ATT, n]
        e = np.einsum("a,tan->tn", self.p["v"], a)
        e = np.where(there, e, np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        ctx = np.einsum("tn,thn->hn", w, states)
        logit = self.p["o"] @ ctx + self.p["k"][0]
        return logit, (states, kept, a, w, ctx) if keep else None

    def backward(self, ids, there, x, saved, d_logit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the inputs [WINDOW, windows, 2 * DIM]."""
        states, kept, a, w, ctx = saved
        t, n = ids.shape
        h, p = HIDDEN, self.p
        g = {"o": ctx @ d_logit, "k": np.array([d_logit.sum()], np.float32)}
        d_ctx = p["o"][:, None] * d_logit
        d_w = np.einsum("hn,thn->tn", d_ctx, states)
        d_e = np.where(there, w * (d_w - (w * d_w).sum(axis=0)), 0)
        d_states = w[:, None, :] * d_ctx
        d_a = p["v"][None, :, None] * d_e[:, None, :] * (1 - a * a)
        g["v"] = np.einsum("tan,tn->a", a, d_e)
        g["A"] = np.einsum("thn,tan->ha", states, d_a)
        d_states = d_states + np.matmul(p["A"], d_a)
        d_x = np.zeros((t, n, 2 * DIM), np.float32)
        for k, d in enumerate("fb"):
            g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = np.zeros_like(p[f"U{d}"]), np.zeros_like(p[f"c{d}"]), np.zeros_like(p[f"W{d}"])
            d_s = np.zeros((h, n), np.float32)
            for i in range(t - 1, -1, -1) if d == "f" else range(t):
                s, zr, q, c = kept[d][i]
                d_s = d_s + d_states[i, k * h : (k + 1) * h]
                m = there[i].astype(np.float32)
                d_new, d_old = d_s * m, d_s * (1 - m)
                z, r = zr[:h], zr[h:]
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (s - c) * z * (1 - z)
                d_r = d_c * q * r * (1 - r)
                d_q = np.concatenate((d_z, d_r, d_c * r))
                d_g = np.concatenate((d_z, d_r, d_c))
                d_s = d_old + d_new * z + p[f"U{d}"] @ d_q
                g[f"U{d}"] += s @ d_q.T
                g[f"c{d}"] += d_g.sum(axis=1)
                g[f"W{d}"] += x[ids[i]].T @ d_g.T
                d_x[i] += d_g.T @ p[f"W{d}"].T
        return g, d_x

    def logits(self, codes: np.ndarray, offsets: np.ndarray, gates: dict[str, np.ndarray]):
        """Logits of all windows, with their first words, lengths and the offsets of texts among them."""
        first, lens, at = windows(offsets)
        out = np.empty(len(first), dtype=np.float32)
        for lo in range(0, len(first), BLOCK):
            f, n = first[lo : lo + BLOCK], lens[lo : lo + BLOCK]
            words = np.append(codes[f[0] : (f + n).max()], -1)  # consecutive windows share their words
            ids, there = self.ids(np.arange(len(words) - 1), f - f[0], n, len(words) - 1)
            out[lo : lo + BLOCK] = self.forward(ids, there, {d: g[words] for d, g in gates.items()})[0]
        return out, first, lens, at

    @staticmethod
    def ids(codes, first, lens, none):
        step = np.arange(WINDOW)[:, None]
        there = step < lens
        ids = np.where(there, np.append(codes, none)[np.minimum(first + step, len(codes))], none)
        return ids, there

    def __call__(self, arr: pa.Array) -> pa.Array:
        """Score of each text (no nulls): the highest of its windows."""
        if not len(arr):
            return pa.array([], pa.float64())
        if not hasattr(self, "seen"):
            self.seen, self.known = Seen(CACHE), np.zeros((1 << 12, 2 * DIM), np.float32)
        codes, offsets, distinct = tokens(arr)
        places, new, n = self.seen(distinct.cast(pa.large_binary()))  # bytes: a text need not be valid UTF-8
        if len(new):
            self.known = grown(self.known, n + len(new))
            self.known[n : n + len(new)] = self.inputs(new.view(pa.large_string()))
        _, gates = self.gates(self.known[places])
        logit, _, _, at = self.logits(codes, offsets, gates)
        return pa.array(1 / (1 + np.exp(-np.maximum.reduceat(logit, at[:-1]).astype(np.float64))))


def train(samples: list[str], labels: np.ndarray, epochs: int = 6, least_steps: int = 300, batch: int = 48, rate: float = 0.015, seed: int = 3) -> Network:
    """Adam over batches of documents; each is stood for by its highest window (a random one in the first epoch)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(samples):
        return net
    codes, offsets, distinct = tokens(texts(pa.array(samples, pa.large_string())))
    parts = [word_inputs(part) for part in slices(distinct, WORD_BYTES)]
    bucket = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, np.int64)
    grams = [tuple(np.concatenate([g[k][x] for _, g in parts]) if parts else np.zeros(0, np.int64) for x in range(2)) for k in range(len(GRAMS))]
    n_grams = np.stack([c for _, c in grams], axis=1)
    total_grams = np.maximum(n_grams.sum(axis=1), 1).astype(np.float32)
    firsts = np.cumsum(n_grams, axis=0) - n_grams
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    per_epoch = -(-len(samples) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    total = epochs * per_epoch
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), batch):
            docs = np.sort(order[lo : lo + batch])
            own = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in docs])
            used, local = np.unique(own, return_inverse=True)
            mine = []  # the n-grams of the used words, length by length
            for k in range(len(GRAMS)):
                c = n_grams[used, k]
                mine.append((grams[k][0][np.repeat(firsts[used, k] - (np.cumsum(c) - c), c) + np.arange(c.sum())], c))
            drop = (rng.random(len(used)) < 0.5).astype(np.float32)[:, None]  # words often lack their own vector, so that characters count
            chars = sum(row_sums(net.p["gram"][g], c) for g, c in mine) / total_grams[used, None]
            x, gates = net.gates(np.concatenate((net.p["word"][bucket[used]] * drop, chars), axis=1))
            here = np.concatenate(([0], np.cumsum(np.diff(offsets)[docs])))
            if epoch:
                logit, first, lens, wat = net.logits(local, here, gates)
                best = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(wat[:-1], wat[1:], strict=True)])
            else:
                first, lens, wat = windows(here)
                best = (wat[:-1] + rng.random(len(docs)) * np.diff(wat)).astype(int)
            ids, there = net.ids(local, first[best], lens[best], len(used))
            logit, saved = net.forward(ids, there, gates, keep=True)
            d = ((1 / (1 + np.exp(-logit)) - labels[docs]) / len(docs)).astype(np.float32)
            g, d_x = net.backward(ids, there, x, saved, d)
            flat, dx = ids.ravel(), d_x.reshape(-1, 2 * DIM)
            per = np.zeros((len(used) + 1, 2 * DIM), np.float32)
            np.add.at(per, flat, dx)
            seen = np.flatnonzero(np.bincount(flat, minlength=len(used) + 1)[:-1])
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], bucket[used[seen]], per[seen, :DIM] * drop[seen])
            g["gram"] = np.zeros_like(net.p["gram"])
            for k in range(len(GRAMS)):
                c = n_grams[used[seen], k]
                ids_k = grams[k][0][np.repeat(firsts[used[seen], k] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                np.add.at(g["gram"], ids_k, np.repeat(per[seen, DIM:] / total_grams[used[seen], None], c, axis=0))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k, v in net.p.items():
                i = np.flatnonzero(g[k].any(axis=1)) if k in ("word", "gram") else slice(None)  # rows of a table that were used
                m[k][i] = 0.9 * m[k][i] + 0.1 * g[k][i]
                s[k][i] = 0.99 * s[k][i] + 0.01 * g[k][i] * g[k][i]
                v[i] -= (lr * (m[k][i] / (1 - 0.9**step)) / (np.sqrt(s[k][i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, most: int = TRAIN_ROWS) -> Network:
    """A network for labels.toxic from at most `most` labelled rows that aren't held out; untrained without labels."""
    return trained(labelled_sample(docs, labels, "toxic", mod, rest, most), train)


def score(text: Column | str, net: Network) -> Column:
    """Score of a text from 0 to 1, the highest of its windows; null counts as empty, which is one empty window."""
    return text_udf(lambda: net, "double")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, rest: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts score alike; rows that repeat repeat."""
    net = fit(docs, labels, mod, rest)
    out = docs.select("doc_id", crc_held_out("doc_id", mod, rest).alias("held_out"), score("text", net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
