"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens that no piece of the vocabulary crosses. The distinct ones of a slice lie in ragged numpy
arrays (symbols and offsets). In every round each pre-token's best pair is merged, in all of them at once; the symbols that
survive are counted. A symbol outside the vocabulary counts as its UTF-8 bytes. A long pre-token has rounds of its own, over a
linked array whose blocks keep their lowest rank, so that a round costs what it changes and not the whole length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import raw, sums, text_udf

NONE = np.int64(1) << 40
SPACE = "▁"
#: Pre-tokens with more characters are merged in a linked array of their own, in blocks of BLOCK.
LONG, BLOCK = 512, 256
CACHE = 400_000


class Merger:
    """Counts the pieces of pre-tokens for a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in normal}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in piece):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        # equal scores share a rank, so that the leftmost of them goes first
        rank, last = {}, None
        for i in order:
            if last is None or sp.get_score(i) != last[0]:
                last = (sp.get_score(i), len(rank))
            rank[i] = last[1]
        self.symbol = {p: i for p, i in piece.items() if len(p) == 1}
        self.width = sp.get_piece_size()
        self.other: dict[str, int] = {}  # characters outside the vocabulary
        # only parts that can come up as symbols matter: pieces and, inside pieces, single characters
        pairs = {}
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = self._id(p[:k], piece), self._id(p[k:], piece)
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (rank[i], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys, self.ranks, self.made = keys, np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64), np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        bits = 22  # the first key of a slot answers at once; where more share it, a search does
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.slots[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.more = np.zeros(1 << bits, dtype=bool)
        self.more[slot[self.slots[slot] != np.arange(len(keys))]] = True
        self.cache: dict[str, int] = {}
        # ranks after whose merge a better one can come up next to it; their pairs are merged one at a time
        made = dict(zip(self.made.tolist(), self.ranks.tolist(), strict=True))
        self.restless = {made[x] for k, (r, _) in pairs.items() for x in (k >> 32, k & 0xFFFFFFFF) if made.get(x, -1) >= r}

    def _id(self, text: str, piece: dict[str, int]) -> int | None:
        if text in piece:
            return piece[text]
        return self._char(text) if len(text) == 1 else None

    def _char(self, c: str) -> int:
        return self.symbol[c] if c in self.symbol else self.other.setdefault(c, self.width + len(self.other))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        at = self.slots[slot].astype(np.int64)
        good = (at >= 0) & (self.keys[at] == keys)
        out = np.where(good, at, -1)
        rest = np.flatnonzero(~good & self.more[slot])
        if len(rest):
            p = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            out[rest] = np.where(self.keys[p] == keys[rest], p, -1)
        return out

    def merged(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token (none empty), by rounds over ragged arrays."""
        lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), dtype=np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        ids = np.array([self._char(chr(c)) for c in chars], dtype=np.int64)
        size = np.array([1 if chr(c) in self.symbol else len(chr(c).encode()) for c in chars], dtype=np.int64)
        sym, weight = ids[back], size[back]
        out = np.zeros(len(tokens), dtype=np.int64)
        seq = np.repeat(np.arange(len(tokens)), lens)  # numbered anew as sequences end
        names = np.arange(len(tokens))
        at = np.full(len(sym), -1, dtype=np.int64)  # the pair of a symbol and its right neighbour
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        at[inner] = self._find(sym[inner], sym[inner + 1])
        rank = np.where(at >= 0, self.ranks[at], NONE)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                counts = np.add.reduceat(weight, starts)
                out[names[done]] = counts[done]
                if done.all():
                    break
                keep = ~done[seq]
                names = names[~done]
                sym, weight, rank, at, seq = sym[keep], weight[keep], rank[keep], at[keep], seq[keep]
                seq = (np.cumsum(~done) - 1)[seq]
                best = best[~done]
            hit = np.flatnonzero(rank == best[seq])
            first = hit[np.concatenate(([True], seq[hit][1:] != seq[hit][:-1]))]  # the leftmost of each sequence
            sym[first], weight[first] = self.made[at[first]], 1
            keep = np.ones(len(sym), dtype=bool)
            keep[first + 1] = False
            first = first - np.arange(len(first))  # its place once the right parts are gone
            sym, weight, rank, at, seq = sym[keep], weight[keep], rank[keep], at[keep], seq[keep]
            for i in (first, first - 1):
                i = i[i >= 0]
                right = np.minimum(i + 1, len(sym) - 1)
                inside = (i + 1 < len(sym)) & (seq[right] == seq[i])
                found = np.where(inside, self._find(sym[i], sym[right]), -1)
                at[i], rank[i] = found, np.where(found >= 0, self.ranks[found], NONE)
        return out

    def long(self, token: str) -> int:
        """Pieces of one long pre-token. In a round all its pairs of the lowest rank are merged from the left, or the leftmost if that can bring up a better one."""
        points = np.frombuffer(token.encode("utf-32-le"), dtype=np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        sym = np.array([self._char(chr(c)) for c in chars], dtype=np.int64)[back]
        weight = np.array([1 if chr(c) in self.symbol else len(chr(c).encode()) for c in chars], dtype=np.int64)[back]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(-(-n // BLOCK) * BLOCK, NONE)
        at = np.full(n, -1, dtype=np.int64)
        at[:-1] = self._find(sym[:-1], sym[1:])
        rank[:n] = np.where(at >= 0, self.ranks[at], NONE)
        blocks = rank.reshape(-1, BLOCK)
        least = blocks.min(axis=1)
        while (best := least.min()) != NONE:
            own = np.flatnonzero(least == best)
            if int(best) in self.restless:
                hits = own[:1] * BLOCK + np.argmin(blocks[own[0]])
            else:
                row, col = np.nonzero(blocks[own] == best)
                hits = own[row] * BLOCK + col
                follows = np.concatenate(([False], after[hits[:-1]] == hits[1:]))  # shares a symbol with the one before
                place = np.arange(len(hits))
                hits = hits[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            gone = after[hits]
            sym[hits], weight[hits], weight[gone], rank[gone] = self.made[at[hits]], 1, 0, NONE
            after[hits] = after[gone]
            inner = after[hits] < n
            before[after[hits][inner]] = hits[inner]
            new = np.unique(np.concatenate((hits, before[hits])))
            new = new[new >= 0]
            right = after[new]
            found = np.where(right < n, self._find(sym[new], sym[np.minimum(right, n - 1)]), -1)
            at[new], rank[new] = found, np.where(found >= 0, self.ranks[found], NONE)
            changed = np.unique(np.concatenate((new, gone)) // BLOCK)
            least[changed] = blocks[changed].min(axis=1)
        return int(weight.sum())

    def count(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each distinct pre-token; those of earlier slices are remembered."""
        out = np.array([self.cache.get(t, -1) for t in tokens], dtype=np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [tokens[i] for i in new]
            short = [i for i, t in enumerate(fresh) if len(t) <= LONG]
            got = np.zeros(len(fresh), dtype=np.int64)
            if short:
                got[short] = self.merged([fresh[i] for i in short])
            for i, t in enumerate(fresh):
                if len(t) > LONG:
                    got[i] = self.long(t)
            out[new] = got
            if len(self.cache) + len(fresh) > CACHE:
                self.cache.clear()
            self.cache.update((t, n) for t, n in zip(fresh, got.tolist(), strict=True) if len(t) <= 32)
        return out

    def __call__(self, arr: pa.Array) -> pa.Array:
        """Piece counts of texts without nulls."""
        marked = pc.replace_substring(arr, " ", SPACE)
        marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar(SPACE, arr.type), marked, pa.scalar("", arr.type)))
        lines = pc.split_pattern(marked, "\n")
        n_lines = np.asarray(pc.list_value_length(lines), dtype=np.int64)
        line_at = np.concatenate(([0], np.cumsum(n_lines)))
        flat = lines.flatten()
        # a cut before the first space sign of each run: "\0" can't be told from a text's own, so cut at the sign and put it back
        parts = pc.split_pattern(flat, SPACE)
        part_at = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(parts), dtype=np.int64))))
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        words = coded.dictionary.to_pylist()
        first = np.zeros(len(codes), dtype=bool)
        first[part_at[:-1][part_at[:-1] < part_at[1:]]] = True
        empty = np.array([w == "" for w in words], dtype=bool)[codes] if len(words) else np.zeros(0, bool)
        # space signs before a part: one, and one more for each empty part just before it; the first part of a line has none
        gap = np.where(first, 0, 1)
        ends = np.zeros(len(codes), dtype=bool)
        ends[part_at[1:][part_at[:-1] < part_at[1:]] - 1] = True
        closes = ~empty | ends  # a pre-token ends here
        total = np.cumsum(gap)
        where = np.flatnonzero(closes)
        signs = np.diff(np.concatenate(([0], total[where])))
        word = codes[where]
        key = word * (1 << 32) + signs
        distinct, back = np.unique(key, return_inverse=True)
        tokens = [SPACE * int(k & 0xFFFFFFFF) + words[int(k >> 32)] for k in distinct]
        counts = np.zeros(len(tokens), dtype=np.int64)
        full = [i for i, t in enumerate(tokens) if t]
        if full:
            counts[full] = self.count([tokens[i] for i in full])
        each = np.zeros(len(codes), dtype=np.int64)
        each[where] = counts[back]
        per_line = sums(each, part_at)
        return pa.array(sums(per_line, line_at) + n_lines - 1, pa.int64())  # each newline is a byte piece


def token_count(text: Column | str, model: str) -> Column:
    """Pieces of a text by the sentencepiece BPE model at `model` (a path every executor has); null counts as empty: 0."""
    return text_udf(lambda: Merger(model), "bigint")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. Null text is empty: 0 bytes, 0 tokens. Rows that repeat repeat."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, model).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
