"""Benchmark decontamination by greedy string tiling.

Seeds are hashed runs of `k` words. A bitmap of fixed size of the benchmark's seeds leaves few of a document's; those are joined
with the benchmark's, and each (document, item) that shares a seed is tiled: the longest matches are marked again and again,
none overlapping one marked before, found by running Karp-Rabin over runs of words. The share of an item's words that tiles
cover decides, so that passages are found whose parts stand in another order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, hinted, mix, raw, slices, split_words, stage, text_key, texts

MIN_MATCH = 5
COVERAGE = 0.5
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MULT = np.uint64(0x9E3779B97F4A7C15)
#: The bitmap has 2^BITS bits, whatever the benchmark's size.
BITS = 24
#: Pairs of equal runs of a document and an item that are worked on at a time.
PAIRS = 1 << 19
#: Rows of seeds or pairs that are broadcast at most (under 50 bytes each).
SMALL = 500_000


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words without ASCII punctuation at their ends, ragged; words of punctuation alone fall away."""
    codes, offsets, distinct = split_words(pc.utf8_lower(arr), lower=False)
    body, at = raw(pc.ascii_trim(distinct, characters=PUNCT))
    lens = np.diff(at)
    powers = np.cumprod(np.full(int(lens.max(initial=0)) + 1, MULT))
    place = np.arange(len(body)) - np.repeat(at[:-1], lens)
    own = np.zeros(len(lens), dtype=np.uint64)
    full = lens > 0
    if full.any():
        own[full] = mix(np.add.reduceat((body + np.uint64(1)) * powers[place], at[:-1][full]) ^ lens[full].astype(np.uint64))
    if not full.all():
        there = full[codes]
        offsets, codes = np.concatenate(([0], np.cumsum(there)))[offsets], codes[there]
    return own[codes], offsets


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all runs of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    h = np.full(len(values) - k + 1, np.uint64(k))
    for j in range(k):
        h = h * MULT + values[j : len(values) - k + 1 + j]
    return h


def matches(doc: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places in both texts and lengths of all matches of at least k words that can't be made longer, [3, matches].

    Karp-Rabin hashes of k words find equal runs, words confirm them; neighbours on a diagonal are one match. Pairs of places are
    worked on PAIRS at a time; a match that reaches the end of one part goes on in the next.
    """
    own, theirs = rolling(item, k), rolling(doc, k)
    order = np.argsort(own, kind="stable")
    lo, hi = (np.searchsorted(own[order], theirs, side) for side in ("left", "right"))
    total = np.concatenate(([0], np.cumsum(hi - lo)))
    out, going, a = [], np.zeros((3, 0), np.int64), 0
    while a < len(theirs):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        n = hi[a:b] - lo[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = order[np.repeat(lo[a:b] - (total[a:b] - total[a]), n) + np.arange(n.sum())]
        same = np.ones(len(i), dtype=bool)
        for t in range(k):
            same &= doc[i + t] == item[j + t]
        i, j = i[same], j[same]
        by = np.lexsort((i, i - j))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1)))) if len(i) else np.zeros(0, np.int64)
        runs = np.stack([i[first], j[first], np.diff(np.append(first, len(i)))])
        # those that go on from the part before
        at = {d: x for x, d in enumerate((going[0] - going[1]).tolist())}
        more = np.array([at.get(int(r[0] - r[1]), -1) if r[0] == a else -1 for r in runs.T], dtype=np.int64) if at else np.full(runs.shape[1], -1)
        on = more >= 0
        runs[2, on] += going[2, more[on]]
        runs[:2, on] = going[:2, more[on]]
        out.append(np.delete(going, more[on], axis=1))
        ends = runs[0] + runs[2] == b
        out.append(runs[:, ~ends])
        going, a = runs[:, ends], b
    found = np.concatenate([*out, going], axis=1)
    found[2] += k - 1
    return found


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[int, int, int]:
    """Greedy string tiling: words of the item that tiles cover, tiles, longest tile. Matches have k words at least.

    Matches are marked from the longest down, of equal ones the first in the document; one that a marked tile cuts is shortened
    and queued again. It ends when the item has no run of k unmarked words.
    """
    k = min(k, len(item))
    if not k or len(doc) < k:
        return 0, 0, 0
    found = matches(doc, item, k)
    found = found[:, np.lexsort((found[1], found[0], -found[2]))]
    heads = zip(*found, strict=True)
    head, cut = next(heads, None), []  # whole matches in order, and a heap of shortened ones
    in_doc, in_item, room = bytearray(len(doc)), bytearray(len(item)), bytes(k)
    covered = tiles = longest = 0
    while (head is not None or cut) and room in in_item:
        if head is None or (cut and cut[0] < (-int(head[2]), int(head[0]), int(head[1]))):
            n, i, j = heapq.heappop(cut)
            n = -n
        else:
            i, j, n = map(int, head)
            head = next(heads, None)
        a, b = in_doc[i : i + n], in_item[j : j + n]
        if 1 not in a and 1 not in b:
            in_doc[i : i + n] = in_item[j : j + n] = b"\1" * n
            covered, tiles, longest = covered + n, tiles + 1, max(longest, n)
            continue
        free = (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)) == 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # what is left of it
            if y - x >= k:
                heapq.heappush(cut, (x - y, i + x, j + x))
    return covered, tiles, longest


def _seeds(sizes: list[int], bitmap: bytes | None):
    """(id, key, h) for each distinct seed of a text, of those in the bitmap only. Without one: of an item, whose seeds have its words if it has fewer."""
    most = max(sizes, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            start = 0
            for part in slices(batch.column(2)):
                values, at = words(texts(part))
                ends, owner = np.repeat(at[1:], np.diff(at)), np.repeat(np.arange(len(part)), np.diff(at))
                found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for size in sizes:
                    h = rolling(values, size)
                    ok = np.arange(len(h)) + size <= ends[: len(h)]
                    if bits is None:  # one size for an item: its own
                        ok &= np.minimum(np.diff(at), most)[owner[: len(h)]] == size
                    else:
                        slot = h >> np.uint64(64 - BITS)
                        ok &= (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    ok = np.flatnonzero(ok)
                    found.append((owner[ok], h[ok]))
                own, h = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.lexsort((h, own))
                own, h = own[by], h[by]
                keep = np.concatenate(([True], (np.diff(own) != 0) | (h[1:] != h[:-1])))[: len(own)]
                rows = pa.array(own[keep] + start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[keep].view(np.int64))], names=["id", "key", "h"])
                start += len(part)

    return run


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.diff(words(texts(part))[1]) for part in slices(batch.column(2))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n, k))], names=["size"])

    return run


def _tiled(k: int, coverage: float):
    """Rows (doc_id, text_key, text, item_id, item_text) to those whose coverage reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                doc, item = words(texts(row.column(2)))[0], words(texts(row.column(4)))[0]
                covered, tiles, longest = tile(doc, item, k)
                if len(item) and covered >= coverage * len(item):
                    out.append((r, covered / len(item), tiles, longest, len(item)))
            at, cover, *rest = zip(*out, strict=True) if out else [()] * 5
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), pa.array(cover, pa.float64()), *(pa.array(x, pa.int32()) for x in rest)],
                names=["doc_id", "text_key", "item_id", "coverage", "tiles", "longest", "item_words"],
            )

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, k: int, coverage: float) -> DataFrame:
    """doc_id, text_key, item_id, coverage, tiles, longest, item_words for each distinct document and item at or over the threshold."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_key().alias("key"), "text")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), text_key().alias("key"), "text").where("text is not null").dropDuplicates(["id", "key"])
    sizes = sorted(r[0] for r in items.mapInArrow(freeing(_sizes(k)), "size bigint").where("size > 0").distinct().collect())  # from 1 to k
    seeds = stage(items.mapInArrow(freeing(_seeds(sizes, None)), "id bigint, key bigint, h bigint").select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "h"), "seeds")
    slot = seeds.select(F.shiftrightunsigned("h", 64 - BITS).alias("slot"))
    filled = slot.groupBy(F.expr("cast(slot >> 3 as int)").alias("byte")).agg(F.expr("bit_or(1 << cast(slot & 7 as int))").alias("bits"))
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for r in filled.toLocalIterator():  # at most one row for each byte of the bitmap
        bitmap[r[0]] = r[1]
    known = seeds.count()
    pairs = rows.where("text is not null").mapInArrow(freeing(_seeds(sizes, bitmap.tobytes())), "id bigint, key bigint, h bigint").join(hinted(seeds, known, SMALL), "h")
    pairs = stage(pairs.select("id", "key", "item_id", "item_key").distinct(), "pairs")
    n = pairs.count()
    # null ids meet as well
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    own = items.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("text").alias("item_text"))
    with_items = pairs.join(hinted(own, known, SMALL // 10), same("item_id", "i") & same("item_key", "k")).select(F.col("id").alias("d"), F.col("key").alias("dk"), "item_id", "item_text")
    both = rows.dropDuplicates(["id", "key"]) if n > SMALL // 10 else rows
    both = both.join(hinted(with_items, n, SMALL // 10), same("id", "d") & same("key", "dk")).select("id", "key", "text", "item_id", "item_text")
    found = both.mapInArrow(freeing(_tiled(k, coverage)), "doc_id bigint, text_key bigint, item_id bigint, coverage double, tiles int, longest int, item_words int")
    return stage(found.distinct(), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, coverage, tiles, longest, item_words.

    Documents without a match, null and empty texts, and items without words have no row. A null doc_id stays null. A document
    or an item whose row repeats counts once; rows of one id with different texts are looked at each. Items shorter than k words
    must occur whole. Empty tables give an empty result; other columns are not used.
    """
    return _leaks(docs, benchmark, k, coverage).drop("text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no item contaminates, with their columns."""
    gone = _leaks(docs, benchmark, k, coverage).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(hinted(gone, gone.count(), SMALL), F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_anti")
