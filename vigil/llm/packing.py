"""Sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its partition as they come. A document's full windows stand alone; its rest goes to the
fill level that makes the sum of squares of the counts of partly filled windows smallest (a level array holds the counts).
No more than OPEN windows are open at a time: then a rest that fits into none of them fills the emptiest, and what is left of
it is placed anew. At the end of a task the emptiest window's pieces are placed among the others in the same way until one
window stays, which is cut at powers of two; so nothing is padded. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Seen, freeing, grown, raw, slices, split_words, texts

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Units whose ids a worker remembers.
CACHE = 400_000
#: Windows open in a task at a time.
OPEN = 512
#: Bytes of text worked on at a time, and of ids in an output batch.
TEXT_BYTES, OUT_BYTES = 2 << 20, 2 << 20
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The pre-tokens of tokenizer files whose texts can be cut at white space and at the ASCII signs around a word (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _letter(body: np.ndarray, lead: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Two-byte letters from U+00C0 to U+027F that stay letters in lower case (so not U+00D7, U+00F7, U+0130)."""
    a, b = body[lead], body[follow]
    return (a >= 0xC3) & (a <= 0xC9) & (b >= 0x80) & (b < 0xC0) & ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) & ~((a == 0xC4) & (b == 0xB0))


def cut_signs(words: pa.Array, special: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Each word as three units, the ASCII signs before it, the rest, the signs behind it: codes [words, 3] and the distinct units.

    Signs are cut off only where a letter or ASCII digit meets them, so that no pre-token and no normal form spans the cut. A-Z
    are lower-cased but in words that hold a special token.
    """
    words = words.cast(pa.large_string())
    low = pc.ascii_lower(words)
    held = np.zeros(len(words), dtype=bool)
    for x in special:
        held |= np.asarray(pc.match_substring(words, x))
    if held.any():
        low = pc.if_else(pa.array(held), words, low)
    no_tail = pc.ascii_rtrim(low, characters=PUNCT)
    body, at = raw(low)
    left, core_end = at[:-1], at[:-1] + np.asarray(pc.binary_length(no_tail))
    core_start = core_end - np.asarray(pc.binary_length(pc.ascii_ltrim(no_tail, characters=PUNCT)))
    some = np.flatnonzero((core_start < core_end) & ~held)
    plain = np.zeros(256, dtype=bool)
    plain[48:58] = plain[97:123] = True
    last, first = core_end[some] - 1, core_start[some]
    tail = plain[body[last]] | _letter(body, np.maximum(last - 1, 0), last)
    quote = (first - left[some] == 1) & (body[left[some]] == 0x27)  # 's and such are one
    head = (plain[body[first]] | _letter(body, first, np.minimum(first + 1, len(body) - 1))) & ~quote
    starts, ends = left.copy(), at[1:].copy()
    starts[some[head]], ends[some[tail]] = first[head], core_end[some[tail]]
    cuts = np.append(np.stack([left, starts, ends], axis=1).ravel(), at[-1])
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(body.tobytes())).dictionary_encode()
    return np.asarray(units.indices).reshape(-1, 3), units.dictionary


class Encoder:
    """Token ids of whole texts by a `tokenizers` file, as the library gives them without added special tokens.

    Where the file's pre-tokens never cross white space or SPLIT's classes, each distinct unit of the words is encoded once;
    else whole texts are.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end_id
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps[0].get("pattern") == {"Regex": SPLIT} and normal == NORMAL and spec["model"].get("end_of_word_suffix") == "</w>" and not any(c.isspace() for x in self.special for c in x)
        self.closes = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.seen = Seen(CACHE)
        self.ids, self.ends = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64)  # ids of unit i: ids[ends[i]:ends[i + 1]]

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings one after another, and how many each has."""
        parts, lens = [np.zeros(0, np.uint32)], []
        for lo in range(0, len(strings), 4096):
            got = [x.ids for x in self.tok.encode_batch_fast(strings[lo : lo + 4096], add_special_tokens=False)]
            lens += map(len, got)
            parts.append(np.fromiter(chain.from_iterable(got), dtype=np.uint32))
        return np.concatenate(parts), np.array(lens, dtype=np.int64)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with words of letters many in one string: each is one pre-token, whose last id alone ends a word."""
        whole = np.fromiter(map(str.isalpha, units), dtype=bool, count=len(units))
        words, others = [u for u, w in zip(units, whole, strict=True) if w], [u for u, w in zip(units, whole, strict=True) if not w]
        ids, lens = [], []
        for lo in range(0, len(words), 2048):
            some = words[lo : lo + 2048]
            body = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[body]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(some):  # a letter whose lower case is more than a letter
                body, n = self.encode(some)
            ids.append(body)
            lens.append(n)
        body, n = self.encode(others)
        order = np.argsort(np.concatenate((np.flatnonzero(whole), np.flatnonzero(~whole))))
        at = np.concatenate(([0], np.cumsum(np.concatenate([*lens, n]))))
        out, ends = gather(np.concatenate([*ids, body]), at, order)
        return out, np.diff(ends)

    def _units(self, units: pa.Array) -> np.ndarray:
        """Each unit's place in the cache."""
        places, new, n = self.seen(units)
        if len(new):
            ids, lens = self._encode_units(new.to_pylist())
            base = self.ends[n]
            self.ends, self.ids = grown(self.ends, n + len(new) + 1), grown(self.ids, base + len(ids))
            self.ids[base : base + len(ids)] = ids
            self.ends[n + 1 : n + len(new) + 1] = base + np.cumsum(lens)
        return places

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their offsets."""
        codes, units = cut_signs(distinct, self.special)
        own = self._units(units)[codes.ravel()]
        ids, at = gather(self.ids, self.ends, own)
        return ids, at[::3]

    def __call__(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and their offsets."""
        if self.by_word:
            codes, offsets, distinct = split_words(arr, lower=False)
            body, ends = gather(*self._words(distinct), codes) if len(codes) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
            docs = ends[offsets]  # without the end ids
        else:
            body, lens = self.encode(arr.to_pylist())
            docs = np.concatenate(([0], np.cumsum(lens)))
        return np.insert(body, docs[1:], self.end), docs + np.arange(len(docs))


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker, so that its units are encoded once there."""
    return Encoder(path, end_id)


def gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of ragged rows, one after another, and their offsets."""
    n = at[rows + 1] - at[rows]
    ends = np.concatenate(([0], np.cumsum(n)))
    return values[np.repeat(at[rows] - ends[:-1], n) + np.arange(ends[-1])], ends


class Packer:
    """The level array and the open windows of one task. A piece is (doc, start, ids, ids of the whole document)."""

    def __init__(self, size: int, first: int, most: int = OPEN):
        self.size, self.next, self.most = size, first, max(1, most)
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}  # fill level -> windows, each a list of pieces
        self.count = 0
        self.out: list[tuple] = []
        self.out_bytes = 0

    def emit(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next, offset))
            offset += len(ids)
        self.out_bytes += 4 * offset
        self.next += 1

    def take(self, level: int) -> list:
        window = self.open[level].pop()
        if not self.open[level]:
            del self.open[level]
        self.level[level] -= 1
        self.count -= 1
        return window

    def put(self, window: list, level: int) -> None:
        if level == self.size:
            self.emit(window)
            return
        self.open.setdefault(level, []).append(window)
        self.level[level] += 1
        self.count += 1

    def choose(self, n: int, fresh: bool) -> int | None:
        """The level at which n more ids make the squares grow least, of equal ones the fullest; 0 is a new window, if it may be one."""
        room = self.size - n
        used = np.flatnonzero(self.level[1 : room + 1]) + 1
        if not len(used):
            return 0 if fresh else None
        gain = 2 * (self.level[used + n] - self.level[used] + 1)
        if used[-1] == room:
            gain[-1] = 1 - 2 * self.level[room]  # a full window no longer counts
        k = len(gain) - 1 - int(np.argmin(gain[::-1]))
        return 0 if fresh and 2 * self.level[n] + 1 < gain[k] else int(used[k])

    def place(self, piece: tuple, most: int) -> None:
        """Put a piece into a window; no more than `most` windows are open after it."""
        while True:
            doc, start, ids, total = piece
            if len(ids) == self.size:
                return self.emit([piece])
            at = self.choose(len(ids), self.count < most)
            if at is not None:
                window = self.take(at) if at else []
                window.append(piece)
                return self.put(window, at + len(ids))
            least = min(self.open)  # no room for all of it
            window, room = self.take(least), self.size - least
            window.append((doc, start, ids[:room], total))
            self.emit(window)
            piece = (doc, start + room, ids[room:], total)

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.size
        for at in range(0, whole, self.size):
            self.emit([(doc, at, ids[at : at + self.size], total)])
        if whole < total:
            self.place((doc, whole, ids[whole:].copy(), total), self.most)

    def close(self) -> None:
        """Place the emptiest window's pieces among the others until one is left; cut that one at powers of two."""
        while self.count > 1:
            for piece in self.take(min(self.open)):
                self.place(piece, max(1, self.count))
        for window in [w for ws in self.open.values() for w in ws]:
            left = sum(len(p[2]) for p in window)
            while left:
                room, part = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc, start, ids, total = window.pop(0)
                    if len(ids) > room:
                        window.insert(0, (doc, start + room, ids[room:], total))
                        ids = ids[:room]
                    part.append((doc, start, ids, total))
                    room -= len(ids)
                self.emit(part)
        self.open, self.count = {}, 0
        self.level[:] = 0

    def rows(self) -> pa.RecordBatch:
        """What has been emitted since the last time."""
        cols = list(zip(*self.out, strict=True)) if self.out else [()] * 7
        self.out, self.out_bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, most_open: int = OPEN) -> DataFrame:
    """Pack every document into sequences of at most `size` tokens; one row per piece (SCHEMA; ids: little-endian unsigned 32 bits).

    `tokenizer` is the path of a `tokenizers` file that every executor has. Null text is empty; an empty text has its end id as
    its one piece. A null doc_id stays null; repeated rows are packed each; other columns are not used. An empty table gives an
    empty result. Sequence ids are unique over the whole result: the task's number in the high bits. Every sequence is full or
    has a power of two as its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer, end_id), Packer(size, TaskContext.get().partitionId() << 36, most_open)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), TEXT_BYTES):
                ids, offsets = encode(texts(part))
                for i, doc in enumerate(batch.column(0).slice(at, len(part)).to_pylist()):
                    packer.add(doc, ids[offsets[i] : offsets[i + 1]])
                    if packer.out_bytes >= OUT_BYTES:
                        yield packer.rows()
                at += len(part)
        packer.close()
        yield packer.rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(freeing(run), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
