"""Packing against the tokenizer library: every id in exactly one piece, gapless sequences, no padding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import packing
from vigil.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = [
    "", " ", "don't STOP, it's 's 'tis dogs' rock'n'roll", "(\"'s) 'save 'll 'd ''s", "x.y...z!? --a-- _b_ [c]", "É à Ü ß ÀÉÎ× ÷a İ. i̇. ŉ, ǅ; ɏ) ʒ.", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.",
    "中文，測試。 日本語 。x", "é. ≠= ́a .́", "١٢٣ ½. ²) 1st 2,000.50", "a b c\u0085d", "tab\there\nnl\x0bvt\x0cff\x1cfs", "\0 nul\0x", "🙂🙂!? (🙂)", "…« a »… ¿qué? ¡no!", "A" * 3000 + ".", "w " * 9000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def test_encoder_gives_the_librarys_ids(library):
    r = random.Random(3)
    signs = list("'\"().,-_!?<|> \n") + ["é", "İ", "ß", "中", "́", "s", "t", "ll", "A", "7", " ", "×"]
    rows = ODD + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    encode = packing.Encoder(PATH, 2)
    assert encode.by_word
    for part in (rows, rows[::-1]):  # the second time from the cache
        ids, at = encode(pa.array(part, pa.large_string()))
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == library(t), repr(t)


def test_other_tokenizers_are_encoded_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    encode, tok = packing.Encoder(path, 2), Tokenizer.from_file(path)
    assert not encode.by_word
    ids, at = encode(pa.array(ODD, pa.large_string()))
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def held(rows, want):
    """Pieces (doc, start, length, ids, total, sequence, offset): each document's ids once, sequences gapless, full or a power of two."""
    docs, seqs = {}, {}
    for d, start, n, ids, total, seq, off in rows:
        assert len(ids) == 4 * n > 0
        docs.setdefault(d, []).append((start, ids, total))
        seqs.setdefault(seq, []).append((off, n))
    got = {}
    for d, parts in docs.items():
        parts.sort()
        body = b"".join(p[1] for p in parts)
        at = 0
        for start, ids, total in parts:
            assert start == at and total == len(body) // 4
            at += len(ids) // 4
        got[d] = np.frombuffer(body, "<u4").tolist()
    assert got == want
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    return len(seqs)


@pytest.mark.parametrize("most", [1, 3, 512])
def test_packer_keeps_all_ids(most):
    r = random.Random(most)
    want = {i: [r.randrange(49_000) for _ in range(r.choice([1, 3, 700, 4095, 4096, 4097, 9000, r.randint(1, 3000)]))] for i in range(400)}
    p, out = packing.Packer(4096, 7, most), []
    for d, ids in want.items():
        p.add(d, np.array(ids, np.uint32))
        assert p.count <= most and p.count == p.level[1:].sum() == sum(map(len, p.open.values()))
    p.close()
    out += zip(*[c.to_pylist() for c in p.rows().columns], strict=True)
    n = held(out, want)
    assert n <= sum(map(len, want.values())) / 4096 + 12  # nothing is padded; the last window is cut at powers of two


def test_choice_makes_the_squares_least():
    r = random.Random(9)
    for _ in range(300):
        p = packing.Packer(16, 0, 99)
        for _ in range(r.randint(0, 12)):
            p.put([], r.randint(1, 15))
        n, counts = r.randint(1, 15), p.level.copy()

        def cost(at):
            c = counts.copy()
            c[at] -= at > 0
            if at + n < 16:
                c[at + n] += 1
            return (c[1:] ** 2).sum()

        levels = [0, *(x for x in range(1, 16 - n + 1) if counts[x])]
        assert cost(p.choose(n, True)) == min(map(cost, levels))
        if len(levels) > 1:
            assert cost(p.choose(n, False)) == min(map(cost, levels[1:]))
        else:
            assert p.choose(n, False) is None


def test_pack_whole_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id int, text string, ids string, start int, length string").repartition(3)
    pieces = packing.pack(df, PATH)
    held([tuple(r) for r in pieces.collect()], {i: library(t) for i, t in rows})
    for r in packing.digest(pieces).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(library(dict(rows)[r.doc_id])[r.start : r.start + r.length], "<u4").tobytes())


def test_pack_empty_null_and_repeated(spark):
    schema = "doc_id bigint, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    got = packing.pack(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (6, "")], schema).coalesce(1), PATH).collect()
    total = {i: sum(r.length for r in got if r.doc_id == i) for i in (None, 5, 6)}
    assert total == {None: 3, 5: 6, 6: 1}
