"""Token counts against the sentencepiece library."""

import random

import pyarrow as pa
import pytest

from vigil.llm import token_count
from vigil.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b   c", "\n\na\n", "tab\there", "▁x ▁▁ y▁", "<s> </s> <unk> <0x41> a</s>b", "\0a\0", "é é ́", "中文測試。日本語", "🙂 \U0001f9ff‍", " 　 x", "nul ﻿", "x\r\ny\r",
]


@pytest.fixture(scope="module")
def merger():
    return token_count.Merger(PATH)


@pytest.fixture(scope="module")
def library(merger):
    return lambda t: len(merger.sp.encode(t, num_threads=1))


def random_texts(n, most, seed):
    r = random.Random(seed)
    parts = ["the", "ing", "hing", "t", "h", "e", "a", "aa", " ", "  ", "\n", "é", "中", "🙂", "▁", "er", "in", "1", "0", "<", ">", "s", "ß", "\t", "on", "an", "X", "_"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, most))) for _ in range(n)]


def test_counts_of_texts(merger, library):
    rows = ODD + random_texts(4000, 60, 1)
    for _ in range(2):  # the second time from the cache
        assert merger(pa.array(rows, pa.large_string())).to_pylist() == [library(t) for t in rows]


def test_long_pre_tokens(merger, library):
    r = random.Random(5)
    rows = ["a" * 5000, "ab" * 3000, "hing" * 1500, "=" * 4097, " " * 3001, "▁" * 700, "é" * 900, "中文" * 800, "🙂" * 600, "".join(r.choice("thingerao") for _ in range(60_000))]
    rows += [t.replace(" ", "").replace("\n", "") for t in random_texts(60, 1500, 7)]
    assert max(map(len, rows)) > token_count.LONG
    assert merger(pa.array(rows, pa.large_string())).to_pylist() == [library(t) for t in rows]


def test_both_layouts_agree(merger):
    rows = [t for t in (x.replace(" ", "▁").replace("\n", "") for x in random_texts(1500, 40, 11)) if t]
    assert [merger.long(t) for t in rows] == merger.merged(rows).tolist()


def test_table(spark, library):
    schema = "doc_id bigint, text string, n_bytes string, n_tokens int"
    assert token_count.count_tokens(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (50, None), (51, "again"), (51, "again"), (52, "word " * 5000), (53, "x" * 4096), (54, " a" * 4096), (55, " a" * 4095)]
    got = token_count.count_tokens(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], schema), PATH).collect()
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 4096) for i, t in rows]
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
