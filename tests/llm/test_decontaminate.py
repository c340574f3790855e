"""Decontamination against brute-force greedy string tiling over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import decontaminate
from vigil.llm.decontaminate import PUNCT, drop_leaks, find_leaks, tile, words


def plain_words(text):
    return [x for x in (w.strip(PUNCT) for w in (text or "").lower().replace("\x0b", " ").split()) if x]


def brute_tile(doc, item, k):
    """Greedy string tiling as it is defined: again and again, the longest common runs of unmarked words."""
    k = min(k, len(item))
    if not k:
        return 0, 0, 0
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    covered = tiles = longest = 0
    while True:
        best, found = k, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if not found:
            return covered, tiles, longest
        for i, j in found:
            if not any(in_doc[i : i + best]) and not any(in_item[j : j + best]):
                in_doc[i : i + best] = in_item[j : j + best] = [True] * best
                covered, tiles, longest = covered + best, tiles + 1, max(longest, best)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 19])
def test_tile_is_greedy_string_tiling(pairs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    r = random.Random(1)
    for n in range(400):
        few = r.choice([1, 2, 4, 20])
        doc = [r.randrange(few) for _ in range(r.randint(0, 30))]
        item = [r.randrange(few) for _ in range(r.randint(0, 14))]
        if n % 2 and len(item) > 6:  # parts in another order
            cut = r.randint(2, len(item) - 2)
            doc = doc[:4] + item[cut:] + doc[4:8] + item[:cut]
        k = r.randint(1, 4)
        got = tile(np.array(doc, np.uint64), np.array(item, np.uint64), k)
        assert got == brute_tile(doc, item, k), (doc, item, k)


def test_repeated_runs_of_a_long_text():
    doc, item = np.array([1, 2, 3, 4, 5, 9] * 50_000, np.uint64), np.array([1, 2, 3, 4, 5, 8] * 60 + [7, 7, 7, 7, 7], np.uint64)
    assert tile(doc, item, 5) == (300, 60, 5)


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randint(6, 25))) for i in range(12)] + [(20, "Only, three words!"), (21, ""), (22, None), (23, "..."), (None, say(9)), (3, say(8))]
    docs = []
    for n in range(60):
        text = say(r.randint(0, 40))
        if n % 3 == 0:
            w = r.choice(items[:12])[1].upper().split()
            cut = r.randint(0, len(w))
            text = f"{text} ({' '.join(w[cut:])}). {say(2)} {' '.join(w[:cut])}!"
        docs.append((n, text))
    docs += [(100, None), (101, ""), (102, "say only three words now"), (102, "three only words"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (103, items[2][1] + " x" * 3000), (104, items[16][1])]
    return docs, items


def brute(docs, items, k=5, share=0.5):
    out = set()
    for d, t in docs:
        for i, u in items:
            doc, item = plain_words(t), plain_words(u)
            covered, tiles, longest = brute_tile(doc, item, k) if len(doc) < 500 else tile(*(np.array([hash(x) & (2**63 - 1) for x in y], np.uint64) for y in (doc, item)), k)
            if item and covered >= share * len(item):
                out.add((d, i, covered / len(item), tiles, longest, len(item)))
    return out


def test_tables(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id bigint, text string, item_id int, key string, h int").repartition(3)
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, id int, key string")
    want = brute(docs, items)
    got = [tuple(r) for r in find_leaks(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    gone = {(d, t) for d, t in docs if brute([(d, t)], items)}
    kept = drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([x for x in docs if x not in gone], key=str)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert find_leaks(d.where("false"), b).count() == find_leaks(d, b.where("false")).count() == 0
    assert drop_leaks(d, b.where("false")).count() == 1 and drop_leaks(d, b).count() == 0


def test_words_of_slices():
    rows = ["It's  (here). ÀB -- x", "", "... !", "a" * 5000 + "!"]
    values, at = words(pa.array(rows, pa.large_string()))
    assert np.diff(at).tolist() == [len(plain_words(t)) for t in rows]
