"""Exact duplicates against brute force: huge texts, collisions, ties, nulls and repeated ids."""

import hashlib
import random

import numpy as np
import pytest

from vigil.llm.exact_dedup import BASES, combine, drop_copies, fingerprints, group_copies

SCHEMA = "doc_id bigint, text string, h1 string, n int, keep_id int, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def brute(rows):
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in ids if j is not None]
        keep = max(known, default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=2):
    r = random.Random(seed)
    long = ["".join(r.choice("abcdé \n") for _ in range(n)) for n in (5000, 5000, 70_000, 140_001)]
    near = [t[:-2] + "X" + t[-1] for t in long] + ["X" + t[1:] for t in long]  # as long, and different at one place
    pool = ["", "x", "y", "xy", *long, *near]
    rows = [(i, r.choice(pool)) for i in range(120)]
    return rows + [(None, "x"), (None, "only null"), (None, "only null"), (7, "other text of 7"), (7, "x"), (500, None), (501, None)]


def test_fingerprints_compose():
    r = random.Random(1)
    for _ in range(50):
        a, b = (bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 1023, 1024, 1025, 3000]))) for _ in range(2))
        f = lambda *parts: fingerprints(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
        both = f(a, b)
        assert (combine(both[:1], both[1:], np.array([len(b)])) == f(a + b)).all()


@pytest.mark.parametrize(("huge", "bases"), [(1 << 26, BASES), (3000, BASES), (1 << 26, np.zeros(4, np.int64)), (3000, np.zeros(4, np.int64))])
def test_groups(spark, huge, bases):
    """With bases of zero a fingerprint is the last byte alone, so that all rests on the comparison of texts."""
    rows = corpus()
    got = group_copies(frame(spark, rows), huge, segment=40_000, bases=bases).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_drop(spark):
    rows = corpus(3)
    want = sorted([(i, t) for (i, t) in rows for b in [max((j for j, u in rows if (u or "") == (t or "") and j is not None), default=None)] if i == b], key=str)
    got = drop_copies(frame(spark, rows))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_empty(spark):
    assert group_copies(frame(spark, [])).count() == 0
    assert drop_copies(frame(spark, [])).count() == 0
