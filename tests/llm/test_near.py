"""Near and exact duplicates against brute force on small tables with ties, nulls and repeated rows."""

import hashlib
import random
import re

from vigil.llm.exact_dedup import group_copies
from vigil.llm.minhash_dedup import drop_near, near_groups


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(x), root(i)) for i, x in sets}


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [r.choice(words) for _ in range(120)]
    for n in range(160):  # a group of near copies, some too far from the base
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((n + 10, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, " a  b "), (7, "É b"), (8, "é b")]
    return rows + [(500 + n, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for n in range(60)]


def test_near_groups(spark):
    rows = corpus()
    want = brute(rows, 2)
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_empty_and_extra_columns(spark):
    schema = "doc_id bigint, text string, id string, band int, c int"
    assert near_groups(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1, 2), (2, "a b c d e f", "y", 1, 2), (3, "", "z", 1, 2)], schema)
    assert sorted(r.doc_id for r in drop_near(df).collect()) == [1, 3]


def test_exact_copies(spark):
    rows = [(1, "x"), (2, "x"), (3, None), (4, ""), (5, "y" * 5000), (6, "y" * 5000), (7, "y" * 5001), (7, "z")]
    got = {(r.doc_id, r.text_sha256): r for r in group_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))


def rows_brute(rows, k):
    """As brute(), with rows as nodes: (doc_id, set size, smallest doc_id reachable) of each."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for a, x in enumerate(sets):
        counts = {}
        for s in x:
            for b in where[s]:
                if b < a:
                    counts[b] = counts.get(b, 0) + 1
        for b, both in counts.items():
            if rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * (len(x) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_near_repeated_ids_and_long_texts(spark):
    r = random.Random(6)
    say = lambda n: [r.choice([f"v{i}" for i in range(3000)]) for _ in range(n)]
    rows = []
    for g in range(3):  # sets of many more hashes than a sketch holds
        base = say(9000)
        for n in range(6):
            w = list(base)
            for _ in range(r.choice([0, 10, 300, 900])):
                w[r.randrange(len(w))] = r.choice(say(1))
            rows.append((100 * g + n, " ".join(w)))
    short = say(40)
    rows += [(50, " ".join(short)), (50, " ".join(say(40))), (50, " ".join(short)), (51, " ".join([*short[:-1], "x"])), (40, rows[-1][1]), (None, " ".join(short)), (None, None), (51, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, id int, band string").repartition(3)
    got = near_groups(df, 2, 80).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == rows_brute(rows, 2)
    want = sorted(((d, t) for d, t in rows for x in [next(g for g in got if g.doc_id == d and g.n_shingles == len(shingles(t, 2)))] if x.kept), key=str)
    kept = drop_near(df, 2, 80)
    assert kept.columns == df.columns and sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == want


def test_recall_on_documents(spark):
    """Every link of the test documents is found: classes equal those of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for k in (2, 5):
        got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in near_groups(docs, k, 80).collect()), key=str)
        assert got == rows_brute(rows, k)
        assert sum(d != c for d, _, c in got) > 20
