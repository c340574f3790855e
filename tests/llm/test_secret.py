"""Secret scans: candidates and the forest's SQL against plain Python, figures on held-out findings, odd rows."""

import random
import re

import numpy as np
import pytest

from vigil.llm import secret_scan as S

SCHEMA = "doc_id bigint, text string, match string, at int, c int, f int"


@pytest.fixture(scope="module")
def trees(spark):
    return S.train(spark, S.labelled_findings())


def brute(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
    out = []
    for i, x in enumerate(w):
        for m in re.findall(S.RUN, x):
            if len(x) >= 16 and (re.search("[0-9]", m) or len(re.findall("[a-z][A-Z]", m)) >= 3):
                out.append((i, m))
    return out


def vote(tree, row):
    while not isinstance(tree, float):
        f, t, a, b = tree
        tree = a if row[f] <= t else b
    return tree


def test_held_out_findings(spark, trees):
    found = S.labelled_findings(2000, seed=77)
    df = spark.createDataFrame(found, "word string, match string, before string, after string, label int")
    rows = np.array(df.select(*[c.alias(k) for k, c in S.features().items()], "label").collect(), dtype=float)
    score = np.array([np.mean([vote(t, r) for t in trees]) for r in rows[:, :-1]])
    said, true = score >= 0.5, rows[:, -1] > 0
    precision, recall = (said & true).sum() / said.sum(), (said & true).sum() / true.sum()
    print(f"held-out precision {precision:.4f} recall {recall:.4f}")
    assert precision >= 0.97 and recall >= 0.97


def corpus():
    r = random.Random(3)
    key = lambda n, chars="abcdef0123456789": "".join(r.choice(chars) for _ in range(n))
    rows = [(i, f'some words here token = "{key(40)}" and more') for i in range(30)]
    rows += [(100 + i, f"see commit {key(40)} of order 12345678901234{i:02d} at /path/to/file/page/{i}.html") for i in range(30)]
    rows += [(200, f"a=1,password={key(24)};api_key={key(32)}"), (201, "x" * 100_000 + " " + key(40)), (202, None), (203, ""), (204, " \n\t "), (None, f"token={key(40)}")]
    rows += [(205, f"token={key(40)}")] * 2 + [(206, "secret: aBcDeFgHiJkLmNoPqRsT"), (206, "é" * 20 + key(20)), (207, "a\x0bb\x0c token=" + key(33))]
    return rows


def test_candidates_scores_and_odd_rows(spark, trees):
    rows = corpus()
    got = S.scan(spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3), trees).collect()
    want = sorted([(i, *c) for i, t in rows for c in brute(t)], key=str)
    assert sorted([(r.doc_id, r.at, r.match) for r in got], key=str) == want
    assert all(0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5) for r in got)
    told = {r.doc_id for r in got if r.is_secret}
    assert told >= {*range(30), 200, 205, None} and not told & {*range(100, 130)}


def test_sql_form_is_the_forest(spark, trees):
    got = S.scan(spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in corpus()], SCHEMA), trees).collect()
    df = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id bigint, text string")
    c = df.selectExpr("doc_id", "coalesce(text, '') as text").select("doc_id", S.F.explode(S.candidates(S.F.col("text"))).alias("c")).select("doc_id", "c.*")
    rows = c.select("doc_id", "at", S.F.col("match").alias("m"), *[x.alias(k) for k, x in S.features().items()]).collect()
    plain = sorted([(r[0], r[1], r[2], round(float(np.mean([vote(t, r[3:]) for t in trees])), 4)) for r in rows], key=str)
    assert max(abs(a.score - b) for a, b in zip(sorted(got, key=lambda r: str((r.doc_id, r.at, r.match))), [p[3] for p in sorted(plain, key=lambda p: str(p[:3]))], strict=True)) < 1e-3


def test_empty_table(spark, trees):
    assert S.scan(spark.createDataFrame([], SCHEMA), trees).count() == 0
