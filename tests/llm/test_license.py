"""License scans against SQL, and base phrases against brute force."""

import random
import re

import duckdb

from vigil.llm.license_scan import BASE, METHOD, scan, sql
from vigil.llm.license_texts import TEXTS

SCHEMA = "doc_id bigint, text string, t int, label string, w string, h int"


def corpus():
    r = random.Random(8)
    bits = ["GNU", "General", "public", "license", "Apache", "CC", "BY", "MIT", "License,", "version", "3", "the", "of", "under", "É", "naïve", "\n", "-NC", "4.0", "x_y", "a.b"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(80)]
    for i, (_, text) in enumerate(TEXTS.items()):
        w = text.split()
        changed = [x for x in w if r.random() > 0.03]
        rows += [(100 + i, f"Copyright 2020 Some Body. {text} And more."), (200 + i, " ".join(changed[: len(w) // 2] + ["Some", "Body", "Inc."] + changed[len(w) // 2 :])), (300 + i, " ".join(w[: len(w) // 3]))]
    return rows + [(400, None), (401, ""), (402, "...!"), (None, "mit license"), (403, "MIT License " * 3000), (404, "again mit license"), (404, "again mit license"), (404, "cc by"), (405, "mit\0license"), (406, "ｍit license mİt license")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def places(w):
    found = []
    for t in BASE:
        phrase = t.text.split()
        found += [(i, t.label) for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    return found


def test_base_phrases_and_sql(spark):
    rows = corpus()
    out = scan(spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], SCHEMA).repartition(3))
    got = sorted([tuple(r) for r in out.collect()], key=str)
    base = []
    for i, t in rows:
        w = words(t)
        f = places(w)
        base.append((i, len(w), len(f), min((p for p, _ in f), default=None), max((p for p, _ in f), default=None), ",".join(sorted({x for _, x in f}))))
    assert sorted([r[:6] for r in got], key=str) == sorted(base, key=str)
    assert all(set(r[5].split(",")) - {""} <= set(r[6].split(",")) for r in got) and all(0 <= r[7] <= 1 for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(sql()).fetchall(), key=str) == got


def test_whole_and_changed_texts_are_found(spark):
    rows = [r for r in corpus() if r[0] is not None and 100 <= r[0] < 400]
    found = {r.doc_id: set(r.labels.split(",")) for r in scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, label in enumerate(TEXTS):
        assert label in found[100 + i], label
        assert label in found[200 + i] or len(TEXTS[label].split()) < 30, label
        if label != "apache-2.0" and len(TEXTS[label].split()) > 30:
            assert label not in found[300 + i], label  # a third of it is not the license (that one begins with its notice)


def test_plain_prose_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the name of the file is in the list of the public library and by the way this is free")], "doc_id bigint, text string")
    assert scan(df).first().labels == ""
    assert scan(df.where("false")).count() == 0
    assert len({t.label for t in METHOD}) > 15
