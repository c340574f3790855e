"""Quality and toxicity scores: plain-Python forms of the models, gradients, held-out figures, odd rows."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import quality, toxicity
from vigil.llm._common import excerpt, texts

DIR = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"  # the smaller one has too few toxic documents to learn from
ODD = ["", " ", "one", "a a a a", "É ß 中文 🙂", "\0 \x01 \x02", "x" * 300_000, "word " * 40_000, "!!! ... ,", "a\nb\tc\x0bd\x0ce", "ends " * 33 + "last"]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label > 0
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def labelled(column):
    return duckdb.connect().execute(f"SELECT doc_id, text, {column} FROM '{DIR}/documents.parquet' JOIN '{DIR}/labels.parquet' USING (doc_id) WHERE {column} IS NOT NULL ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def models():
    out = {}
    for name, column, mod, rest in (("quality", "quality", 5, 0), ("toxicity", "toxic", 4, 2)):
        rows = [r for r in labelled(column) if zlib.crc32(str(r[0]).encode()) % mod != rest]
        train = quality.train if name == "quality" else toxicity.train
        out[name] = train([r[1] for r in rows], np.array([r[2] for r in rows], float))
    return out


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_batches_do_not_matter(models, name):
    model, rows = models[name], ODD + [r[1] for r in labelled("quality")[:60]]
    arr = lambda x: texts(pa.array(x, pa.large_string()))
    whole, alone = np.array(model(arr(rows))), np.concatenate([np.array(model(arr([t]))) for t in rows])
    assert np.abs(whole - alone).max() < 1e-4 and ((whole >= 0) & (whole <= 1)).all()


def test_quality_is_the_mean_of_its_features(models):
    """The number of every n-gram, word and pair, one by one."""
    model = models["quality"]
    for text in ["the quick brown fox", "a a b", "Ünï code", ""]:
        w, total, n, last = text.split(), 0.0, 0, None
        for x in w:
            bucket, _, whole = quality.word_features(pa.array([x], pa.large_string()))
            total, n = total + model.number[bucket].sum(), n + len(bucket)
            assert len(bucket) == 1 + sum(max(0, len(x.encode()) + 3 - k) for k in quality.GRAMS)
            if last is not None:
                pair = quality.pair_buckets(np.array([0, 0 if last[0] == x else 1]), np.array([last[1], whole[0]]), np.array([0, 2]))[1]
                total, n = total + model.number[pair], n + 1
            last = (x, whole[0])
        assert float(model(pa.array([text], pa.large_string()))[0].as_py()) == pytest.approx(1 / (1 + np.exp(-(total / max(n, 1) + model.bias))), abs=1e-5)


def plain_network(net, words):
    """The score of one window, step by step."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    x = [net.inputs(pa.array([w], pa.large_string()))[0].astype(float) for w in words]
    states = []
    for d in "fb":
        s, seen = np.zeros(h), []
        for v in x if d == "f" else x[::-1]:
            g, q = v @ p[f"W{d}"] + p[f"c{d}"], s @ p[f"U{d}"]
            z, r = sigmoid(g[:h] + q[:h]), sigmoid(g[h : 2 * h] + q[h : 2 * h])
            c = np.tanh(g[2 * h :] + r * q[2 * h :])
            s = c + z * (s - c)
            seen.append(s)
        states.append(seen if d == "f" else seen[::-1])
    both = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
    e = np.tanh(both @ p["A"]) @ p["v"]
    w = np.exp(e - e.max())
    return (w / w.sum()) @ both @ p["o"] + p["k"][0]


def test_all_overlapping_windows_are_scored(models):
    net = models["toxicity"]
    words = [f"w{i % 37}" for i in range(150)]
    windows = [words[i : i + toxicity.WINDOW] for i in range(0, 150 - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
    assert windows[-1][-1] == words[-1] and len(windows[-1]) > toxicity.WINDOW - toxicity.STRIDE
    want = max(1 / (1 + np.exp(-plain_network(net, w))) for w in windows)
    assert net(pa.array([" ".join(words)], pa.large_string()))[0].as_py() == pytest.approx(want, abs=1e-4)


def test_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = 5
    x = rng.standard_normal((n, 2 * toxicity.DIM))
    ids, there = net.ids(rng.integers(0, n, 40), np.array([0, 10, 33]), np.array([32, 20, 7]), n)
    y = np.array([0.5, -1.0, 2.0])

    def loss():
        full, gates = net.gates(x)
        logit, saved = net.forward(ids, there, gates, keep=True)
        return float((logit.astype(np.float64) * y).sum()), full, saved

    _, full, saved = loss()
    grads, _ = net.backward(ids, there, full, saved, y)
    for k in ("o", "k", "v", "A", "Uf", "Ub", "Wf", "Wb", "cf", "cb"):
        v = net.p[k].reshape(-1)
        for i in rng.integers(0, v.size, 4):
            old, step = v[i], 1e-2
            v[i] = old + step
            up = loss()[0]
            v[i] = old - step
            down = loss()[0]
            v[i] = old
            assert np.asarray(grads[k]).reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), k


def test_very_long_words_have_the_inputs_of_short_parts(models, monkeypatch):
    net, word = models["toxicity"], "abcdefghij" * 1000
    want = net.inputs(pa.array([word, "x"], pa.large_string()))[0]
    monkeypatch.setattr(toxicity, "WORD_BYTES", 333)
    assert np.abs(net.inputs(pa.array([word], pa.large_string()))[0] - want).max() < 1e-5


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_held_out(spark, name):
    score, column, mod, rest = (quality.score_quality, "quality", 5, 0) if name == "quality" else (toxicity.score_toxicity, "toxic", 4, 2)
    docs, labels = (spark.read.parquet(f"{DIR if name == 'quality' else LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels.select("doc_id", column), "doc_id").where(f"{column} is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    got = auc(np.array([r.score for r in held]), np.array([r[column] for r in held]))
    print(f"{name}: AUC {got:.4f} on {len(held)} held-out rows")
    assert got > 0.9


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, score):
    schema = "doc_id bigint, text string, score string, held_out int, quality int, toxic int"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20, None), (None, "null id"), (21, "again"), (21, "again"), (21, "another text")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], schema)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)] + [(1, 1, 1), (3, None, None), (None, 1, 1), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = score(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by = {(r.doc_id, round(r.score, 9)) for r in got}
    assert len({s for i, s in by if i in (0, 20)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.where("false"), labels).count() == 0
    assert score(docs, labels.where("false")).count() == len(rows)


def test_excerpts_cover_the_whole_text(spark):
    text = "".join(chr(97 + i * 26 // 100_000) for i in range(100_000))
    df = spark.createDataFrame([(text,), ("short",), ("",)], "text string")
    long, short, none = (r[0] for r in df.select(excerpt(df.text, 1 << 15)).collect())
    assert short == "short" and none == "" and len(set(long)) > 16 and len(long.replace(" ", "")) == 1 << 15 and long[0] == "a" and long[-1] == text[-1]
