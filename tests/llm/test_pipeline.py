"""The pipeline's stages on a small table against brute force, one after another; run() as a whole; deletion of the subpackage."""

import os
import random
import shutil
import subprocess
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_decontaminate import brute as leaks  # noqa: E402
from test_near import brute as near  # noqa: E402
from test_packing import PATH, held  # noqa: E402

from vigil.llm import packing, toxicity  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def corpus():
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(12)) for i in range(6)]
    docs, labels, base = [], [], say(80).split()
    for n in range(240):
        text = say(r.randint(5, 90))
        toxic = n % 4 == 0
        if toxic:
            w = text.split()
            at = r.randint(0, len(w))
            text = " ".join([*w[:at], "vile", "scum", f"awful{n % 3}", *w[at:]])
        elif n % 10 == 1:  # near copies
            w = list(base)
            w[r.randrange(len(w))] = say(1)
            text = " ".join(w)
        elif n % 10 == 2:
            text = docs[n - 1][1]  # exact copies
        elif n % 10 == 3:
            w = items[n % 6][1].split()
            text = f"{text} {' '.join(w[6:])} {say(3)} {' '.join(w[:6])}"
        docs.append((n, text))
        labels.append((n, 1, int("scum" in text)))
    docs += [(300, None), (301, ""), (302, "word " * 6000)]
    return docs, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs, labels, items = corpus()
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_brute_force(spark, tables):
    docs, _, items = corpus()
    rows = dict(docs)
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        frame = f(spark, frame, tables)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame = spark.createDataFrame(sorted(frame.collect(), key=lambda r: r.doc_id), frame.schema)
        kept[name] = [r.doc_id for r in frame.collect()]
    toxic = {i for i, t in docs if "scum" in (t or "")}
    assert toxic.isdisjoint(kept["toxicity"]) and set(rows) - toxic == set(kept["toxicity"])
    same = {}
    for i in kept["toxicity"]:
        same.setdefault(rows[i] or "", []).append(i)
    assert kept["exact_dedup"] == sorted(max(x) for x in same.values())
    roots = near([(i, rows[i]) for i in kept["exact_dedup"]], 5)
    assert kept["minhash_dedup"] == sorted(i for i, (_, root) in roots.items() if root == i) and len(kept["minhash_dedup"]) < len(kept["exact_dedup"]) - 10
    found = {i for i, *_ in leaks([(i, rows[i]) for i in kept["minhash_dedup"]], items)}
    assert found and kept["decontamination"] == sorted(set(kept["minhash_dedup"]) - found)
    encode, want = packing.Encoder(PATH, 2).tok, {}
    for i in kept["decontamination"]:
        want[i] = [*encode.encode(rows[i] or "", add_special_tokens=False).ids, 2]
    name, pack = corpus_pipeline.STAGES[-1]
    assert name == "packing"
    held([tuple(r) for r in pack(spark, frame, tables).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").collect()], want)


def test_run_is_the_stages_in_turn(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, tables)
    whole = lambda df: sorted((r.doc_id, r.start, r.length) for r in df.select("doc_id", "start", "length").collect())
    total = lambda rows: {i: sum(n for j, _, n in rows if j == i) for i, _, _ in rows}
    assert total(whole(got)) == total(whole(docs)) and corpus_pipeline.ORACLE_SQL is None
    assert toxicity.TRAIN_ROWS == 4000


def test_empty_table(spark, tables, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copytree(f"{tables}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for name in ("vigil", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
