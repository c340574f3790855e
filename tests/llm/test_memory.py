"""What a Python worker holds at a time: batches of bounded bytes, words without Python objects."""

import tracemalloc

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from vigil.llm import packing  # noqa: E402
from vigil.llm._common import BATCH_BYTES, Seen, small_batches  # noqa: E402
from vigil.llm.queries import tokenizer_path  # noqa: E402

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    before = spark.conf.get(KEY)
    yield spark
    spark.conf.set(KEY, before)


def texts_of(spark):
    """One partition of about 16 MB, a text of 6 MB among them."""
    return spark.range(0, 4001, 1, 1).selectExpr("id AS doc_id", "CASE WHEN id = 2000 THEN repeat('long text ', 600000) ELSE repeat(concat('word', id, ' '), 250) END AS text")


def test_rows_go_to_workers_in_small_batches(session):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    wide = session.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text")
    got = small_batches(lambda spark: wide.mapInArrow(sizes, "bytes bigint, n bigint"))(session).collect()
    assert sum(r.n for r in got) == 4000 and max(r.bytes for r in got) < 1.1 * BATCH_BYTES


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_of_the_pipeline_bounds_its_batches(session, name, stage):
    session.conf.set(KEY, "64m")
    with pytest.raises(Exception):  # noqa: B017
        stage(session, None, "/nowhere")  # without rows: the limit is there before the stage begins
    assert session._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES


def test_a_smaller_limit_stays(session):
    session.conf.set(KEY, "1m")
    small_batches(lambda spark: None)(session)
    assert session.conf.get(KEY) == "1m"


def test_packing_does_not_depend_on_batches(session):
    pack = lambda spark: packing.digest(packing.pack(texts_of(spark), tokenizer_path("word_bpe_49k.json")))
    session.conf.set(KEY, "64m")
    large = pack(session).collect()
    small = small_batches(pack)(session).collect()
    assert len(large) > 1000 and large == small


@pytest.mark.parametrize("kind", [pa.large_string(), pa.large_binary()])
def test_seen_numbers_words_as_they_come_and_forgets_all(kind):
    seen, arr = Seen(5), lambda x: pa.array(list(x), pa.large_string()).cast(kind)
    for words, places, new, known in (
        ("abc", [0, 1, 2], "abc", 0), ("cab", [2, 0, 1], "", 3), ("dbea", [3, 1, 4, 0], "de", 3), ("", [], "", 5),
        ("af", [0, 1], "af", 0), ("fghijklm", [*range(8)], "fghijklm", 0), ("z", [0], "z", 0),
    ):
        got = seen(arr(words))
        assert got[0].tolist() == places and got[1].equals(arr(new)) and got[2] == known


def test_seen_words_take_little_memory():
    n = 100_000
    words = pa.array([f"some-word-{i}" for i in range(n)], pa.large_string())
    seen, arrow = Seen(n), pa.total_allocated_bytes()
    tracemalloc.start()
    for lo in range(0, n, 10_000):
        seen(words.slice(lo, 10_000))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held + pa.total_allocated_bytes() - arrow < 40 * n  # a dict of strings takes over 100 bytes a word
