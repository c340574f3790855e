"""Shared helpers: staging tables in the cluster's shared folder, checked broadcasts, and ragged text arrays."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes worked on at a time in a Python worker, so that memory doesn't follow the Arrow batch.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="vigil-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vigil-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of (spark, ...) whose rows go to Python workers in Arrow batches of about BATCH_BYTES, so that neither side holds a partition's texts at once.

    Spark plans when the result is read, so the session keeps the limit; a smaller one that it has stays. Results do not depend on it.
    """

    @wraps(f)
    def go(spark: SparkSession, *args) -> DataFrame:
        jvm, key = spark._jsparkSession.sessionState().conf(), "spark.sql.execution.arrow.maxBytesPerBatch"
        if not 0 < jvm.arrowMaxBytesPerBatch() <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
        return f(spark, *args)

    return go


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_key() -> Column:
    """Tells apart the texts (column text) of rows that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def hinted(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side whose rows have been counted and stay under a limit, else the side as it is."""
    return F.broadcast(df) if rows <= limit else df


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive pieces of a string array of about `most` bytes; a longer text is a piece of its own."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    i, n = 0, len(arr)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield arr.slice(i, j - i)
        i = j


def texts(arr: pa.Array) -> pa.Array:
    """A string array without nulls whose buffers begin at its first text: kernels misread the cast of a slice (pyarrow 23)."""
    return pc.fill_null(pa.concat_arrays([arr]).cast(pa.large_string()), "")


def split_words(arr: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of each text (no nulls): their codes, the offsets of the texts, the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(arr) if lower else arr)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = np.asarray(coded.indices), coded.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        there = codes != empty
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
        codes = codes[there]
    return codes, offsets, distinct


def raw(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    distinct = distinct.cast(pa.large_string())
    offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = distinct.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each ragged row; empty rows give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[offsets[1:]] - total[offsets[:-1]]


class Seen:
    """Numbers words from 0 as they come and forgets all when more than `limit` have come. Words stay in one Arrow array: a dict takes several times as much."""

    def __init__(self, limit: int):
        self.limit, self.words = limit, None

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, pa.Array, int]:
        """The number of each of some distinct words, the new ones and how many were known before them (0: all were forgotten)."""
        if self.words is None:
            self.words = words[:0]
        found = pc.fill_null(pc.index_in(words, self.words), -1)
        new = words.filter(pc.equal(found, -1))
        if len(self.words) + len(new) > self.limit:
            self.words, new, found = words[:0], words, pa.array(np.full(len(words), -1, np.int32))
        n = len(self.words)
        if len(new):
            self.words = pa.concat_arrays([self.words, new])
        places = np.asarray(found).astype(np.int64)
        places[places < 0] = np.arange(n, n + len(new))
        return places, new, n


def grown(table: np.ndarray, rows: int) -> np.ndarray:
    """A table with room for so many rows at least."""
    return table if len(table) >= rows else np.concatenate((table, np.zeros((max(rows - len(table), len(table)), *table.shape[1:]), table.dtype)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give what a task has freed back to the system: Python workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives its memory back when it ends."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return go


def text_udf(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str):
    """An Arrow UDF over whole texts: make() builds the function once in each task; it gets slices without nulls."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(returnType=returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = [work(texts(x)) for x in slices(batch)]
            yield pa.concat_arrays(parts) if parts else work(pa.array([], pa.large_string()))
        del work
        release()

    return run


def crc_held_out(id_col: str, mod: int, rest: int):
    """Whether a row's label is held out: crc32 of the id as text has this remainder. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def excerpt(text, most: int, piece: int = 4096):
    """The text; one of more than `most` characters is stood for by pieces spread evenly over all of it, `most` characters in all."""
    n, k = F.length(text), most // piece
    at = lambda i: (i * ((n - piece) / F.lit(max(k - 1, 1)))).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(text, at(i), F.lit(piece)))
    return F.when(n <= most, text).otherwise(F.array_join(pieces, " "))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int, most_chars: int = 1 << 15) -> DataFrame:
    """doc_id, text, y for training: the `most` labelled ids of the smallest hash that aren't held out.

    Both bounds make the broadcast and the one training task safe at any size: at most `most` rows, and of a text of more than
    `most_chars` characters as many, taken evenly from all of it (every text is scored whole).
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~crc_held_out("doc_id", mod, rest))
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), excerpt(F.col("text"), most_chars).alias("text"), "__y")).alias("r"))  # one row of an id that repeats
    return first.select("doc_id", "r.text", F.col("r.__y").alias("y"))


def trained(sample: DataFrame, train: Callable[[list[str], np.ndarray], object]):
    """The model that train(texts, labels) makes of a bounded sample (doc_id, text, y), in one task of an executor: the driver holds no texts."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).to_pydict() if (batches := list(batches)) else {"text": [], "y": []}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows["text"], np.array(rows["y"], dtype=np.float64)))], pa.binary())], names=["model"])

    got = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(freeing(run), "model binary").first()
    return pickle.loads(got[0]) if got else train([], np.zeros(0))
