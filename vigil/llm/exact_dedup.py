"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks; a chunk's hash is a polynomial in four bases modulo 2^31 - 1 (a matrix product), and
hashes combine by length-shifted arithmetic: H(ab) = H(a) * r^len(b) + H(b). Texts over `huge` bytes are cut into segments that
different tasks hash in parallel. Texts of equal fingerprint and length, of any size, are then compared chunk by chunk with the
text that stays; where one differs, its fingerprint's texts are told apart by SHA-256 as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, hinted, raw, slices, stage, texts

P = (1 << 31) - 1
BASES = np.array([1_103_515_245, 69_069_069, 1_664_525_013, 741_103_597], dtype=np.int64)
CHUNK = 1024
SEGMENT = 8 << 20
COMPARE = 1 << 16
HUGE = 64 << 20
#: Rows of a group that meet its kept text in one part.
PART = 256
#: Dropped rows (id and SHA-256) that are broadcast at most.
SMALL = 200_000


def _mod(x: np.ndarray) -> np.ndarray:
    return x % P


def powers(exponents: np.ndarray, bases: np.ndarray = BASES) -> np.ndarray:
    """Each base to each exponent, [n, 4], by squaring."""
    out = np.ones((len(exponents), len(bases)), dtype=np.int64)
    square, e = bases.copy(), np.asarray(exponents, dtype=np.int64).copy()
    while e.any():
        odd = (e & 1).astype(bool)
        out[odd] = _mod(out[odd] * square)
        square = _mod(square * square)
        e >>= 1
    return out


def fingerprints(body: np.ndarray, offsets: np.ndarray, bases: np.ndarray = BASES) -> np.ndarray:
    """Hashes [n, 4] of ragged byte rows; a byte counts as its value plus 1."""
    # each base's power for each place of a chunk, from its end; products and their sums stay exact in doubles (under 2^53)
    table = powers(np.arange(CHUNK)[::-1], bases).astype(np.float64)
    n, lens = len(offsets) - 1, np.diff(offsets)
    chunks = -(-lens // CHUNK)
    at = np.concatenate(([0], np.cumsum(chunks)))
    owner = np.repeat(np.arange(n), chunks)
    k = np.arange(at[-1]) - at[:-1][owner]
    end = offsets[1:][owner] - (chunks[owner] - 1 - k) * CHUNK  # the first chunk is the short one
    size = np.where(k == 0, lens[owner] - (chunks[owner] - 1) * CHUNK, CHUNK)
    hashed = np.empty((len(owner), len(bases)), dtype=np.int64)
    padded = np.concatenate((np.zeros(CHUNK, np.uint8), body))
    for lo in range(0, len(owner), 2048):
        view = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[end[lo : lo + 2048]].astype(np.float64) + 1
        view *= np.arange(CHUNK) >= CHUNK - size[lo : lo + 2048, None]
        hashed[lo : lo + 2048] = _mod((view @ table).astype(np.int64))
    shifted = _mod(hashed * powers((chunks[owner] - 1 - k) * CHUNK, bases))
    total = np.concatenate((np.zeros((1, len(bases)), np.int64), np.cumsum(shifted, axis=0)))
    return _mod(total[at[1:]] - total[at[:-1]])


def combine(left: np.ndarray, right: np.ndarray, right_len: np.ndarray, bases: np.ndarray = BASES) -> np.ndarray:
    """Hashes of joined texts from those of their parts."""
    return _mod(_mod(left * powers(right_len, bases)) + right)


def packed(h: np.ndarray) -> list[np.ndarray]:
    """The four numbers as two of 62 bits."""
    return [h[:, 0] << 31 | h[:, 1], h[:, 2] << 31 | h[:, 3]]


def _hash_rows(extra: list[str], text: str, bases: np.ndarray = BASES):
    """A mapInArrow function: other columns, then two numbers of the text's hash (null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(text)):
                gone = np.asarray(part.is_null())
                a, b = packed(fingerprints(*raw(texts(part)), bases))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(part)) for c in extra] + [pa.array(x, mask=gone) for x in (a, b)], names=[*extra, "h1", "h2"])
                at += len(part)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("n", F.octet_length("text").cast("bigint"))


def fingerprint_rows(docs: DataFrame, huge: int = HUGE, keep_text: bool = False, bases: np.ndarray = BASES) -> DataFrame:
    """doc_id, n (bytes), sha or the text, h1, h2 of each row; the last two are null for a text over `huge` bytes."""
    df = _rows(docs).withColumn("sha", F.sha2("text", 256)).withColumn("hashed", F.when(F.col("n") <= huge, F.col("text")))
    extra = ["doc_id", "n", "text" if keep_text else "sha"]
    return df.select(*extra, "hashed").mapInArrow(freeing(_hash_rows(extra, "hashed", bases)), f"doc_id bigint, n bigint, {extra[2]} string, h1 bigint, h2 bigint")


def cut(df: DataFrame, text: str, size: int, no: str, piece: str) -> DataFrame:
    """Each row once for each `size` characters of its text, numbered from 0; an empty text has one empty piece."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.length(text) - 1) / size).cast("int"))), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias(no, piece))


def fingerprint_huge(docs: DataFrame, huge: int = HUGE, segment: int = SEGMENT, bases: np.ndarray = BASES) -> DataFrame:
    """n, sha, h1, h2 of the distinct texts over `huge` bytes: segments hashed by many tasks, combined by their lengths."""
    big = _rows(docs).where(F.col("n") > huge).withColumn("sha", F.sha2("text", 256)).select("n", "sha", "text")
    parts = cut(big, "text", segment, "seg", "part").withColumn("len", F.octet_length("part").cast("bigint")).repartition("sha", "seg")
    hashed = parts.mapInArrow(freeing(_hash_rows(["n", "sha", "seg", "len"], "part", bases)), "n bigint, sha string, seg int, len bigint, h1 bigint, h2 bigint")

    def join(pdf):
        h = np.zeros((1, len(bases)), np.int64)
        for r in pdf.sort_values("seg").itertuples():
            h = combine(h, np.array([[r.h1 >> 31, r.h1 & P, r.h2 >> 31, r.h2 & P]]), np.array([r.len]), bases)
        a, b = packed(h)
        return pdf[["n", "sha"]].iloc[:1].assign(h1=a, h2=b)

    return hashed.dropDuplicates(["sha", "n", "seg"]).groupBy("n", "sha").applyInPandas(join, "n bigint, sha string, h1 bigint, h2 bigint")


def _differing(docs: DataFrame, groups: DataFrame, n_groups: int, huge: int, late: DataFrame | None, segment: int = SEGMENT, bases: np.ndarray = BASES) -> DataFrame:
    """Fingerprints (h1, h2, n) under which some text differs from the one that stays.

    Only texts of groups with copies move, in chunks. A group meets its kept text in as many parts as its size asks for, and the
    kept text goes to each. late: fingerprints of the texts over `huge` bytes, which are found again by their SHA-256.
    """
    key = ["h1", "h2", "n"]
    twice = groups.where("size > 1").select(*key, "keep_id", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    rows = fingerprint_rows(docs, huge, keep_text=True, bases=bases).where("h1 is not null")
    if late is not None:
        big = _rows(docs).where(F.col("n") > huge).withColumn("sha", F.sha2("text", 256)).join(late, ["sha", "n"])
        rows = rows.unionByName(big.select(*rows.columns))
    rows = rows.join(hinted(twice, n_groups, 1_000_000), key).select(*key, "doc_id", "keep_id", "parts", "text")
    pieces = cut(cut(rows, "text", segment, "seg", "part_text"), "part_text", COMPARE, "no", "piece")
    stays = pieces.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*key, "seg", "no", "parts").agg(F.min("piece").alias("kept_piece"))
    stays = stays.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    others = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    return others.join(stays, [*key, "seg", "no", "part"], "left").where(~F.col("piece").eqNullSafe(F.col("kept_piece"))).select(*key).distinct()


def group_copies(docs: DataFrame, huge: int = HUGE, segment: int = SEGMENT, bases: np.ndarray = BASES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty. The largest doc_id of a group stays; null ids come last, and a group of null ids only has a null
    keep_id and keeps all its rows. Rows that repeat in full count each in group_size and stay or go together; rows of one
    doc_id with different texts are documents of their own. An empty table gives an empty result; other columns are not used.
    """
    marks, late = stage(fingerprint_rows(docs, huge, bases=bases), "fingerprints"), None
    if marks.where("h1 is null").limit(1).count():
        late = stage(fingerprint_huge(docs, huge, segment, bases), "huge")
        own = late.withColumnsRenamed({"h1": "g1", "h2": "g2"})
        marks = stage(marks.join(own, ["sha", "n"], "left").select("doc_id", "n", "sha", F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2")), "fingerprints")
    key = ["h1", "h2", "n"]
    sizes = lambda k: marks.groupBy(*k).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    groups = stage(sizes(key), "groups")
    n_twice = groups.where("size > 1").count()
    if n_twice:
        odd = stage(_differing(docs, groups, n_twice, huge, late, segment, bases), "collisions")
        if odd.limit(1).count():  # tell apart what a fingerprint has mixed up
            marks = marks.join(odd.withColumn("odd", F.lit(True)), key, "left").withColumn("part", F.when(F.col("odd"), F.col("sha")).otherwise("")).drop("odd")
            key = [*key, "part"]
            groups = sizes(key)
    joined = marks.join(groups, key)
    return joined.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts those of the largest doc_id. Rows whose id and text repeat stay together."""
    gone = stage(group_copies(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct(), "copies")
    return docs.join(hinted(gone, gone.count(), SMALL), F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("__sha")), "left_anti")
