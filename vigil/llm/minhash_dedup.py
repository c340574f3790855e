"""MinHash near-deduplication: banded minima of many universal hashes, signature checks, links confirmed on full sets.

Texts of equal shingle sets form a class, which one of them stands for. Classes that share a band of their signatures are
candidates. First the members of some bands' groups meet their least member; what signatures and full sets confirm is joined
(large-star and small-star). Groups within one component are done. In the others, members outside the main component (the
largest that has a member there) meet a few pivots in turns, which a large group of near copies needs. At last those that are
still outside meet the whole group in blocks, where sketches of the sets leave the pairs that may be linked. So no link that
could join two components is lost, and no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, hinted, mix, slices, split_words, stage, text_key, texts, unstage
from .components import components

BANDS, ROWS = 64, 8
#: Minima whose low bytes a signature keeps for its check.
KEPT = 128
#: Shingles hashed at a time, so that they stay in the processor's cache.
CACHED = 1 << 16
#: Rounds in which members outside their group's main component meet so many pivots, before the open pairs that are left are
#: checked one and all; at once where they are no more than LEFT times the classes, or a
#: round has not made them fewer by a third.
PIVOT_ROUNDS, PIVOTS, LEFT = 3, 4, 500
#: Bands whose groups' members meet the least of them first.
STAR_BANDS = 4
#: Hashes of a set that a sketch holds, and rows of a group on either side of a block, when the open pairs are checked.
SKETCH, BLOCK = 2048, 512
#: Groups, or dropped rows, (24 bytes each) that are broadcast at most.
MOST_GROUPS = 500_000
SCHEMA = "doc_id bigint, text_key bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary"


def _universal(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms of the hashes a * x + b modulo 2^32 of a shingle's upper half."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, ragged; fewer words are one shingle, none is no shingle."""
    import xxhash

    codes, offsets, distinct = split_words(arr, lower=True)
    n = len(offsets) - 1
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(distinct))
    word = own[codes] if len(codes) else np.zeros(0, np.uint64)
    lens = np.diff(offsets)
    h = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - k + 1 + j]) if len(h) else h
    doc = np.repeat(np.arange(n), lens)
    ok = doc[: len(h)] == doc[k - 1 :] if len(h) else np.zeros(0, bool)
    values, owner = h[ok], doc[: len(h)][ok]
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        x = lens[short].astype(np.uint64)
        for j in range(k - 1):  # the whole sequence as one
            more = lens[short] > j
            x[more] = mix(x[more] * np.uint64(0xC2B2AE3D27D4EB4F) + word[offsets[:-1][short][more] + j])
        values, owner = np.concatenate((values, x)), np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))


def digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two sums of hashes of each set [n, 2]; all sets non-empty."""
    size = np.diff(at).astype(np.uint64)
    return np.stack([np.add.reduceat(mix(values ^ np.uint64(s)), at[:-1]) + size for s in (0x1234567, 0x89ABCDEF0)], axis=1)


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the sets [n, 2], bands [n, BANDS] and the low bytes of KEPT minima; all sets non-empty."""
    a, b = _universal()
    n = len(at) - 1
    minima = np.empty((BANDS * ROWS, n), dtype=np.uint32)
    half = (values >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CACHED, "right")) - 1)
        x, starts = half[at[lo] : at[hi]], at[lo:hi] - at[lo]
        h = np.empty_like(x)
        for i in range(len(a)):
            np.multiply(x, a[i], out=h)
            np.add(h, b[i], out=h)
            np.minimum.reduceat(h, starts, out=minima[i, lo:hi])
        lo = hi
    bands = np.zeros((BANDS, n), dtype=np.uint64)
    for i in range(BANDS):
        h = np.full(n, i + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[i * ROWS + r].astype(np.uint64))
        bands[i] = h
    return digests(values, at), bands.T, (minima[:: BANDS * ROWS // KEPT].T & np.uint32(255)).astype(np.uint8)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            start = 0
            for part in slices(batch.column(2)):
                values, at = shingle_sets(texts(part), k)
                n, size = len(part), np.diff(at)
                digest, bands, sig = np.zeros((n, 2), np.uint64), None, None
                full = np.flatnonzero(size)
                lists, sigs = [None] * n, [None] * n
                band_offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0))))
                if len(full):
                    digest[full], bands, sig = signatures(values, np.append(at[full], len(values)))
                    for i, s in zip(full.tolist(), sig, strict=True):
                        sigs[i] = s.tobytes()
                flat = bands.reshape(-1).view(np.int64) if bands is not None else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(band_offsets, pa.int32()), pa.array(flat))
                d = digest.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, pa.array(sigs, pa.binary())], names=names)
                start += n

    return run


def _of_classes(k: int):
    """Slices of rows (id, d1, d2, text): ids, sorted sets and offsets of those whose set is their class's. (An id of a document may come with other texts.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            start = 0
            for part in slices(batch.column(3)):
                ids, d1, d2 = (batch.column(i).slice(start, len(part)) for i in range(3))
                start += len(part)
                values, at = shingle_sets(texts(part), k)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    own = digests(values, np.append(at[full], len(values))).view(np.int64)
                    good = (own[:, 0] == d1.to_numpy()[full]) & (own[:, 1] == d2.to_numpy()[full])
                    keep = np.zeros(len(part), dtype=bool)
                    keep[full[good]] = True
                    yield ids.filter(pa.array(keep)), values[np.repeat(keep, np.diff(at))], np.concatenate(([0], np.cumsum(np.diff(at)[keep])))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, at in _of_classes(k)(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "own"])

    return run


def _sketched(k: int):
    """A set's hashes, of those under 2^-level of the range only, so that about SKETCH are left at most; at level 0 the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, at in _of_classes(k)(batches):
            n = np.diff(at)
            level = np.ceil(np.log2(np.maximum(n, 1) / SKETCH)).clip(0, 31).astype(np.int32)
            own = np.repeat(level, n).astype(np.uint64)
            keep = (values >> (np.uint64(63) - own)) <= np.uint64(1)
            ends = np.concatenate(([0], np.cumsum(keep)))[at].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(level), lists], names=["id", "n", "level", "sketch"])

    return run


def _meet(percent: int):
    """Of a block's rows: (asking row, row of another component) whose sketches allow the similarity.

    Whole sets prove it: then one row of that component stands for all, and the two components count as one from there on, so
    that these pairs are fewer than the block's components.
    """
    least = percent / 100

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        col = {c: block.column(c).to_numpy(zero_copy_only=False) for c in ("id", "c", "asks", "n", "level")}
        asks = np.flatnonzero(col["asks"])
        others = np.flatnonzero(~col["asks"])
        found_a, found_b = [], []
        if len(asks) and len(others):
            lists = block.column("sketch").chunk(0)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            names, codes = np.unique(flat, return_inverse=True)
            upper = flat.view(np.uint64)
            mark = np.zeros(len(names), dtype=bool)
            own_c = np.unique(col["c"], return_inverse=True)[1]
            for deep in np.unique(col["level"]).tolist():  # pairs of which this is the coarser sketch
                inside = (upper >> np.uint64(63 - deep)) <= 1
                total = np.concatenate(([0], np.cumsum(inside)))
                size = total[at[1:]] - total[at[:-1]]
                these = others[col["level"][others] <= deep]
                lens = size[these]
                body = np.concatenate([codes[at[i] : at[i + 1]][inside[at[i] : at[i + 1]]] for i in these]) if len(these) else codes[:0]
                ends = np.concatenate(([0], np.cumsum(lens)))
                for i in asks[col["level"][asks] <= deep].tolist():
                    own = codes[at[i] : at[i + 1]][inside[at[i] : at[i + 1]]]
                    mark[own] = True
                    hits = np.concatenate(([0], np.cumsum(mark[body])))
                    mark[own] = False
                    both = hits[ends[1:]] - hits[ends[:-1]]
                    if deep:  # six standard deviations below
                        union = np.maximum(size[i] + lens - both, 1)
                        ok = both / union >= least - 6 * np.sqrt(least * (1 - least) / union)
                    else:
                        ok = (100 + percent) * both >= percent * (col["n"][i] + col["n"][these])
                    ok &= (own_c[these] != own_c[i]) & ((col["level"][these] == deep) | (col["level"][i] == deep))
                    if not deep:  # of those that are linked, one of each component is enough
                        linked = np.flatnonzero(ok)
                        joined, first = np.unique(own_c[these[linked]], return_index=True)
                        ok[:] = False
                        ok[linked[first]] = True
                        own_c[np.isin(own_c, joined)] = own_c[i]
                    found_b.append(col["id"][these[ok]])
                    found_a.append(np.full(len(found_b[-1]), col["id"][i]))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(found_a), "b": join(found_b)})

    return run


def _alike(percent: int):
    """Keeps pairs (u, v) whose sets, sorted, have intersection * 100 >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, dtype=bool)
            ao, bo = np.asarray(a.offsets), np.asarray(b.offsets)
            av, bv = np.asarray(a.values), np.asarray(b.values)
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    return run


class _Linker:
    """Classes, the groups their bands form, and the links confirmed so far."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
        self.marks = stage(self.docs.mapInArrow(freeing(_signed(k)), SCHEMA), "signatures")
        # a class's id is a number of its own: a document's may come with several texts
        self.classes = stage(
            self.marks.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
            .withColumn("id", F.monotonically_increasing_id()),
            "classes",
        )
        self.labels = None  # node, component
        self.rows = self.outs = None  # of groups that hold more than one component

    def texts_of(self, ids: DataFrame, most: int | None = None) -> DataFrame:
        """id, d1, d2, text of some classes (id). most: how many they are at most, if that has been counted."""
        own = self.classes.join(ids, "id").select("id", "d1", "d2", "doc_id")
        return self.docs.join(own if most is None else hinted(own, most, 1_000_000), "doc_id").select("id", "d1", "d2", "text")

    def stars(self) -> DataFrame:
        """Pairs (a, b): each member of a group of the first STAR_BANDS bands with the group's least member."""
        cells = self.classes.select("id", F.explode(F.slice("bands", 1, STAR_BANDS)).alias("band"))
        groups = cells.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("members")).where("size > 1")
        once = groups.groupBy("size", "least", "members").agg(F.min("band").alias("band"))  # of bands with the same members one is enough
        return cells.join(once.select("band", "least"), "band").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))

    def link(self, pairs: DataFrame) -> None:
        """Check pairs (a, b): sizes and signatures, then full sets; join what is linked."""
        own = self.classes.select("id", "n", "sig")
        side = lambda x: own.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(side("u"), "u").join(side("v"), "v")
        near = near.where(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        near = stage(near.mapInArrow(freeing(_near(self.percent)), "u bigint, v bigint"), "near")
        n = near.count()
        if not n:
            return
        ids = near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct()
        sets = stage(self.texts_of(ids, 2 * n).mapInArrow(freeing(_sets(self.k)), "id bigint, own array<bigint>").dropDuplicates(["id"]), "sets")
        a, b = sets.select(F.col("id").alias("u"), F.col("own").alias("own_u")), sets.select(F.col("id").alias("v"), F.col("own").alias("own_v"))
        linked = stage(near.join(a, "u").join(b, "v").select("u", "v", "own_u", "own_v").mapInArrow(freeing(_alike(self.percent)), "u bigint, v bigint"), "links")
        unstage(near, sets)
        if linked.limit(1).count():
            old = self.labels
            stars = None if self.labels is None else self.labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            self.labels = stage(components(linked if stars is None else linked.unionByName(stars)), "labels")
            unstage(linked, *([] if old is None else [old]))

    def open(self) -> int:
        """Find the groups that hold more than one component. rows: band, id and whether it is outside the main component; outs: those outside.

        Returns how many pairs of members outside with any member there are at most.
        """
        own = self.classes.select("id", F.col("id").alias("c"), F.lit(1).cast("bigint").alias("weight"), "bands")
        if self.labels is not None:
            weights = self.labels.groupBy("component").agg(F.count("*").alias("weight"))
            known = self.labels.join(weights, "component").select(F.col("node").alias("id"), "component", "weight")
            own = self.classes.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("c"), F.coalesce("weight", F.lit(1)).alias("weight"), "bands")
        cells = own.select("id", "c", "weight", F.explode("bands").alias("band"))
        groups = cells.groupBy("band").agg(
            F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("weight", "c"))["c"].alias("main"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("members")
        ).where("lo < hi")
        # of bands with the same members one is enough
        groups = stage(groups.groupBy("size", "least", "members", "main").agg(F.min("band").alias("band")).select("band", "main", "size"), "groups")
        n = groups.count()
        if not n:
            return 0
        self.rows = stage(cells.drop("weight").join(hinted(groups, n, MOST_GROUPS), "band").withColumn("out", F.col("c") != F.col("main")), "rows")
        self.outs = self.rows.where("out").drop("out")
        return self.work()

    def work(self) -> int:
        return self.outs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def reopen(self) -> int:
        """After more links: who is still outside. What was in the main component stays there, so that only others are looked up."""
        of = lambda c: self.labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
        now = self.outs.withColumnsRenamed({"c": "was", "main": "own"}).join(of("was"), "was", "left").join(of("own"), "own", "left")
        now = now.select("band", "id", F.coalesce("was_now", "was").alias("c"), F.coalesce("own_now", "own").alias("main"), "size")
        self.outs = stage(now.where("c <> main"), "outs")
        return self.work()

    def pivots(self, turn: int) -> DataFrame:
        """Pairs (a, b): each member outside its group's main component, in the largest of its groups, with a few of that component there."""
        few = self.outs.groupBy("id").agg(F.max_by("band", F.struct("size", "band")).alias("band")).withColumnRenamed("id", "a")
        # each pivot is the least by a hash of a share of the component's members
        part = F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("part")
        some = self.rows.where("not out").groupBy("band", part).agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id"))["id"].alias("b"))
        return few.join(some, "band").select("a", "b")

    def rest(self) -> DataFrame:
        """Pairs (a, b) across components of a group that their sketches don't rule out, for every member outside the main component.

        Such members meet the whole group in blocks of BLOCK by BLOCK, in one task each, which gives back only what may be linked.
        The cells of an id (one for each of its bands at most) are gathered first, so that its sketch moves once.
        """
        main = F.lit(-1).cast("bigint")  # members of the main component need not tell which it is
        inside = self.rows.where("not out").select("band", "id", main.alias("c"), F.lit(False).alias("asks"), "size")
        outside = self.outs.select("band", "id", "c", F.lit(True).alias("asks"), "size")
        joined = self.rows.where("out").select("band", "id").join(self.outs.select("band", "id"), ["band", "id"], "left_anti")  # by now in the main component
        per = stage(self.outs.groupBy("band").agg(F.max("size").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("os")), "per")
        inside = inside.unionByName(joined.join(per.select("band", "size"), "band").select("band", "id", main.alias("c"), F.lit(False).alias("asks"), "size"))
        if per.where("os > 1").limit(1).count() or self.rows.where("out").count() > self.outs.count():
            every = inside.unionByName(outside).drop("size").join(per, "band")
        else:  # all groups are still open, and what is outside of each is one block
            every = inside.unionByName(outside).withColumn("os", F.lit(1))
        cells = every.groupBy("id").agg(F.collect_list(F.struct("band", "c", "asks", F.ceil(F.col("size") / BLOCK).cast("int").alias("ms"), "os")).alias("cells"))
        sketches = self.texts_of(cells.select("id"), self.rows.select("id").distinct().count()).mapInArrow(freeing(_sketched(self.k)), "id bigint, n bigint, level int, sketch array<bigint>").dropDuplicates(["id"])
        rows = sketches.join(cells, "id").select("id", "n", "level", "sketch", F.explode("cells").alias("cell")).select("id", "n", "level", "sketch", "cell.*")
        h = F.xxhash64("id")
        span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_member = F.transform(span("os"), lambda o: F.struct(F.lit(False).alias("asks"), F.pmod(h, "ms").cast("int").alias("m"), o.alias("o")))
        as_asker = F.transform(span("ms"), lambda m: F.struct(F.lit(True).alias("asks"), m.alias("m"), F.pmod(h, "os").cast("int").alias("o")))
        places = F.when(F.col("asks"), F.concat(as_member, as_asker)).otherwise(as_member)
        rows = rows.select("id", "n", "level", "sketch", "band", "c", F.explode(places).alias("at")).select("id", "n", "level", "sketch", "band", "c", "at.*")
        return rows.groupBy("band", "m", "o").applyInArrow(_meet(self.percent), "a bigint, b bigint")

    def run(self) -> DataFrame:
        self.link(self.stars())
        work, few = self.open(), LEFT * self.classes.count()
        for turn in range(PIVOT_ROUNDS):
            if work <= few:
                break
            before = work
            self.link(self.pivots(turn))
            work = self.reopen()
            if work > before * 2 / 3:
                break
        if work:
            self.link(self.rest())
        rep = self.classes.select("id", "d1", "d2", F.col("doc_id").alias("rep"))
        if self.labels is not None:
            own = self.labels.join(rep.select(F.col("id").alias("node"), "rep"), "node")
            least = own.groupBy("component").agg(F.min("rep").alias("least"))
            rep = rep.join(own.join(least, "component").select(F.col("node").alias("id"), "least"), "id", "left").select("d1", "d2", F.coalesce("least", "rep").alias("rep"))
        # the classes' share of rows may be hot: a skewed join
        rows = self.marks.select("doc_id", "text_key", "n_shingles", "d1", "d2")
        grouped = rows.where("n_shingles > 0 and doc_id is not null").join(rep.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "text_key", "n_shingles", F.col("rep").alias("component_id"))
        alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
        return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _near(percent: int):
    """Keeps pairs whose signatures agree within six standard deviations of the least similarity."""
    m = KEPT
    j = percent / 100
    least = m * j - 6 * (m * j * (1 - j)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, m) for c in ("sig_u", "sig_v"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    Two texts are linked if 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lower-cased, words
    between ASCII white space; fewer words are one shingle). Null and empty texts have no shingle and no link. Rows with a null
    doc_id are linked with nothing and stay. Rows that repeat are in one component and stay or go together; rows of one doc_id
    with different texts are documents of their own. An empty table gives an empty result; other columns are not used.
    """
    return _Linker(docs, k, percent).run().drop("text_key")


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with their columns: those of the smallest doc_id of each component, and what is linked with nothing."""
    gone = stage(_Linker(docs, k, percent).run().where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "copies")
    return docs.join(hinted(gone, gone.count(), MOST_GROUPS), (F.col("doc_id").cast("bigint") == F.col("__id")) & (text_key() == F.col("__key")), "left_anti")
