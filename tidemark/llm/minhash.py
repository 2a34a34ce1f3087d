"""Near-duplicate documents: universal hash minima, banding, verification, large-star/small-star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, stage, tidied

#: 24 bands of 5 minima: a pair at similarity 0.85 shares no band with probability (1 - 0.85**5)**24 < 1e-6.
BANDS, ROWS = 24, 5
#: Shingles, with repeats over documents, of a cell; a hub with more has several cells.
CELL_SHINGLES = 2_000_000
#: Words whose hashes a Python worker remembers before it starts afresh.
CACHED_WORDS = 500_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct hashed shingles of a text, as a sorted array; a shorter text is one shingle of all its words."""

    def __init__(self, width: int):
        self.width, self.words, self.mul = width, _Words(), _odd(width, 5)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() folds A-Z only and bytes.split() cuts at space and 0x09-0x0D only
        words = (text or "").encode("utf-8", "replace").lower().split()
        n, k = len(words), self.width
        if not n:
            return np.empty(0, np.uint64)
        if n < k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        h = w[: n - k + 1] * self.mul[0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(31))) * self.mul[j] + w[j : n - k + 1 + j]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """High halves of the minima of a*x + b (mod 2**64), one for each pair of a and b."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        block = shingles[i : i + 1024, None] * a
        block += b
        np.minimum(low, block.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, text: str, key: str, width: int, bands: int, rows: int) -> DataFrame:
    """(key, n, fp, sig) of every row: set size, digest of the whole set, packed minima (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, a, b = Shingler(width), _odd(bands * rows, 1), _odd(bands * rows, 2)
        for batch in batches:
            n, fp, sig = [], [], []
            for value in batch.column(1):
                s = shingle(value.as_py())
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(_minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["key", "n", "fp", "sig"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), "key long, n long, fp binary, sig binary")


class _Cell:
    """Documents that share a bucket with one hub: links between them by whole sets, as one component label each.

    Everything is held against the hub first. The distance 1 - similarity is a metric, so the distances
    from the hub, with sizes and signatures, rule out most other pairs; pairs that already hang together
    need no look; the rest are decided on the whole sets.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], sig: np.ndarray, block: np.ndarray, percent: int, floor: float):
        self.ids, self.sig, self.block, self.percent, self.floor = np.array(ids), sig, block, percent, floor
        self.size = np.array([len(s) for s in sets])
        words, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.end = np.cumsum(self.size)
        self.mark = np.zeros(len(words), np.int64)
        self.label = np.arange(len(ids))

    def _common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's set with those of the others."""
        own = self.at[self.end[x] - self.size[x] : self.end[x]]
        self.mark[own] = 1
        if len(others) == len(self.ids):
            hits, size = self.mark[self.at], self.size
        else:
            hits = self.mark[np.concatenate([self.at[self.end[y] - self.size[y] : self.end[y]] for y in others])]
            size = self.size[others]
        out = np.add.reduceat(hits, np.cumsum(size) - size)
        self.mark[own] = 0
        return out

    def _join(self, x: int, others: np.ndarray, common: np.ndarray) -> None:
        linked = others[100 * common >= self.percent * (self.size[x] + self.size[others] - common)]
        if len(linked):
            old = np.unique(np.append(self.label[linked], self.label[x]))
            self.label[np.isin(self.label, old)] = old[0]

    def links(self, hub: int) -> Iterator[tuple[int, int]]:
        """(id, id of its component's first) of all that hang on another."""
        everything = np.arange(len(self.ids))
        common = self._common(hub, everything)
        self._join(hub, everything, common)
        far = 1 - common / (self.size[hub] + self.size - common)
        most = 1 - self.percent / 100 + 1e-9
        main = self.label[hub]
        for x in np.flatnonzero(self.label != main):
            ok = (self.label != self.label[x]) & ((self.label == main) | (everything > x)) & (np.abs(far - far[x]) <= most)
            ok &= 100 * np.minimum(self.size, self.size[x]) >= self.percent * np.maximum(self.size, self.size[x])
            ok &= (self.block != self.block[x]) | (self.block == 0)
            ok[hub] = False
            others = np.flatnonzero(ok)
            if len(others):
                others = others[(self.sig[others] == self.sig[x]).mean(axis=1) >= self.floor]
            if len(others):
                self._join(x, others, self._common(x, others))
        for x in np.flatnonzero(self.label != everything):
            yield int(self.ids[x]), int(self.ids[self.label[x]])


def _decide(width: int, percent: int, floor: float):
    """Rows in order of their cell -> links; a cell's rows may span batches, and wait until it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        cell, rows = None, []

        def told() -> pa.RecordBatch:
            pairs: list[tuple[int, int]] = []
            if len(rows) > 1:
                hub, one, other = cell
                ids = [r[3] for r in rows]
                sets = [shingle(r[4]) for r in rows]
                sig = np.frombuffer(b"".join(r[5] for r in rows), "<u4").reshape(len(rows), -1)
                # within a diagonal cell all are compared (block 0); elsewhere only the two blocks with each other
                block = np.array([0 if one == other else 1 + (r[6] == other) for r in rows])
                pairs = list(_Cell(ids, sets, sig, block, percent, floor).links(ids.index(hub)))
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != cell:
                    if rows:
                        yield told()
                    cell, rows = row[:3], []
                rows.append(row)
        if rows:
            yield told()

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents link when their sets of ``width``-word shingles (A-Z lower-cased; a shorter text is one
    shingle) have 100 * intersection >= percent * union. Method: documents with equal sets fold into a
    class named by its smallest id; ``bands * rows`` universal hash minima of each class are banded; the
    smallest class of a bucket is its hub, and all that share a bucket with a hub form its cell. A cell
    decides every pair, by signatures first and whole sets then, but gives out only one link for each
    document; large-star/small-star joins the cells. A big group of copies so costs links in proportion
    to its size, and yet no candidate pair stays undecided.

    Empty or null texts have no set and link with nothing. A null id can't be named: component_id is
    null and kept is true. Rows with one id are one node; where their texts
    differ, the least of them is compared; each row comes back. An empty
    table gives an empty one, and other columns of ``docs`` are not looked at.
    """
    sigs = stage(signatures(docs, text, key, width, bands, rows), "sigs")
    usable = sigs.where("key is not null and n > 0")
    reps = stage(usable.groupBy("fp").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    slices = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(bands)])
    banded = reps.select("rep", "n", F.explode(slices).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where("hub <> other")
    members = stage(banded.join(shared.select("bucket", "hub"), "bucket").select("hub", "rep", "n").distinct(), "members")
    # a hub with more than a cell's shingles has its members in several blocks, which meet two by two
    blocks = members.groupBy("hub").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.transform(every, lambda x: F.struct(F.least(x, "block").alias("one"), F.greatest(x, "block").alias("other")))
    cross = F.flatten(F.transform(every, lambda x: F.transform(F.sequence(x, F.col("blocks") - 1), lambda y: F.struct(x.alias("one"), y.alias("other")))))
    placed = placed.select("hub", "rep", "block", F.explode(F.when(F.col("rep") == F.col("hub"), cross).otherwise(own)).alias("c"))
    needed = members.select("rep").distinct()
    named = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    few = stage(named.hint("merge").join(needed, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text")), "texts")
    told = placed.join(few, "rep").join(reps.select("rep", "sig"), "rep").select("hub", "c.one", "c.other", "rep", "text", "sig", "block")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = max(0.0, percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5)
    told = told.repartition(parts, "hub", "one", "other").sortWithinPartitions("hub", "one", "other", "rep")
    parts = components(told.mapInArrow(tidied(_decide(width, percent, floor)), "a long, b long"))
    rooted = reps.select("fp", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    out = sigs.select("key", "n", "fp").join(rooted, "fp", "left")
    cid = F.when(F.col("key").isNotNull(), F.coalesce("root", "key"))
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("key") == cid, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
