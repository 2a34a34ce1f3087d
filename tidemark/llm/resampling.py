"""Target-distribution importance resampling: hashed n-gram counts from sorted streams, gains gathered a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage, tidied

#: Features of a stream, after which it ends with its document; streams hold two bytes a feature.
STREAM = 1_000_000
#: Buckets that 16 bits can tell apart.
MOST_BUCKETS = 1 << 16
#: A-Z becomes a-z; what is no letter, digit or byte of a character beyond ASCII becomes a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_STREAMS = "doc_id array<long>, n_words array<long>, ends array<long>, stream binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def _streams(low: int, high: int, buckets: int):
    """(doc_id, text) -> rows of many documents: their ids, words, ends of their features, and all features' buckets packed."""
    crc = zlib.crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        many: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            kinds = [pa.list_(pa.int64())] * 3
            columns = [pa.array([x], kind) for x, kind in zip((ids, many, ends), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary())], ["doc_id", "n_words", "ends", "stream"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = words_of(text.as_py())
                found = [np.fromiter(map(crc, words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]), np.uint32) for n in range(low, high + 1)]
                parts.append((np.concatenate(found) % buckets).astype(np.uint16))
                ids.append(doc)
                many.append(len(words))
                held += len(parts[-1])
                if held >= STREAM or len(ids) >= STREAM:
                    yield row()
                    ids, many, parts, held = [], [], [], 0
        if ids:
            yield row()

    return tidied(run)


def _counted(buckets: int):
    """Streams -> (bucket, n): each is sorted and run-length encoded, a task's runs are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch["stream"]:
                code = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
                total[code[at]] += np.diff(np.concatenate((at, [len(code)])))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return tidied(run)


def _weighed(gains: np.ndarray):
    """Streams -> a row for each document with the sum of its features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, many, ends, stream in zip(*(batch[c] for c in ("doc_id", "n_words", "ends", "stream")), strict=True):
                ends = ends.values.to_numpy()
                size = np.diff(ends, prepend=0)
                # an empty document has no place of its own in the stream
                full = np.flatnonzero(size)
                weight = np.zeros(len(ends), np.int64)
                if len(full):
                    weight[full] = np.add.reduceat(gains[np.frombuffer(stream.as_py(), "<u2")], (ends - size)[full])
                columns = [ids.values, many.values, pa.array(size), pa.array(weight)]
                for at in range(0, len(ends), 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in columns], ["doc_id", "n_words", "n_features", "weight"])

    return tidied(run)


def streams(docs: DataFrame, low: int, high: int, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed bucket streams of the features of ``docs``, written to the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return stage(rows.mapInArrow(_streams(low, high, buckets), _STREAMS), "streams")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in the streams; the driver sees a row for each bucket."""
    out = np.zeros(buckets, np.int64)
    rows = found.select("stream").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def noise(seed: int, key: Column) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 8 hexadecimal digits of the SHA-256 of "seed:key"; null for a null key."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the place in it."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))], [*batch.schema.names, "part", "place"])
        seen += n


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its places in ``order``, from 1: a range shuffle, then a count of each partition before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} {k}" for c, k in df.dtypes)
    rows = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{kinds}, part int, place long"), "ranked")
    # a row for each partition
    before = rows.groupBy("part").agg(F.max("place").alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select(*df.columns, (F.col("before") + F.col("place")).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank: documents drawn so that they resemble the ``target`` texts.

    Features are the runs of ``low`` to ``high`` words, lower-cased in A-Z only, by the CRC-32 of their bytes
    modulo ``buckets``. A bucket's gain is floor(1000 * ln) of its smoothed share in the target over that in the
    documents, a document's weight is the sum over its features, and its score adds Gumbel noise from its
    id: the floor(percent * N / 100) best of the N documents with ``least_words`` words are a draw without
    replacement in proportion to exp(weight / 1000). rank is null for the others.

    Features are written once, as packed 16-bit streams with the ends of documents; streams are sorted and
    run-length encoded for the counts, and read again for the weights. The driver sees a count for each
    bucket. Documents without text have no features, weight 0 and still a score; rows without an id have
    neither score nor rank, though their features count. Rows that share an id are rows of their own, with
    one noise: the one with fewer features, then the lesser weight, is first among equal scores. Empty
    tables are fine, on either side. Other columns aren't looked at.
    """
    if not 0 < buckets <= MOST_BUCKETS or not 0 < low <= high:
        raise ValueError("a bucket has 16 bits, and features have one word at least")
    mine = streams(docs, low, high, buckets)
    s = bucket_counts(mine, buckets)
    t = bucket_counts(streams(target.withColumn("doc_id", F.lit(None)), low, high, buckets), buckets)
    gains = np.floor(1000 * np.log((t + 1.0) * (float(s.sum()) + buckets) / ((s + 1.0) * (float(t.sum()) + buckets)))).astype(np.int64)
    rows = mine.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    rows = stage(rows.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "weighed")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = percent * rows.where(able).count() // 100
    kept = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    first = ranked(rows.where(able).select(*kept), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.union(rows.where(~able).select(*kept, F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
