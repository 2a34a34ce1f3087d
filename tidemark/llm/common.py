"""Scratch tables, component labelling and text helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space and the five ASCII control characters that bytes.split() also knows.
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset in a local session, as in tests, a temporary folder is made and set; on a
    cluster an unset folder is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


#: Where the run that is going on notes the folders that it stages; None: nobody asked for them.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def noted(folders: list[str]) -> Iterator[list[str]]:
    """Notes in ``folders`` what is staged inside, for ``delete``. Tables staged elsewhere aren't touched."""
    before = _FOLDERS.set(folders)
    try:
        yield folders
    finally:
        _FOLDERS.reset(before)


def stage(df: DataFrame, name: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    if (folders := _FOLDERS.get()) is not None:
        folders.append(path)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete the noted folders, which nothing may read any more, and forget them."""
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Delete the folder behind a staged table that nothing reads any more."""
    delete(df.sparkSession, [f for f in {f.rpartition("/")[0] for f in df.inputFiles()} if "/tidemark/" in f])


def tidied(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, after which its worker returns free memory to the system.

    Spark keeps Python workers for the tasks of later stages, whose memory adds to what they still hold.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidy


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node reachable; nodes without links are absent.

    Alternating large-star and small-star: each round hangs the larger neighbours of a node, then the
    smaller ones, on the smallest node it sees. Rounds grow with the logarithm of the longest path.
    Every round is a few joins on the node, written to the shared folder; the driver sees two numbers.
    Null ends and self-links are ignored; an empty table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, now, last, seen = now, after, seen, _fingerprint(after)
        unstage(before)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _fingerprint(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first())


def base32_of_hex(digest: Column) -> Column:
    """40 hexadecimal digits -> 32 base-32 ones: five of the first are twenty bits, as are four of the second."""
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
