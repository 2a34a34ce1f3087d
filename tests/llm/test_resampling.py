"""Importance resampling against a plain count: nulls, empty and repeated rows, several features, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling

FIELDS = "doc_id long, text string, lang string"


def features(text, low, high):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, low=1, high=1, buckets=10_000, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(i, *features(t, low, high)) for i, t in docs]
    mine = Counter(bucket(f) for _, _, fs in told for f in fs)
    theirs = Counter(bucket(f) for t in target for f in features(t, low, high)[1])
    s, t = sum(mine.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (s + buckets) / ((mine[b] + 1) * (t + buckets))))
    rows = []
    for i, n, fs in told:
        weight = sum(gain(bucket(f)) for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def texts():
    words = ["Ab", "b\x00c", "ÄÖ", "x-y", "the", "THE", "9z", " ", "漢字", "it's"]
    rows = [(i, " ".join(words[(i * j + j * j) % 10] for j in range(i % 60))) for i in range(150)]
    return [*rows, (200, None), (201, ""), (202, " .,\n "), (203, "the " * 5000), (None, "no id but words " * 9), (7, rows[57][1]), (7, "other text " * 30), (150, rows[149][1]), rows[59], rows[59]]


@pytest.mark.parametrize("stream, more", [(1_000_000, {}), (50, {}), (50, {"low": 1, "high": 3, "buckets": 97, "percent": 60, "least_words": 5})])
def test_resampling(spark, monkeypatch, stream, more):
    monkeypatch.setattr(resampling, "STREAM", stream)
    rows, target = texts(), ["the b c 9z", None, "", "ab ab ab äö"]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], FIELDS).withColumn("stream", F.lit(1)).withColumn("weight", F.lit("w")).repartition(4)
    got = Counter(tuple(r) for r in resampling.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), **more).collect())
    assert got == brute(rows, target, **{"least" if k == "least_words" else k: v for k, v in more.items()})


def test_empty_tables(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts()], FIELDS)
    assert resampling.resample(df.limit(0), df.select("text")).count() == 0
    got = resampling.resample(df, df.select("text").limit(0)).collect()
    assert Counter(tuple(r) for r in got) == brute(texts(), [])
    for wrong in ({"buckets": 1 << 17}, {"low": 0}, {"low": 3, "high": 2}):
        with pytest.raises(ValueError):
            resampling.resample(df, df, **wrong)


def test_runs_are_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts()], FIELDS).repartition(3)
    found = resampling.streams(df, 1, 1, 50)
    want = Counter(zlib.crc32(f.encode()) % 50 for _, t in texts() for f in features(t, 1, 1)[1])
    assert Counter(dict(enumerate(resampling.bucket_counts(found, 50).tolist()))) == Counter({b: want[b] for b in range(50)})
    assert all(np.frombuffer(r.stream, "<u2").size == r.ends[-1] for r in found.collect())


def test_op12(spark):
    where = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    got = resampling.op12_resampling(spark, where)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, target)
