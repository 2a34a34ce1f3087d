"""Vantage-point trees against brute force: ties, copies, rings, several shards and blocks, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every=100):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = tuple(float(np.float32(x)) + 0.0 for x in v)
            ok[i] = min(v, ok.get(i, v))
    want = {}
    for q, a in ok.items():
        if q % every == 0:
            all_ = []
            for c, b in ok.items():
                if c != q and len(a) == len(b):
                    total = 0.0
                    for x, y in zip(a, b, strict=True):
                        total += (x - y) * (x - y)
                    all_.append((math.sqrt(total), c))
            for rank, (d, c) in enumerate(sorted(all_)[:k], 1):
                want[q, rank] = (c, d)
    return want


def vectors(n=700, dim=5, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in middles[i % 6]], 0) for i in range(n)]
    rows += [(n + i, [1.0] * dim, 0) for i in range(260)]  # copies, three of them queries
    rows += [(2000 + i, [float(i % 3), float(i % 2), 0.0, 0.0, -0.0], 0) for i in range(120)]  # ties
    return rows


ODD = [(None, [1.0] * 5, 0), (3000, None, 0), (3100, [0.0] * 5, 0), (3200, [1.0, None, 0.0, 0.0, 0.0], 0), (3300, [math.nan] * 5, 0), (3400, [math.inf, 0.0, 0.0, 0.0, 0.0], 0), (3500, [], 0), (3600, [1.0, 2.0], 0), (3700, [3.0, 2.0], 0), (3600, [1.0, 2.0], 1), (3800, [9.0, 9.0, 9.0, 9.0, 9.0], 0), (3800, [8.0, 9.0, 9.0, 9.0, 9.0], 0), (-100, [1.0] * 5, 0)]


def told(df, **more):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, **more).collect()}


@pytest.mark.parametrize("shard, block, leaf", [(8_192, 8_192, 64), (40, 3, 4), (7, 1, 2)])
def test_neighbours(spark, monkeypatch, shard, block, leaf):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(neighbours, name, value)
    rows = vectors() + ODD
    df = spark.createDataFrame(rows, ROWS).withColumn("nr", F.lit(1)).withColumn("query", F.lit("x")).repartition(5)
    assert told(df) == brute(rows, 10)
    if shard == 40:
        assert told(df, k=3) == brute(rows, 3) and told(df, k=200, every=700) == brute(rows, 200, 700)


def test_tables_without_neighbours(spark):
    df = spark.createDataFrame(vectors(), ROWS)
    assert told(df.limit(0)) == {} and told(df.where("vec_id % 100 <> 0")) == {} and told(df.where("vec_id = 0")) == {}
    doubles = spark.createDataFrame([(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e200, 2.0])], "vec_id long, embedding array<double>")
    assert told(doubles) == {(0, 1): (2, 1.0), (0, 2): (1, math.inf)}


def test_trees_skip_what_is_far():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c * 20, 1, (400, 6)) for c in range(8)])
    tree, looked = neighbours.Tree.of(points), []
    plain = neighbours.distances

    def counting(a, b):
        looked.append(len(a) * len(b))
        return plain(a, b)

    recall, work = {}, {}
    for factor in (1.0, 1.5, 4.0):
        found = neighbours.Found(np.full(50, np.inf), 11, np.arange(len(points)), np.ones(len(points), np.int64))
        found.most = tree.own_leaf(np.arange(0, 3200, 64), found.enough)
        looked.clear()
        neighbours.distances = counting
        try:
            neighbours.search(tree, points[::64], found, factor)
        finally:
            neighbours.distances = plain
        best = np.argsort(plain(points[::64], points), axis=1)[:, :11]
        recall[factor] = np.mean([len(set(a) & set(b)) / 11 for a, b in zip(found.at, best, strict=True)])
        work[factor] = sum(looked)
    assert recall[1.0] == 1 and recall[1.5] >= 0.9 and work[1.0] < 0.2 * 50 * len(points) and work[4.0] < work[1.5] < work[1.0]
    with pytest.raises(ValueError):
        neighbours.nearest(None, factor=0.5)


def test_op11_is_brute_force(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.op11_neighbours(spark, where).collect()}
    assert got == brute(rows, 10)
