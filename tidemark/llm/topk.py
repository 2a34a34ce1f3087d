"""Exact top-k inner products by norm buckets: local cosine thresholds prune by length or by coordinate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Vectors in a bucket; buckets in a group and queries in a block, which meet in one task.
BUCKET, GROUP, BLOCK = 2_048, 16, 2_048
#: From this local cosine threshold on, coordinates prune; below it, length alone does.
STEEP, FOCUS = 0.7, 4


def floored(column: str, scale: float) -> Column:
    """floor(scale * x) of each component as doubles, or null if the vector may not take part."""
    ok = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    if q.size == 0 or p.size == 0 or np.abs(q).max() * np.abs(p).max() * q.shape[1] < 2**53:
        return (q @ p.T).astype(np.int64)
    return q.astype(np.int64) @ p.astype(np.int64).T


def _pack(group: int):
    """Partitions in order of falling norm -> rows with the bucket group that they belong to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        for frame in frames:
            frame = frame.reset_index(drop=True)
            frame["grp"] = part * (1 << 32) + (seen + frame.index) // group
            seen += len(frame)
            yield frame[["grp", "vec_id", "dim", "norm", "v"]]

    return run


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(new, np.diff(np.concatenate((new, [len(query)]))))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def _first_floor(queries: np.ndarray, ids: np.ndarray, p: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query with the vectors given, -inf if there are fewer."""
    s = _products(queries, p).astype(np.float64)
    s[ids[:, None] == vec[None, :]] = -np.inf
    return np.partition(s, len(vec) - k, axis=1)[:, len(vec) - k] if len(vec) >= k else np.full(len(ids), -np.inf)


def _search(k: int):
    """A block of queries against a group of buckets -> the best k of each query in the group."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64)] * 3
        if len(left) and len(right):
            q, ids = _matrix(left["v"]), left["query_id"].to_numpy()
            qn, best = left["norm"].to_numpy(), left["theta"].to_numpy().astype(np.float64)
            right = right.sort_values(["norm", "vec_id"], ascending=[False, True])
            everything, all_ids, all_norms = _matrix(right["v"]), right["vec_id"].to_numpy(), right["norm"].to_numpy()
            for at in range(0, len(right), BUCKET):
                p, vec, norm = (x[at : at + BUCKET] for x in (everything, all_ids, all_norms))
                # what a cosine must reach in this bucket for a product to matter; above 1 none does
                with np.errstate(divide="ignore", invalid="ignore"):
                    local = np.where(qn * norm[0] > 0, best / (qn * norm[0]), np.where(best > 0, np.inf, -np.inf))
                steep = (local > STEEP) & (local <= 1 + 1e-9)
                flat = np.flatnonzero(local <= STEEP)
                found_q, found_v = [], []
                if len(flat):
                    # length: the norms fall, so only a prefix can reach the threshold
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.where((best[flat] > 0) & (qn[flat] > 0), best[flat] / qn[flat] * (1 - 1e-9), -np.inf)
                    for lo in range(0, len(flat), 256):
                        some = flat[lo : lo + 256]
                        prefix = np.searchsorted(-norm, -need[lo : lo + 256], side="right")
                        s = _products(q[some], p[: prefix.max(initial=0)])
                        ok = (np.arange(s.shape[1])[None, :] < prefix[:, None]) & (s >= best[some][:, None])
                        x, y = np.nonzero(ok)
                        found_q.append(some[x])
                        found_v.append(y)
                unit = p / np.where(norm > 0, norm, 1)[:, None]
                for i in np.flatnonzero(steep):
                    # coordinate: a unit vector within the angle has each coordinate in an interval
                    u, angle = q[i] / qn[i], math.acos(min(1.0, local[i]))
                    ok = np.ones(len(p), bool)
                    for f in np.argsort(-np.abs(u))[:FOCUS]:
                        own = math.acos(max(-1.0, min(1.0, u[f])))
                        low, high = math.cos(min(math.pi, own + angle)) - 1e-9, math.cos(max(0.0, own - angle)) + 1e-9
                        ok &= (unit[:, f] >= low) & (unit[:, f] <= high)
                    y = np.flatnonzero(ok)
                    found_q.append(np.full(len(y), i))
                    found_v.append(y)
                if not found_q:
                    continue
                x, y = np.concatenate(found_q), np.concatenate(found_v)
                # verify what is left, and keep the best; thresholds rise for the next bucket
                if np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1] < 2**53:
                    s = np.concatenate([np.einsum("ij,ij->i", q[x[j : j + 65536]], p[y[j : j + 65536]]) for j in range(0, max(1, len(x)), 65536)]).astype(np.int64)
                else:
                    s = np.concatenate([np.einsum("ij,ij->i", q[x[j : j + 65536]].astype(np.int64), p[y[j : j + 65536]].astype(np.int64)) for j in range(0, max(1, len(x)), 65536)])
                own = ids[x] == vec[y]
                x, y, s = x[~own], y[~own], s[~own]
                out = list(_best(np.concatenate((out[0], x)), np.concatenate((out[1], vec[y])), np.concatenate((out[2], s)), k))
                held = np.bincount(out[0], minlength=len(ids))
                full = np.flatnonzero(held == k)
                last = np.cumsum(held)[full] - 1
                best[full] = np.maximum(best[full], out[2][last])
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[out[0]] if len(out[0]) else out[0], "vec_id": out[1], "score": out[2]})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer products of each query with all other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``; scores
    are exact, ties go to the smaller vec_id, and with fewer than k candidates all come. Vectors are
    ordered by norm into buckets, buckets into groups. A pilot in the longest bucket gives each query a
    threshold; groups too short for it aren't visited, and in a bucket the local cosine threshold decides
    whether length or coordinates prune, before the products are verified.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
    Vectors meet only vectors of their own dimension. Rows that repeat a query's id count as its own and
    are no candidates; a repeated query id is answered for its rows together. An empty table gives an
    empty one, as do tables without queries. Other columns aren't looked at. Components
    beyond 64 bits saturate there; products beyond 64 bits wrap.

    A task holds GROUP buckets and BLOCK queries, whatever the size of the input; the driver collects one
    norm for each group.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), floored(column, scale).alias("v")).where("vec_id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.withColumn("dim", F.size("v")).withColumn("norm", norm)
    ranged = v.repartitionByRange(parts, "dim", F.col("norm").desc(), "vec_id").sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    grouped = stage(ranged.mapInPandas(_pack(BUCKET * GROUP), "grp long, vec_id long, dim int, norm double, v array<double>"), "buckets")
    groups = [tuple(r) for r in grouped.groupBy("dim", "grp").agg(F.max("norm").alias("top")).collect()]  # one row for each group of 32,768
    queries = grouped.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "norm", "v")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # the pilot: the BUCKET longest vectors of each dimension's first group, the only one that is read for it
    longest = W.partitionBy("dim").orderBy(F.col("norm").desc(), "vec_id")
    first: dict[int, int] = {}
    for dim, grp, _ in groups:
        first[dim] = min(grp, first.get(dim, grp))
    pilot = grouped.where(F.col("grp").isin(*first.values()))  # one number for each dimension
    pilot = pilot.select("dim", "norm", "vec_id", "v").withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= BUCKET).drop("rank")
    pilot = pilot.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def arm(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left.assign(theta=0.0)[["query_id", "dim", "norm", "v", "block", "theta"]]
        left = left.copy()
        floor = np.full(len(left), -np.inf)
        for at in range(0, len(left), 256):
            some = left.iloc[at : at + 256]
            floor[at : at + 256] = _first_floor(_matrix(some["v"]), some["query_id"].to_numpy(), _matrix(right["v"]), right["vec_id"].to_numpy(), k)
        left["theta"] = floor
        return left[["query_id", "dim", "norm", "v", "block", "theta"]]

    armed = queries.groupBy("dim", "block").cogroup(pilot.groupBy("dim", "block")).applyInPandas(arm, "query_id long, dim int, norm double, v array<double>, block long, theta double")
    armed = stage(armed, "queries")
    index = spark.createDataFrame(groups or [(0, 0, 0.0)], "dim int, grp long, top double").where(F.lit(bool(groups)))
    # a block visits the groups whose longest vector could still reach one of its thresholds
    needs = armed.groupBy("dim", "block").agg(F.min(F.when((F.col("norm") > 0) & (F.col("theta") > 0), F.col("theta") / F.col("norm")).otherwise(float("-inf"))).alias("need"))
    cells = needs.join(index, "dim").where(F.col("top") >= F.col("need") * (1 - 1e-9)).select("dim", "block", "grp")
    asked = armed.join(F.broadcast(cells) if blocks * len(groups) <= 100_000 else cells, ["dim", "block"]).select("dim", "block", "grp", "query_id", "norm", "v", "theta")
    visited = grouped.join(F.broadcast(cells) if blocks * len(groups) <= 100_000 else cells, ["dim", "grp"]).select(F.col("dim").alias("of_dim"), F.col("block").alias("of_block"), F.col("grp").alias("of_grp"), "vec_id", "norm", "v")
    cell = ["dim", "block", "grp"]
    found = asked.groupBy(*cell).cogroup(visited.groupBy(*[f"of_{c}" for c in cell])).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
