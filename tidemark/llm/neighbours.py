"""Nearest neighbours by vantage-point trees, one a shard, pruned by the triangle inequality."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage, tidied

#: Vectors of a shard and queries of a block, at most, which meet in one task; vectors of a leaf.
SHARD, BLOCK, LEAF = 8_192, 8_192, 64
#: A shard's vectors in bytes as doubles, at most: with many components it holds fewer.
SHARD_BYTES = 8 << 20
#: Vectors, at most, around which shards are laid in rings; components subtracted at once.
CENTRES, AT_ONCE = 256, 2_000_000
#: Bounds give way by this share of the lengths they come from, for what rounding may have changed.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` from all of ``b``, squares summed in the order of the components."""
    out = np.empty((len(a), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for at in range(0, len(a), step):
        gap = a[at : at + step, None, :] - b[None, :, :]
        np.multiply(gap, gap, out=gap)
        out[at : at + step] = np.sqrt(np.add.accumulate(gap, axis=2, out=gap)[:, :, -1])
    return out


class Tree:
    """A vantage-point tree: a node parts its vectors by their distance from one of them, halves are its children.

    ``node`` has for each node its vantage (-1: a leaf), its children, and the span of its own vectors in
    ``order``; ``near`` and ``far`` have the least and greatest distances of each child from the vantage.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, node: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.points, self.order, self.node, self.near, self.far = points, order, node, near, far

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        node: list[list[int]] = []
        near: list[list[float]] = []
        far: list[list[float]] = []

        def grow(start: int, stop: int) -> int:
            me = len(node)
            node.append([-1, -1, -1, start, stop])
            near.append([0.0, 0.0])
            far.append([0.0, 0.0])
            if stop - start > leaf:
                # the vector farthest from any one sees the others at the most different distances
                away = start + int(np.argmax(distances(points[order[start : start + 1]], points[order[start:stop]])[0]))
                order[start], order[away] = order[away], order[start]
                d = distances(points[order[start : start + 1]], points[order[start + 1 : stop]])[0]
                half = len(d) // 2
                part = np.argpartition(d, half)
                order[start + 1 : stop] = order[start + 1 : stop][part]
                d = d[part]
                near[me] = [d[:half].min(), d[half:].min()]
                far[me] = [d[:half].max(), d[half:].max()]
                node[me][0] = order[start]
                node[me][1] = grow(start + 1, start + 1 + half)
                node[me][2] = grow(start + 1 + half, stop)
            return me

        grow(0, len(points))
        return cls(points, order, np.array(node, np.int64), np.array(near), np.array(far))

    def own_leaf(self, who: np.ndarray, enough: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """What ``enough`` tells of the distances of each of the vectors ``who`` from those of its own leaf; infinity if it is in none."""
        leaf = np.full(len(self.points), -1)
        for i, (vantage, _, _, start, stop) in enumerate(self.node):
            if vantage < 0:
                leaf[self.order[start:stop]] = i
        out = np.full(len(who), np.inf)
        for i in np.unique(leaf[who]):
            if i >= 0:
                mine = np.flatnonzero(leaf[who] == i)
                near = self.order[self.node[i, 3] : self.node[i, 4]]
                out[mine] = enough(distances(self.points[who[mine]], self.points[near]), near)
        return out


class Found:
    """The best ``k`` ids of each query so far; a vector with several ids counts as often."""

    def __init__(self, most: np.ndarray, k: int, ids: np.ndarray, count: np.ndarray):
        self.k, self.ids, self.count, self.most = k, ids, count, most.astype(np.float64)
        self.d = np.full((len(most), k), np.inf)
        self.at = np.full((len(most), k), -1)

    def reach(self, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The distance at which the sorted rows have k ids, infinity where they have fewer."""
        held = np.where(at >= 0, self.count[at], 0).cumsum(axis=1)
        full = held[:, -1] >= self.k
        return np.where(full, d[np.arange(len(d)), np.argmax(held >= self.k, axis=1)], np.inf)

    def enough(self, d: np.ndarray, near: np.ndarray) -> np.ndarray:
        order = np.argsort(d, axis=1)
        return self.reach(np.take_along_axis(d, order, axis=1), near[order])

    def offer(self, who: np.ndarray, d: np.ndarray, near: np.ndarray) -> None:
        hit = (d <= self.most[who][:, None]).any(axis=1)
        if not hit.any():
            return
        who, d = who[hit], d[hit]
        all_d = np.concatenate((self.d[who], np.where(d <= self.most[who][:, None], d, np.inf)), axis=1)
        all_at = np.concatenate((self.at[who], np.where(d <= self.most[who][:, None], near[None, :], -1)), axis=1)
        order = np.lexsort((np.where(all_at >= 0, self.ids[all_at], np.iinfo(np.int64).max), all_d), axis=1)[:, : self.k]
        self.d[who], self.at[who] = np.take_along_axis(all_d, order, axis=1), np.take_along_axis(all_at, order, axis=1)
        self.most[who] = np.minimum(self.most[who], self.reach(self.d[who], self.at[who]))


def search(tree: Tree, queries: np.ndarray, found: Found, factor: float) -> None:
    """Offers to ``found`` each vector of the tree that may be near enough; a bound counts ``factor`` times."""

    def visit(i: int, who: np.ndarray) -> None:
        vantage, left, right, start, stop = tree.node[i]
        if vantage < 0:
            near = tree.order[start:stop]
            found.offer(who, distances(queries[who], tree.points[near]), near)
            return
        d = distances(queries[who], tree.points[vantage : vantage + 1])
        found.offer(who, d, np.array([vantage]))
        with np.errstate(invalid="ignore"):
            bound = np.maximum(tree.near[i] - d, d - tree.far[i]) - SLACK * (d + tree.far[i])
        sides = [(0, left), (1, right)]
        for side, child in sides if np.nansum(bound[:, 0] - bound[:, 1]) <= 0 else sides[::-1]:
            still = ~(bound[:, side] * factor > found.most[who])
            if still.any():
                visit(child, who[still])

    if len(queries) and len(tree.points):
        visit(0, np.arange(len(queries)))


def _packed(**arrays: np.ndarray) -> bytes:
    to = io.BytesIO()
    np.savez(to, **arrays)
    return to.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as kept:
        return {name: kept[name] for name in kept.files}


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _hits(queries: np.ndarray, found: Found, spans: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(query, vec_id, score), a row for each id of the vectors found."""
    q, j = np.nonzero(found.at >= 0)
    at = found.at[q, j]
    n = spans[at + 1] - spans[at]
    flat = np.repeat(spans[at] - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[q], n)), pa.array(ids[flat]), pa.array(np.repeat(found.d[q, j], n))], ["query", "vec_id", "score"])


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Sorted rows in pieces of one dimension and cell, of ``most`` rows and SHARD_BYTES at most."""
    held: list[pa.RecordBatch] = []
    key, room = None, 0
    for batch in batches:
        place = list(zip(batch["dim"].to_numpy(), batch["cell"].to_numpy(), strict=True))
        at = 0
        while at < len(place):
            if place[at] != key or room == 0:
                if held:
                    yield pa.Table.from_batches(held)
                held, key = [], place[at]
                room = max(2, min(most, SHARD_BYTES // (8 * int(key[0]))))
            to = at + 1
            while to < len(place) and place[to] == key and to - at < room:
                to += 1
            held.append(batch.slice(at, to - at))
            room -= to - at
            at = to
    if held:
        yield pa.Table.from_batches(held)


_SHARDS = "kind string, nr long, dim int, cell int, lo double, hi double, needs array<struct<cell: int, lo: double, hi: double>>, data binary, query array<long>, vec_id array<long>, score array<double>"
_FOUND = "query long, vec_id long, score double"


def _index(k: int, factor: float, centres: dict[int, np.ndarray]):
    """Sorted partitions -> a row for each shard with its tree, one for each block of queries, and what the queries' own shards have."""
    ring = pa.list_(pa.struct([("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
    schema = pa.schema([("kind", pa.string()), ("nr", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("needs", ring), ("data", pa.binary()), ("query", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([values], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr = blocks = TaskContext.get().partitionId() << 32
        asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]] = []

        def block() -> pa.RecordBatch:
            nonlocal blocks
            blocks += 1
            dim = asked[0][0]
            q, names, most = (np.concatenate([x[i] for x in asked]) for i in (1, 2, 3))
            needs = []
            if dim in centres:
                d = distances(q.astype(np.float64), centres[dim])
                with np.errstate(invalid="ignore"):
                    low = np.nan_to_num((d * (1 - SLACK) - most[:, None] / factor), nan=-np.inf, neginf=-np.inf, posinf=np.inf).min(axis=0)
                    high = np.nan_to_num((d * (1 + SLACK) + most[:, None] / factor), nan=np.inf, neginf=-np.inf, posinf=np.inf).max(axis=0)
                needs = [{"cell": c, "lo": float(a), "hi": float(b)} for c, (a, b) in enumerate(zip(low, high, strict=True))]
            needs.append({"cell": -1, "lo": -math.inf, "hi": math.inf})
            return row(kind="block", nr=blocks, dim=dim, needs=needs, data=_packed(q=q, names=names, most=most, homes=np.concatenate([np.full(len(x[1]), x[4]) for x in asked])))

        for piece in _pieces(batches, SHARD):
            nr += 1
            dim, cell = piece["dim"][0].as_py(), piece["cell"][0].as_py()
            points = _matrix(piece["v"].combine_chunks(), dim)
            names, away = piece["id"].to_numpy(), piece["away"].to_numpy()
            lists = piece["ids"].combine_chunks()
            ids, spans = lists.flatten().to_numpy(), np.concatenate(([0], lists.value_lengths().to_numpy().cumsum()))
            tree = Tree.of(points.astype(np.float64), LEAF)
            who = np.flatnonzero(piece["asked"].to_numpy(zero_copy_only=False))
            if len(who):
                found = Found(np.full(len(who), np.inf), k + 1, names, np.diff(spans))
                found.most = tree.own_leaf(who, found.enough)
                search(tree, tree.points[who], found, factor)
                hits = _hits(names[who], found, spans, ids)
                yield row(kind="found", query=hits[0], vec_id=hits[1], score=hits[2])
                if asked and (asked[0][0] != dim or sum(len(x[1]) for x in asked) + len(who) > BLOCK):
                    yield block()
                    asked.clear()
                asked.append((dim, points[who], names[who], found.most, nr))
            yield row(kind="shard", nr=nr, dim=dim, cell=cell, lo=float(away[0]), hi=float(away[-1]), data=_packed(points=points, names=names, ids=ids, spans=spans, order=tree.order, node=tree.node, near=tree.near, far=tree.far))
        if asked:
            yield block()

    return tidied(run)


def _meet(k: int, factor: float):
    """A block of queries and a shard that isn't the home of all of them -> what the shard has for them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))]
        if len(left) and len(right):
            b, s = _unpacked(left["data"][0].as_py()), _unpacked(right["data"][0].as_py())
            other = b["homes"] != right["of_shard"][0].as_py()
            tree = Tree(s["points"].astype(np.float64), s["order"], s["node"], s["near"], s["far"])
            found = Found(b["most"][other], k + 1, s["names"], np.diff(s["spans"]))
            search(tree, b["q"][other].astype(np.float64), found, factor)
            out.append(_hits(b["names"][other], found, s["spans"], s["ids"]))
        return pa.Table.from_batches(out)

    return run


def _cells(centres: dict[int, np.ndarray]):
    """Adds the nearest centre of a vector and its distance; -1 and 0 for dimensions without centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cell, away = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if int(dim) in centres:
                    at = np.flatnonzero(dims == dim)
                    d = distances(_matrix(batch["v"].take(pa.array(at)), int(dim)).astype(np.float64), centres[int(dim)])
                    cell[at] = d.argmin(axis=1)
                    away[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


def _clean(column: str) -> Column:
    """The vector with -0 as 0, or null where it holds null or non-finite components or nothing but zeros."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    return F.when(good, F.transform(column, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors nearest to each query, by Euclidean distance in doubles.

    Queries are the rows whose id is divisible by ``every``; all rows but the query's own are candidates,
    ties go to the smaller id, and with fewer than k candidates all come. Vectors are dealt to the nearest
    of some sampled centres and cut into shards, rings around a centre; each shard has a vantage-point
    tree. The queries of a shard search it first, then only shards whose ring may hold something nearer,
    in which a subtree is skipped where ``factor`` times its triangle bound exceeds the k-th distance so
    far: with factor 1 results are exact, a greater one skips more and may miss some. Every vector is in
    a shard; only the centres are a sample (at most CENTRES, those with the least hash of their ids).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
    an id. Vectors meet only vectors of their own dimension. Rows that share an id are one vector, the
    least. Equal vectors are one in the trees, with their k + 1 smallest ids, as no more can be among k
    nearest; so very many copies cost no more than one. An empty table gives an empty one, as do tables
    without queries. Other columns aren't looked at. Integer and decimal components are taken as doubles.

    A task holds a shard and a block of queries. The driver sees two counts and the centres. On vectors
    without any structure every block visits every shard: work then grows with queries times vectors.
    """
    if factor < 1:
        raise ValueError("factor is at least 1")
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[column]
    v = F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").withColumn("v", _clean("v")).where("v is not null")
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("asks", F.col("vec_id") % every == 0)
    # of equal vectors the smallest ids, queries and others apart, so that one of each kind is seen
    first = F.row_number().over(W.partitionBy("v", "asks").orderBy("vec_id"))
    few = rows.withColumn("nr", first).where(F.col("nr") <= k + 1)
    points = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asked"))
    points = stage(points.select(F.col("ids")[0].alias("id"), F.size("v").alias("dim"), "v", "ids", "asked"), "points")
    many = min(CENTRES, math.ceil(points.count() / SHARD))
    centres: dict[int, np.ndarray] = {}
    for dim, vs in points.orderBy(F.xxhash64("id"), "id").limit(many).groupBy("dim").agg(F.collect_list("v")).collect():
        centres[dim] = np.array(vs, np.float64)
    placed = points.mapInArrow(_cells(centres), f"id long, dim int, v {points.schema['v'].dataType.simpleString()}, ids array<long>, asked boolean, cell int, away double")
    order = ["dim", "cell", "away", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = stage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_index(k, factor, centres), _SHARDS), "trees")

    block, shard = index.where("kind = 'block'"), index.where("kind = 'shard'")
    needs = block.select(F.col("nr").alias("block"), F.col("dim").alias("of_dim"), F.inline("needs").alias("of_cell", "least", "most"))
    visits = needs.join(shard.select(F.col("nr").alias("shard"), "dim", "cell", "lo", "hi"), (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell")) & (F.col("hi") >= F.col("least")) & (F.col("lo") <= F.col("most")))
    visits = visits.select("block", "shard")
    asking = visits.join(block.select(F.col("nr").alias("block"), "data"), "block")
    asked = visits.join(shard.select(F.col("nr").alias("shard"), "data"), "shard").select(F.col("block").alias("of_block"), F.col("shard").alias("of_shard"), "data")
    met = asking.groupBy("block", "shard").cogroup(asked.groupBy("of_block", "of_shard")).applyInArrow(_meet(k, factor), _FOUND)
    home = index.where("kind = 'found'").select(F.inline(F.arrays_zip("query", "vec_id", "score")))
    best = W.partitionBy("query").orderBy("score", "vec_id")
    found = home.union(met).withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= k + 1).drop("nr")
    # a query's vector may be that of many queries: each leaves itself out
    owners = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(points.where("asked").select("v", F.col("id").alias("query")), "v").select("query_id", "query")
    own = found.join(owners, "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, x: a + x)) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
