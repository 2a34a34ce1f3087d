"""Near-duplicate vectors: coarse inverted lists, residual product codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import components, stage

#: Vectors that the index is fitted on, at least and at most; every vector is indexed.
SAMPLE, MOST_SAMPLE = 8_000, 200_000
#: Subspaces of a residual and codewords of each; sampled vectors a coarse list, which bounds the lists.
SUBSPACES, CODES, A_LIST = 8, 256, 24
#: Vectors in a cell: several lists, or a part of a long one. Vectors that probe a cell in one task. Queries looked up at once.
CELL, ASKS, TILE = 8_192, 32_768, 512
_STEP, _CHUNK = 8, 4_000_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(axis=1)
    step = max(1, _CHUNK // len(centres))
    return np.concatenate([(size - 2 * (x[at : at + step] @ centres.T)).argmin(axis=1) for at in range(0, max(1, len(x)), step)])


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(_STEP):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def unit(rows: list) -> np.ndarray:
    """Vectors of one dimension at length 1; their largest component is brought to 1 first, so that squares stay in range."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Index:
    """Coarse centres and residual codebooks of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _k_means(sample, min(lists, len(sample)), 1)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(c)]
        self.books = [_k_means(residual[:, c], min(CODES, len(sample)), 2 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, how far the decoded vector is off) of each vector."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            rest[:, c] -= b[codes[:, i]]
        return own, codes, np.sqrt((rest**2).sum(axis=1))

    def border(self, x: np.ndarray, own: np.ndarray, at: int) -> np.ndarray:
        """How far each vector is, at least, from anything in list ``at``: what lies on the other side of the
        plane halfway between two centres is no nearer than that plane. 0 for its own list."""
        centre, mine = self.centres[at], self.centres[own]
        apart = np.sqrt(((mine - centre) ** 2).sum(axis=1))
        further = ((x - centre) ** 2).sum(axis=1) - ((x - mine) ** 2).sum(axis=1)
        return np.where(apart > 1e-9, further / (2 * np.maximum(apart, 1e-9)), 0.0)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> list[list[int]]:
        """For each vector the lists from its own on that may hold one within ``reach``."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for o in np.unique(own):
            # all vectors of one list at once, some at a time
            members = np.flatnonzero(own == o)
            others = self.centres[o:]
            apart = np.sqrt(((others - self.centres[o]) ** 2).sum(axis=1))
            size = (others**2).sum(axis=1)
            for lo in range(0, len(members), max(1, _CHUNK // len(others))):
                some = members[lo : lo + max(1, _CHUNK // len(others))]
                d = size - 2 * (x[some] @ others.T)
                near = (d - d[:, :1] <= 2 * reach * apart + 1e-9) | (apart <= 1e-9)
                near[:, 0] = True
                for i, row in zip(some, near, strict=True):
                    out[i] = (o + np.flatnonzero(row)).tolist()
        return out

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """[query, subspace, code]: squared distances of a query's residual to list ``at`` from the codewords."""
        rest = q - self.centres[at]
        out = np.zeros((len(q), len(self.cuts), max(map(len, self.books))))
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, i, : len(b)] = (rest[:, c] ** 2).sum(axis=1)[:, None] - 2 * (rest[:, c] @ b.T) + (b**2).sum(axis=1)
        return out


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union of the sets of x and y: label[i] is a smaller member of i's set, in the end the smallest."""
    while len(x):
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return label
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim) if len(column) else np.empty((0, dim))


def _compare(models: dict[int, Index], cosine: float):
    """A cell's members against the vectors that probe it -> (vec, links, other): weighted link counts, and
    links that keep the linked together, one for each vector at most."""
    reach = math.sqrt(2 - 2 * cosine) + 1e-9

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec": np.empty(0, np.int64), "links": np.empty(0, np.int64), "other": np.empty(0, np.int64)})
        dim = int(left["dim"].iloc[0])
        model = models[dim]
        right = right.sort_values(["list", "rep"], ignore_index=True)
        q, p = _matrix(left["v"], dim), _matrix(right["v"], dim)
        q_id, p_id = left["rep"].to_numpy(), right["rep"].to_numpy()
        q_list, p_list, q_w, p_w = (f[c].to_numpy() for c in ("list", "w") for f in (left, right))
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        err = right["err"].to_numpy()
        ids, node = np.unique(np.concatenate((q_id, p_id)), return_inverse=True)
        q_node, p_node = node[: len(q_id)], node[len(q_id) :]
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in np.unique(p_list):
            lo, hi = np.searchsorted(p_list, (at, at + 1))
            near = np.flatnonzero(q_list <= at)
            near = near[model.border(q[near], q_list[near], at) <= reach]
            for begin in range(0, len(near), TILE):
                some = near[begin : begin + TILE]
                table, d = model.tables(q[some], at), 0.0
                for i in range(codes.shape[1]):
                    d = d + table[:, i, :][:, codes[lo:hi, i]]
                ok = np.sqrt(np.maximum(d, 0)) <= reach + err[lo:hi] + 1e-9
                ok &= (q_list[some] < at)[:, None] | (q_id[some][:, None] < p_id[lo:hi][None, :])
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                if len(x) > ok.size // 8:  # exact cosines of all that the codes can't rule out
                    hit = (q[some] @ p[lo:hi].T)[x, y] >= cosine
                else:
                    hit = np.einsum("ij,ij->i", q[some[x]], p[lo + y]) >= cosine
                x, y = some[x[hit]], lo + y[hit]
                np.add.at(links, q_node[x], p_w[y])
                np.add.at(links, p_node[y], q_w[x])
                label = _join(label, q_node[x], p_node[y])
        told = np.flatnonzero(links)
        return pd.DataFrame({"vec": ids[told], "links": links[told], "other": ids[label[told]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, column: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine, in doubles, is ``cosine`` or
    more. Equal vectors of a label fold into one with a weight. The index is fitted on SAMPLE vectors; all
    vectors get a coarse list and residual codes. A vector probes every list that can hold a link, by its
    distance from the plane between the centres; table-lookup distances less the code's own error rule
    out pairs, and exact cosines decide the rest. These bounds lose nothing, so the links are all there are.

    Only link counts and one link for each vector and cell leave a cell, never all pairs. Lists longer than
    a cell are split over several, and so are the vectors that probe a cell. Vectors that are null, zero or hold null or non-finite components, and
    those without label, link with nothing. Vectors of different dimensions don't link. Rows without an id
    come back with a null component and kept. Rows that repeat an id count as other vectors, and share a
    component. An empty table gives an empty one; other columns aren't looked at.

    The number of lists grows with the square root of the vectors, up to MOST_SAMPLE / A_LIST lists. In the
    worst case, where vectors of a label have no structure, work grows with the square of a label.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(column).alias("e"))
    fit = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0)
    rows = rows.select("vec_id", "label", "e", F.coalesce(F.col("vec_id").isNotNull() & fit, F.lit(False)).alias("usable"), F.xxhash64(F.lit(1), "label", "e").alias("h1"), F.xxhash64(F.lit(2), "label", "e").alias("h2"))
    usable = rows.where("usable").select("vec_id", "label", "h1", "h2", F.col("e").cast("array<double>").alias("e"))
    folded = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    reps = usable.join(folded, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    reps = stage(reps.select("rep", "w", "label", "h1", "h2", F.size("e").alias("dim"), "e"), "vectors")
    n = reps.count()
    lists = max(1, min(MOST_SAMPLE // A_LIST, int(math.sqrt(n) / 8)))
    sample = reps.orderBy(F.xxhash64(F.lit(7), "rep")).limit(max(SAMPLE, A_LIST * lists)).select("dim", "e").toPandas()
    models = {int(dim): Index(unit(part["e"].to_list()), lists) for dim, part in sample.groupby("dim")}
    missing = [r["dim"] for r in reps.select("dim").distinct().collect() if r["dim"] not in models]
    models |= {dim: Index(np.zeros((1, dim)), 1) for dim in missing}  # dimensions too rare for the sample: one list
    reach = math.sqrt(2 - 2 * cosine) + 1e-9

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                model, u = models[int(dim)], unit(part["e"].to_list())
                own, codes, err = model.encode(u)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "w": part["w"].to_numpy(), "label": part["label"].to_numpy(), "dim": part["dim"].to_numpy(), "list": own, "probes": model.probes(u, own, reach), "code": [c.tobytes() for c in codes], "err": err, "v": [v.astype("<f8").tobytes() for v in u]})

    coded = stage(reps.select("rep", "w", "label", "dim", "e").mapInPandas(encode, "rep long, w long, label string, dim int, list int, probes array<int>, code binary, err double, v binary"), "coded")
    # lists in order fill cells of CELL vectors; a longer list has several
    sizes = coded.groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("label", "dim").orderBy("list").rowsBetween(W.unboundedPreceding, -1)
    cells = sizes.select("label", "dim", "list", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / CELL).cast("int").alias("cell"), F.ceil(F.col("n") / CELL).cast("int").alias("subs"))
    cells = stage(cells, "cells")
    members = coded.join(cells, ["label", "dim", "list"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    asks = coded.select("rep", "w", "label", "dim", F.col("list").alias("own"), F.explode("probes").alias("list"))
    asks = stage(asks.join(cells, ["label", "dim", "list"]).select("rep", "label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).distinct(), "asks")
    # a cell that very many vectors probe, as when a third of all are alike, meets them in parts
    on = ["label", "dim", "cell", "sub"]
    load = asks.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts"))
    asks = asks.join(load, on).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    members = members.join(load, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    on = [*on, "part"]
    probing = asks.join(coded.select("rep", "label", "dim", "w", "list", "v"), ["rep", "label", "dim"])
    found = members.select(*[F.col(c).alias(f"of_{c}") for c in on], *[F.col(c).alias(c) for c in ("rep", "w", "list", "code", "err", "v")])
    links = probing.groupBy(*on).cogroup(found.groupBy(*[f"of_{c}" for c in on])).applyInPandas(_compare(models, cosine), "vec long, links long, other long")
    links = stage(links, "vector-links")
    counts = links.groupBy("vec").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("vec").alias("a"), F.col("other").alias("b")))
    named = reps.select("rep", "w", "h1", "h2").join(counts.withColumnRenamed("vec", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"), F.lit(True).alias("known"))
    out = rows.select("vec_id", "usable", "h1", "h2").join(named, ["h1", "h2"], "left")
    linked = F.col("usable") & F.col("known")
    cid = F.when(linked, F.col("root")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linked, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, vec_id = c.root AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
