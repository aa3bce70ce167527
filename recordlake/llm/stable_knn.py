"""Nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected to ``DIMS`` dimensions with a seeded Gaussian (2-stable) matrix, so that
the squared projected distance over the squared true one is chi-square with ``DIMS`` degrees of
freedom. Rows are dealt by hash to shards of bounded size; each shard indexes its projections in a
kd-tree. Queries come in blocks of bounded size; a block meets every shard. Per query the tree's
leaves are opened in order of projected distance, their vectors verified by cosine in double
precision, and the search stops once the chi-square test says that a closer vector would have been
met with probability ``confidence``.

Vectors that are null, zero, or hold null or non-finite components take no part, as query or
candidate, nor do those of another length than ``width``. Ties go to the smaller id; a query's own
id is left out, with all rows that have it. Rows with equal ids are otherwise separate candidates. Equal
rows ask once; of unlike queries under one id each gets its ranks. With fewer candidates than ``k``
all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMS = 8
LEAF = 64
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1.0
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class KdTree:
    """Balanced tree over projected points, kept as its leaves' members and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, todo = [], [np.arange(len(points))] if len(points) else []
        while todo:
            members = todo.pop()
            if len(members) <= leaf:
                parts.append(members)
                continue
            spread = points[members]
            axis = int(np.argmax(spread.max(0) - spread.min(0)))
            order = np.argpartition(spread[:, axis], len(members) // 2)
            todo += [members[order[len(members) // 2 :]], members[order[: len(members) // 2]]]
        self.leaves = parts
        self.low = np.array([points[m].min(0) for m in parts]).reshape(len(parts), -1)
        self.high = np.array([points[m].max(0) for m in parts]).reshape(len(parts), -1)

    def distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def cosine(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    return (vectors * query).sum(axis=1) / (norms * norm)


def search_shard(tree: KdTree, points: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query_id: int, query: np.ndarray, norm: float, place: np.ndarray, k: int, bound: float) -> list[tuple[float, int]]:
    """The ``k`` best (score, id) of one shard found before the stopping test holds."""
    gaps = tree.distances(place)
    scores, found, worst = np.zeros(0), np.zeros(0, np.int64), math.inf
    order = np.argsort(gaps, kind="stable")
    at, step = 0, 4
    while at < len(order) and gaps[order[at]] <= bound * worst:
        members = np.concatenate([tree.leaves[j] for j in order[at : at + step]])
        at += step
        near = ((points[members] - place) ** 2).sum(1) <= bound * worst if worst < math.inf else slice(None)
        members = members[near]
        members = members[ids[members] != query_id]
        if len(members) == 0:
            continue
        scores = np.concatenate([scores, cosine(vectors[members], norms[members], query, norm)])
        found = np.concatenate([found, ids[members]])
        best = np.lexsort((found, -scores))[:k]
        scores, found = scores[best], found[best]
        if len(found) == k:
            worst = max(0.0, 2 - 2 * scores[-1]) + 1e-12
    return list(zip(scores.tolist(), found.tolist(), strict=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def _pair(width: int, k: int, bound: float, dims: int, seed: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            ids = np.asarray(left["id"].combine_chunks(), dtype=np.int64)
            vectors = _matrix(left["vector"], width)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            to = projection(width, dims, seed)
            points = (vectors / norms[:, None]) @ to
            tree = KdTree(points)
            queries = _matrix(right["vector"], width)
            lengths = np.sqrt((queries * queries).sum(axis=1))
            for q, mark, query, norm in zip(right["id"].to_pylist(), right["mark"].to_pylist(), queries, lengths, strict=True):
                for value, other in search_shard(tree, points, ids, vectors, norms, q, query, norm, (query / norm) @ to, k, bound):
                    out[0].append(q)
                    out[1].append(other)
                    out[2].append(value)
                    out[3].append(mark)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "mark": pa.array(out[3], pa.int64())})

    return run


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(key).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", confidence: float = 0.9, dims: int = DIMS, seed: int = 11, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each row with ``is_query``."""
    schema = "query_id long, rank int, vec_id long, score double"
    clean = usable(df, key, vector)
    row = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if row is None:
        return df.sparkSession.createDataFrame([], schema)
    width, rows = row["n"], row["count"]
    clean = clean.filter(F.size("vector") == width)
    asked = usable(df.filter(is_query), key, vector).filter(F.size("vector") == width).withColumn("mark", F.xxhash64("id", "vector")).dropDuplicates(["id", "mark"])
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked.count() // block_queries))
    mark = F.xxhash64("id", F.lit(seed))
    left = clean.withColumn("shard", F.pmod(mark, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(mark, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _pair(width, k, chi_square_quantile(confidence, dims), dims, seed), "query_id long, vec_id long, score double, mark long"
    )
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
