"""Crawl frontier and route evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.scratch import written


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of everything reachable within ``max_depth`` steps, each node at its least depth.

    One join a level, whose new nodes are written, so that a level's plan holds no earlier one; nodes already visited
    are left out by an anti-join. It ends early where nothing new is reached.
    """
    edges = written(edges.select("src", "dst"), "edges")
    visited = frontier = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def run_metrics(evidence: DataFrame) -> DataFrame:
    """Per run: rows, bytes and a histogram of statuses as text, sorted by status."""
    by_status = evidence.groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return by_status.groupBy("run").agg(
        F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda s: F.concat_ws("=", s["status"], s["n"])), ",").alias("statuses"),
    )


def distinct_routes(evidence: DataFrame) -> DataFrame:
    return evidence.select("route").filter("route is not null").distinct().orderBy("route")


def filter_algebra(declared: str, observed: str, unsupported: str) -> list:
    """Filters missing from the observed, observed beyond the declared, and declared as unsupported yet observed."""
    d, o, u = F.col(declared), F.col(observed), F.col(unsupported)
    return [F.array_sort(F.array_except(d, o)).alias("missing"), F.array_sort(F.array_except(o, d)).alias("undeclared"), F.array_sort(F.array_intersect(o, u)).alias("contradicted")]


def request_cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key, the digest of method, URL, query and body, is not cached."""
    key = F.sha2(F.concat_ws("\n", "method", "url", F.coalesce("query", F.lit("")), F.coalesce("body", F.lit(""))), 256)
    return requests.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def node_similarity(a: str, b: str):
    """Similarity of two element signatures: tag .25, id .25, classes .25, attributes .15, parent .05, length .05."""
    x, y = F.col(a), F.col(b)
    jaccard = lambda p, q: F.when(F.size(F.array_union(p, q)) == 0, 1.0).otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
    close = F.abs(x["length"] - y["length"]) <= F.greatest(F.lit(20.0), 0.2 * F.greatest(x["length"], y["length"]))
    same = lambda k: x[k].eqNullSafe(y[k]).cast("double")
    return F.round(0.25 * same("tag") + 0.25 * same("id") + 0.25 * jaccard(x["classes"], y["classes"]) + 0.15 * jaccard(x["attrs"], y["attrs"]) + 0.05 * same("parent") + 0.05 * close.cast("double"), 6)


def top_similar(nodes: DataFrame, target: str, k: int = 10, threshold: float = 0.65) -> DataFrame:
    """The ``k`` most similar nodes to the one signature ``target``, per document."""
    scored = nodes.withColumn("similarity", node_similarity("signature", target)).filter(F.col("similarity") >= threshold)
    window = Window.partitionBy("doc").orderBy(F.desc("similarity"), F.col("signature.length"), "depth", "position")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
