"""Connected components of a graph given as edges, by alternating large and small stars.

Every round rewrites the edges so that nodes point to smaller nodes: first each
node's larger neighbours are tied to its smallest neighbour, then its smaller ones.
The rounds end when the edges stop changing, after about log2(longest chain) rounds.
A round is grouped minima with map-side combine, and joins of edges with the minimum of one end. A node that
has more than one in ``HUBS`` of all edges is joined by broadcast, so its edges stay where they are; there are
fewer than ``HUBS`` such nodes whatever the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.store import removed, written

HUBS = 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Rows with a null end and loops link nothing; a node that only has such rows is
    not returned. Repeated edges are harmless. No edges give no rows.
    """
    spark = edges.sparkSession
    links, path = written(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _joined(both.filter("v > u"), low, 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, middle = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _joined(large, least, large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        fresh, after = written(small.select("e.*").filter("u <> v").distinct(), "links")
        removed(spark, path, middle)
        links, path, before, mark = fresh, after, mark, _mark(fresh)
        if mark == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _joined(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with the minimum ``m`` of u from ``least`` (u, m, n), whose counts ``n`` add up to ``total``."""
    hub = F.col("n") * HUBS > total
    marked = edges.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("_hub"))), "u", "left")
    rest = marked.filter("_hub IS NULL").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return marked.filter("_hub IS NOT NULL").select("u", "v", F.col("_hub").alias("m")).unionByName(rest.select("u", "v", "m"))


def _mark(links: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges: equal marks mean that a round changed nothing."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
