"""Connected components of an undirected graph given as links."""

from pyspark.sql import functions as F

from parleyframe.sources.tables import settle


def _stars(links, keep):
    """Every node's neighbours are linked to the smallest of them and itself.

    The smallest is a partial aggregate and is joined back, so that a node with
    many neighbours is never gathered.
    """
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return ends.join(smallest, "a").where(keep).select(
        F.col("b").alias("a"), F.col("low").alias("b")), smallest


def components(links, name="links"):
    """(node, root): the smallest node reachable, for all nodes that have links.

    ``links`` (a, b) are turned into stars around ever smaller nodes (large and
    small stars in turn) until nothing changes; the number of turns grows with
    the logarithm of the nodes.  Each turn's links are settled.
    """
    links = settle(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        large, _ = _stars(links, F.col("b") > F.col("a"))
        down = large.where("a <> b").distinct()
        # Small stars: only links to smaller nodes, and the node itself.
        lower = down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = lower.groupBy("a").agg(F.min("b").alias("low"))
        small = lower.join(smallest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = settle(
            small.unionByName(smallest.select("a", F.col("low").alias("b")))
            .where("a <> b").distinct(), name)
        now = tuple(links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
