"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least-neighbours")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternates large and small stars until nothing changes, which takes a number
    of rounds logarithmic in the nodes. Minima are combined before each shuffle
    and settled before they are joined, so a node with very many neighbours can
    be split over tasks; each round is settled, so lost executors cost one round. Loops and repeated edges do no harm.
    """
    edges = settle(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = _mark(edges)
    while True:
        edges = settle(_small_star(_large_star(edges)).distinct(), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first())
