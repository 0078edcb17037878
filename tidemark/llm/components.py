"""Connected components of a link table by alternating stars, each round stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stage


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of the links (a, b): ``root`` is the least node reachable.

    Nodes may be of any type that orders. Null ends and loops are ignored. Every round hangs the neighbours of a node on
    its least neighbour, first the larger ones, then the smaller ones; the number of rounds grows with the logarithm of
    the longest path. Stars are built with aggregates that combine before the shuffle, never by gathering a node's
    neighbours, and stored before they are joined to the links, so that adaptive execution can split a node with very
    many links. Raises if ``max_rounds`` do not suffice, rather than return a partial answer.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = stage(edges, "links")
    before = None
    for _ in range(max_rounds):
        edges = stage(_small_star(_large_star(edges)), "links")
        # The links are a set of (node, lower node); when both stars leave it alone its sum does not change.
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node that has a lower one: (a, m)."""
    return stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of each node on the least of it and its neighbours."""
    least = _least(edges)
    # Seen from b, a is a larger neighbour; b's least neighbour is below b, or b itself is the least.
    return (
        edges.join(least.withColumnRenamed("a", "b"), "b", "left")
        .select("a", F.coalesce("m", "b").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the least of those."""
    least = _least(edges)
    return (
        edges.join(least, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )
