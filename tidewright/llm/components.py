"""Connected components of a graph of links, distributed: alternating large and small stars until the edges stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, t: Scratch | None = None, name: str = "links", max_rounds: int = 60) -> DataFrame:
    """From links (a, b): one row (node, root) per linked node, root the least node reachable.

    Nodes of any degree are dealt out by the join on written tables, which Spark can split; the rounds grow with the
    logarithm of the component size. Links may repeat or join a node with itself; without links there are no rows. Each
    round drops the tables of the one before; the last table stays in ``t`` as ``name``.
    """
    t = t or Scratch()
    edges = t.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name} 0")
    before, now = None, _mark(edges)
    rounds = 0
    while now != before:
        if rounds == max_rounds:
            raise RuntimeError(f"components: not settled after {max_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = t.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name} least {rounds}")
        large = t.write(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name} large {rounds}")
        small = t.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name} small {rounds}")
        joined = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.withColumnRenamed("m", "b"))
        edges = t.write(joined.distinct(), f"{name} {rounds}")
        before, now = now, _mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
