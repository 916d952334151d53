"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from markloom.llm.common import land


def _told(df: DataFrame, name: str, fact: Column) -> tuple[DataFrame, bool]:
    """A landed frame and whether ``fact``, an aggregate of its rows, holds: seen as they are written, without another job."""
    seen = Observation()
    landed = land(df.observe(seen, fact.alias("fact")), name)
    return landed, bool(seen.get["fact"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    In each round every node takes its smallest neighbour, if that is smaller than itself, and follows these choices to
    their end; the edges are then drawn between the ends, and those that became loops or repeat others go. Each node that
    an edge still has afterwards stands for two or more, so rounds grow with the logarithm of the largest component and an
    edge is joined again only while it is open. Every round is a table in the shared folder. Null ends and loops on one node
    are ignored; no edges: no rows.
    """
    drawn = lambda df, x, y: df.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).distinct()
    some = F.count(F.lit(1)) > 0
    (left, more), rounds = _told(drawn(edges.where(F.col(a) != F.col(b)), a, b), "edges", some), []
    if not more:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    while more:
        both = left.union(left.select(F.col("dst"), F.col("src")))
        labels = land(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
        moved = True
        while moved:
            onward = labels.select(F.col("node").alias("component"), F.col("component").alias("onward"))
            onward = labels.join(onward, "component").select("node", F.col("onward").alias("component"), (F.col("onward") < F.col("component")).alias("moved"))
            labels, moved = _told(onward, "labels", F.max("moved"))
        rounds.append(labels.drop("moved"))
        end = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))  # noqa: B023, E731
        left, more = _told(drawn(left.join(end("src"), "src").join(end("dst"), "dst").where("of_src != of_dst"), "of_src", "of_dst"), "edges", some)
    out = rounds.pop()
    while rounds:
        low = out.select(F.col("node").alias("component"), F.col("component").alias("low"))
        out = land(rounds.pop().join(low, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
    return out
