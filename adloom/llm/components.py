"""Connected components of an edge table by alternating stars; all state stays in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import written


def _towards_least(edges: DataFrame) -> DataFrame:
    """least(a): the least of a and its neighbours b. Written, so that the join that follows may split a node with many edges."""
    return written(edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any order -> (a, b) with b the least node of a's component, for every node a that is not the least.

    Each round joins neighbours above a node to its least neighbour, then those below it. A round adds no edge but
    repeated ones, which go; the number of rounds grows with the logarithm of the longest path. Links of a node to itself
    and null ends are ignored.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            return edges
        before = (n, mark)
        both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.join(_towards_least(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.where("a != b").distinct())
        small = large.join(_towards_least(large), "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a != b").distinct())
