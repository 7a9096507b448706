"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import dropped, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.expr("try_sum(pmod(xxhash64(v, u), 1000003))")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge to another.

    A large star links each node's larger neighbours to its least neighbour, a small star its smaller ones; each step
    keeps the components, and in the order of log^2 steps every component is a star around its least id. No node's
    neighbours are gathered: the least one is a partial aggregate, and it goes back to the edges by a join whose large
    partitions Spark splits, as both sides are read from written tables.
    """
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    mark = None
    while mark != (mark := _mark(e)):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        dropped(before, least, large, lowest)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
