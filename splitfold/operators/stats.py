"""Statistics of nodes: merging, totals, averages, ratios and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.functions.numbers import ratio


def merged(node_stats: DataFrame, sums: list[str], maxima: list[str]) -> DataFrame:
    """One row: every counter summed over nodes; of a maximum both the sum and the greatest."""
    return node_stats.agg(*[F.sum(c).alias(c) for c in sums], *[F.sum(c).alias(f"{c}_sum") for c in maxima], *[F.max(c).alias(f"{c}_max") for c in maxima])


def per_machine(totals: DataFrame, times: list[str], nodes: int, wall: str) -> DataFrame:
    """Averages of times over machines, their share of the wall time, the overhead and what is left for the application."""
    average = {f"{c}_avg": F.col(c) / nodes for c in times}
    out = totals.withColumns(average)
    out = out.withColumn("overhead", sum((F.col(f"{c}_avg") for c in times), F.lit(0.0)))
    shares = {f"{c}_pct": 100 * ratio(F.col(f"{c}_avg"), F.col(wall)) for c in times}
    return out.withColumns(shares).withColumn("application", F.greatest(F.lit(0.0), F.col(wall) - F.col("overhead")))


def traffic(messages: DataFrame, src: str, dst: str, size: str) -> DataFrame:
    """(intra, messages, bytes): messages inside a cluster and between clusters."""
    return messages.groupBy((F.col(src) == F.col(dst)).alias("intra")).agg(F.count("*").alias("messages"), F.sum(size).alias("bytes"))


def fastest(reports: DataFrame, node: str, time: str, arrival: str, peers: int) -> DataFrame:
    """(node, reports): the node with the least time, the first to report among equals; null until half the peers have."""
    best = reports.agg(F.min_by(node, F.struct(time, arrival)).alias("best"), F.count("*").alias("reports"))
    return best.select(F.when(F.col("reports") >= peers // 2, F.col("best")).alias("node"), "reports")


def clusters(nodes: DataFrame, cluster: str) -> DataFrame:
    return nodes.groupBy(cluster).agg(F.count("*").alias("nodes"))


def victim(nodes: DataFrame, node: str, thief: int, seed: int, cluster: str | None = None, own: int | None = None, local: bool | None = None) -> DataFrame:
    """(node): a peer drawn by a hash of the seed: of all, of the own cluster (local) or of the others (not local)."""
    peers = nodes.where(F.col(node) != thief)
    if local is not None:
        peers = peers.where((F.col(cluster) == own) == F.lit(local))
    return peers.agg(F.min_by(node, F.struct(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(node).cast("string")).cast("binary")), node)).alias("node"))
