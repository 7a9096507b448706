"""k-means with fixed-point sums, so that results don't depend on how points are partitioned.

The distances to a few centres (TERMS numbers at most) are plain arithmetic over one column for each coordinate, which
Spark compiles; more centres are a literal array, and more than LITERALS numbers one broadcast row, as plans don't hold so
many literals. These come back from a step as one array of sums for each cluster. One step is one partial and final
aggregation over the clusters; points are never moved, but ``fit`` first merges equal points into one row with their number,
so that a step reads different points only.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.functions.numbers import distance, hundredths, rounded_mean

STOP, MAX_STEPS, LITERALS, TERMS = 0.01, 500, 2000, 64


def literal(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def nearest(point: Column, centres: Column) -> Column:
    """struct(distance, cluster) of the nearest centre; the lowest index wins ties."""
    each = F.transform(centres, lambda c, i: F.struct(distance(c, point).alias("distance"), i.alias("cluster")))
    return F.array_min(each)


def compiled(centres: list[list[float]]) -> bool:
    return len(centres) * len(centres[0]) <= TERMS


def assign_numbers(rows: DataFrame, numbers: list[Column], whole: Column, centres: list[list[float]]) -> DataFrame:
    """``assign`` for points that are a column for each coordinate; a point that isn't whole has no distance and lies in cluster 0."""
    apart = [reduce(operator.add, [(x - c) * (x - c) for x, c in zip(numbers, map(float, centre), strict=True)]) for centre in centres]
    names = [f"__apart{k}" for k in range(len(centres))]
    rows = rows.withColumns({name: F.when(whole, F.sqrt(x)) for name, x in zip(names, apart, strict=True)})
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    first = F.coalesce(*[F.when(F.col(name).eqNullSafe(least), k) for k, name in enumerate(names)])
    return rows.withColumns({"cluster": first, "distance": least}).drop(*names)


def assign(points: DataFrame, centres: list[list[float]], point: str = "point") -> DataFrame:
    """The points with the index of the nearest centre and its distance."""
    dims = len(centres[0])
    if compiled(centres):
        return assign_numbers(points, [F.get(point, F.lit(d)) for d in range(dims)], F.size(point) == dims, centres)
    rows, held = points, literal(centres) if len(centres) * dims <= LITERALS else F.col("__centres")
    if len(centres) * dims > LITERALS:
        one = points.sparkSession.createDataFrame([([[float(x) for x in c] for c in centres],)], "__centres array<array<double>>")
        rows = points.crossJoin(F.broadcast(one))  # one row, as large as the centres
    near = rows.withColumn("near", nearest(F.col(point), held))
    return near.withColumns({"cluster": F.col("near.cluster"), "distance": F.col("near.distance")}).drop("near", "__centres")


def total_distance(points: DataFrame, centres: list[list[float]], point: str = "point") -> DataFrame:
    """(n, distance): the sum of all points' distances to their nearest centre, each rounded to hundredths."""
    return assign(points, centres, point).agg(F.count("*").alias("n"), F.sum(hundredths(F.col("distance"))).alias("distance"))


def means(assigned: DataFrame, numbers: list[Column], weight: Column) -> DataFrame:
    dims = range(len(numbers))
    sums = assigned.groupBy("cluster").agg(F.sum(weight).alias("n"), *[F.sum(hundredths(x) * weight).alias(f"s{d}") for d, x in enumerate(numbers)])
    return sums.select("cluster", "n", F.array(*[rounded_mean(F.col(f"s{d}"), F.col("n")) for d in dims]).alias("centre"))


def step(points: DataFrame, centres: list[list[float]], point: str = "point") -> DataFrame:
    """(cluster, n, centre): new centres, in hundredths, of the clusters that have points."""
    return means(assign(points, centres, point), [F.get(point, F.lit(d)) for d in range(len(centres[0]))], F.lit(1).cast("long"))


def merged(points: DataFrame, dims: int, point: str = "point") -> DataFrame:
    """(x0, x1, ..., whole, n): the different points and how often each occurs."""
    numbers = [F.get(point, F.lit(d)).cast("double").alias(f"x{d}") for d in range(dims)]
    return points.select(*numbers, (F.size(point) == dims).alias("whole")).groupBy(*[f"x{d}" for d in range(dims)], "whole").agg(F.count("*").alias("n"))


def moved(old: list[list[float]], new: dict[int, list[float]]) -> float:
    """How far the centres of clusters with points have moved in all; others stay."""
    return sum(math.dist(old[k], c) for k, c in new.items())


def fit(points: DataFrame, centres: list[list[float]], point: str = "point", max_steps: int = MAX_STEPS) -> tuple[list[list[float]], int]:
    """Centres at rest (total shift below STOP) and the number of steps; a step brings one row for each cluster to the driver."""
    few, numbers = compiled(centres), [F.col(f"x{d}") for d in range(len(centres[0]))]
    points = (merged(points, len(numbers), point) if few else points.select(point)).cache()
    try:
        for k in range(1, max_steps + 1):
            found = means(assign_numbers(points, numbers, F.col("whole"), centres), numbers, F.col("n")) if few else step(points, centres, point)
            new = {r["cluster"]: [x / 100 for x in r["centre"]] for r in found.collect()}
            shift, centres = moved(centres, new), [new.get(i, c) for i, c in enumerate(centres)]
            if shift < STOP:
                return centres, k
        return centres, max_steps
    finally:
        points.unpersist()
