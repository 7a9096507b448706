"""Arithmetic that gives the same result in any order of evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(x: Column) -> Column:
    """x in whole hundredths, halves rounded up: sums of these are exact and need no order."""
    return F.floor(x * 100 + F.lit(0.5)).cast("long")


def fixed_sum(x: Column) -> Column:
    return F.sum(hundredths(x))


def rounded_mean(total: Column, n: Column) -> Column:
    """The mean in hundredths of a sum in hundredths, rounded like ``hundredths``."""
    return F.floor(total / n + F.lit(0.5)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns of the same length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x))


def back_off(fails: Column, peers: Column) -> Column:
    """Milliseconds to wait: 2^(fails / peers), at most 256."""
    return F.least(F.pow(F.lit(2.0), F.least(F.floor(fails / peers), F.lit(60))), F.lit(256.0)).cast("long")


def need_more_jobs(queued: Column, nodes: Column, most: int = 1000) -> Column:
    """Whether the queue holds at most ``most`` whole jobs for each of several nodes."""
    return (nodes > 1) & (F.floor(queued / nodes) <= most)
