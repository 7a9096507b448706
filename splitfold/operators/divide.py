"""Divide, solve, combine.

``ranges`` and ``task_of`` are the master-worker split by arithmetic on positions, so no row has to be sorted into place.
``split_tree`` and ``fibonacci`` are recursive splits of small problems as recursive queries. ``Problem`` runs any
recursion whose sub-problems are rows: the frontier is divided level by level, leaves are solved where they lie, and
results are combined upwards by a grouped aggregate for each level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.session import scratch

def task_of(pos: Column, n: Column, tasks: int) -> Column:
    """The task of a position in [0, n) when n positions go to ``tasks`` near-equal ranges, longer ones first."""
    base, longer = F.floor(n / tasks), n % tasks
    head = longer * (base + 1)
    return F.when(pos < head, F.floor(pos / (base + 1))).otherwise(longer + F.floor((pos - head) / F.greatest(base, F.lit(1)))).cast("int")


def ranges(spark: SparkSession, n: DataFrame, tasks: int) -> DataFrame:
    """(task, lo, hi): half-open ranges of [0, n); n is a table of one row and one column."""
    size = n.select(F.col(n.columns[0]).alias("n"))
    lo = lambda t: t * F.floor(F.col("n") / tasks) + F.least(t, F.col("n") % tasks)
    task = F.col("task")
    return size.select("n", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")).select("task", lo(task).cast("long").alias("lo"), lo(task + 1).cast("long").alias("hi"))


def first_position(rows: DataFrame, pos: str, value: str, wanted: int) -> DataFrame:
    """(first_pos): the leftmost position of a value, -1 if there is none; the filter reaches the scan."""
    return rows.where(F.col(value) == wanted).agg(F.coalesce(F.min(pos), F.lit(-1)).cast("long").alias("first_pos"))


def split_tree(spark: SparkSession, n: int) -> DataFrame:
    """(lo, hi, depth) of all nodes when [0, n) is halved down to single positions."""
    return spark.sql(
        """WITH RECURSIVE t(lo, hi, depth) AS (
             SELECT 0L, CAST({n} AS BIGINT), 0L
             UNION ALL
             SELECT CASE WHEN side = 0 THEN lo ELSE (lo + hi) div 2 END, CASE WHEN side = 0 THEN (lo + hi) div 2 ELSE hi END, depth + 1
             FROM t CROSS JOIN (SELECT explode(array(0, 1)) AS side) WHERE hi - lo > 1)
           SELECT lo, hi, depth FROM t""",
        n=n,
    )


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """(n, fib) for 0..n, n at most 92 (the last that fits 64 bits)."""
    if not 0 <= n <= 92:
        raise ValueError("fibonacci numbers from 0 to 92 fit 64 bits")
    return spark.sql(
        """WITH RECURSIVE f(n, a, b) AS (SELECT 0L, 0L, 1L UNION ALL SELECT n + 1, b, coalesce(try_add(a, b), 0L) FROM f WHERE n < {n})
           SELECT n, a AS fib FROM f""",
        n=n,
    )


@dataclass
class Problem:
    """A recursion over rows.

    is_leaf: predicate on a task's columns; divide: task columns -> array column of sub-task structs; solve: leaf
    columns -> result column (a column expression or a pandas UDF applied to columns); combine: aggregate over the
    children's column ``result``; guard: leaves for which it is false aren't run and have a null result; empty: the result
    of a task that divides into no (or null) sub-tasks, null by default. Every task has a row in the result.
    """

    is_leaf: Callable[[DataFrame], Column]
    divide: Callable[[DataFrame], Column]
    solve: Callable[[DataFrame], Column]
    combine: Callable[[Column], Column]
    guard: Callable[[DataFrame], Column] | None = None
    empty: Column | None = None
    max_depth: int = 64

    def run(self, tasks: DataFrame) -> DataFrame:
        """The tasks with ``result``. Each level is one stage, and its number of rows is the number of its tasks."""
        columns = tasks.columns
        scratch(tasks.sparkSession)  # checkpoints need a folder
        level = tasks.withColumn("stamp", F.array(F.monotonically_increasing_id())).checkpoint()
        roots, solved = level, None
        for _ in range(self.max_depth):
            value = self.solve(level)
            if self.guard is not None:
                value = F.when(self.guard(level), value)
            leaves = level.where(self.is_leaf(level)).select("stamp", value.alias("result"))
            solved = leaves if solved is None else solved.unionAll(leaves)
            inner = level.where(~self.is_leaf(level))
            if inner.isEmpty():
                break
            divided = inner.select("stamp", self.divide(inner).alias("parts"))
            hollow = divided.where(F.coalesce(F.size("parts"), F.lit(0)) < 1).select("stamp")
            solved = solved.unionAll(hollow.withColumn("result", F.lit(None) if self.empty is None else self.empty))
            parts = divided.select("stamp", F.posexplode("parts").alias("child", "task"))
            level = parts.select("task.*", F.concat("stamp", F.array(F.col("child").cast("long"))).alias("stamp")).select(*columns, "stamp").checkpoint()
        else:
            raise RuntimeError(f"not solved in {self.max_depth} levels")
        solved = solved.checkpoint()
        depth = solved.agg(F.max(F.size("stamp"))).first()[0] or 1
        for d in range(depth, 1, -1):
            below = solved.where(F.size("stamp") == d).select(F.slice("stamp", 1, d - 1).alias("stamp"), "result")
            solved = solved.where(F.size("stamp") < d).unionAll(below.groupBy("stamp").agg(self.combine(F.col("result")).alias("result"))).checkpoint()
        return roots.join(solved, "stamp", "left").drop("stamp")
