"""A table of jobs with hierarchical keys.

A job's key (stamp) is the path from the root, an array of whole numbers; ``path`` is the same with dots. An ancestor is
a prefix. Ancestor joins explode the at most ``depth`` prefixes of each key and join on equality, so they hash and
split like any other join; no prefix is compared in a nested loop.

jobs: stamp, path, parent_path, owner, stealer, state (queued, stolen, running, finished), aborted, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUEUED, STOLEN, RUNNING, FINISHED = "queued", "stolen", "running", "finished"


def dotted(stamp: Column) -> Column:
    return F.array_join(F.transform(stamp, lambda x: x.cast("string")), ".")


def parent(stamp: Column) -> Column:
    """The parent's stamp; of a root it is empty."""
    return F.slice(stamp, F.lit(1), F.size(stamp) - 1)


def is_descendant(stamp: Column, of: Column) -> Column:
    """Whether ``of`` is a prefix, itself included; everything descends from null."""
    return F.when(of.isNull(), True).otherwise(F.slice(stamp, F.lit(1), F.size(of)) == of)


def stamp_hash(stamp: Column) -> Column:
    """h = 16 h + part in 32-bit arithmetic."""
    return F.aggregate(stamp, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 16 + x, F.lit(1 << 32))).cast("long")


def children_stamps(parents: DataFrame, children: DataFrame, parent_id: str, order: list[str]) -> DataFrame:
    """children with ``stamp``: the parent's stamp and the child's number among its siblings, from 0."""
    number = F.row_number().over(W.partitionBy(parent_id).orderBy(*order)) - 1
    return children.withColumn("nth", number.cast("long")).join(parents.select(parent_id, F.col("stamp").alias("p")), parent_id).withColumn("stamp", F.concat("p", F.array("nth"))).drop("p", "nth")


def prefixes(stamp: Column, with_self: bool = True) -> Column:
    """Dotted paths of a stamp's ancestors, shortest first."""
    last = F.size(stamp) if with_self else F.size(stamp) - 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda n: dotted(F.slice(stamp, F.lit(1), n)))).otherwise(F.expr("cast(array() as array<string>)"))


def below(jobs: DataFrame, roots: DataFrame, with_self: bool = True) -> DataFrame:
    """The jobs under any of the roots (column path), each once; paths are unique."""
    up = jobs.withColumn("ancestor", F.explode(prefixes(F.col("stamp"), with_self)))
    return up.join(roots.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").dropDuplicates(["path"]).select(*jobs.columns)


def marked(jobs: DataFrame, root: Column, with_self: bool = True) -> DataFrame:
    """All jobs with ``hit``: whether they are under any job for which root holds.

    The table is read twice, for the jobs and for the roots. A job goes to each of its prefixes once, and its marks come
    back by one aggregate that carries the row; paths are unique.
    """
    roots = jobs.where(root).select(F.col("path").alias("ancestor"), F.lit(True).alias("hit"))
    up = jobs.withColumn("ancestor", F.explode_outer(prefixes(F.col("stamp"), with_self))).join(roots, "ancestor", "left")
    rest = [c for c in jobs.columns if c != "path"]
    found = up.groupBy("path").agg(*[F.first(c).alias(c) for c in rest], F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    return found.select(*jobs.columns, "hit")


def kill_children(jobs: DataFrame, root: Column) -> DataFrame:
    """Jobs whose parent is under a job for which root holds, or under an aborted one, become aborted; wherever they are."""
    out = marked(jobs, root | F.col("aborted"), with_self=False)
    return out.withColumn("aborted", F.col("aborted") | F.col("hit")).drop("hit")


def kill_owner(jobs: DataFrame, owner: int) -> DataFrame:
    """Jobs of an owner that is gone, and all below them, become aborted."""
    out = marked(jobs, F.col("owner") == owner)
    return out.withColumn("aborted", F.col("aborted") | F.col("hit")).drop("hit")


def kill_outstanding(jobs: DataFrame) -> DataFrame:
    """All jobs that haven't finished become aborted."""
    return jobs.withColumn("aborted", F.col("aborted") | (F.col("state") != FINISHED))


def redo_stolen(jobs: DataFrame, stealer: int) -> DataFrame:
    """Jobs that a lost node had stolen go back to the end of the queue."""
    lost = (F.col("state") == STOLEN) & (F.col("stealer") == stealer)
    cleared = jobs.withColumns({"redone": lost, "state": F.when(lost, QUEUED).otherwise(F.col("state")), "stealer": F.when(~lost, F.col("stealer"))})
    return cleared.withColumn("requeued", lost.cast("int"))


def finished_children(jobs: DataFrame) -> DataFrame:
    """Finished jobs whose parent is running."""
    running = jobs.where(F.col("state") == RUNNING).select(F.col("path").alias("parent_path"))
    return jobs.where(F.col("state") == FINISHED).join(running, "parent_path", "left_semi")


def outstanding(jobs: DataFrame) -> DataFrame:
    """(parent_path, n): children that haven't finished."""
    return jobs.where(F.col("state") != FINISHED).groupBy("parent_path").agg(F.count("*").alias("n"))


def from_head(jobs: DataFrame, k: int) -> DataFrame:
    """The k jobs queued last, which their owner takes first."""
    return jobs.where(F.col("state") == QUEUED).orderBy(F.desc("seq"), "path").limit(k)


def from_tail(jobs: DataFrame, k: int) -> DataFrame:
    """The k jobs queued first, which others steal first."""
    return jobs.where(F.col("state") == QUEUED).orderBy("seq", "path").limit(k)


def without(rows: DataFrame, gone: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(gone, on, "left_anti")


def among(rows: DataFrame, chosen: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(chosen, on, "left_semi")
