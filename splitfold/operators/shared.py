"""Shared objects: replicated state as folds of an update log.

A log has object_id, seq, method and arguments. Folds with a commutative, associative reducer (min, sum, count, last by
seq) are aggregates, which combine before the shuffle and have streaming forms (see splitfold.streaming). Any other
reducer goes over a key's updates in order of seq, row by row with one state at a time, so no key's log is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_min(log: DataFrame, value: str) -> DataFrame:
    """(object_id, state, n_updates): a shared minimum."""
    return log.groupBy("object_id").agg(F.min(value).alias("state"), F.count("*").alias("n_updates"))


def running(log: DataFrame, value: str, key: str, fold: Callable[[Column], Column], pick: Callable[..., Column], span: int = 4096) -> DataFrame:
    """The log with ``state``: the least or greatest value of a key up to each update.

    In two steps, so that no key's log lies in one task: the extreme of each stretch of ``span`` numbers of seq, which
    combines before the shuffle, over stretches before; then the updates inside a stretch. fold and pick are F.min and
    F.least, or F.max and F.greatest.
    """
    rows = log.withColumn("__stretch", F.floor(F.col("seq") / span))
    whole = rows.groupBy(key, "__stretch").agg(fold(F.col(value)).alias("__own"))
    before = fold(F.col("__own")).over(W.partitionBy(key).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1))
    earlier = whole.select(key, "__stretch", before.alias("__before"))
    inside = fold(F.col(value)).over(W.partitionBy(key, "__stretch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("__inside", inside).join(earlier, [key, "__stretch"])
    return found.select(*log.columns, pick("__inside", "__before").alias("state"))


def running_min(log: DataFrame, value: str) -> DataFrame:
    """The log with the minimum after each update."""
    return running(log, value, "object_id", F.min, F.least)


def bounded_rounds(tasks: DataFrame, rounds: int) -> list[tuple[int, int, int | None]]:
    """(round, tasks run, bound after it) when the tasks (round, lower, value) of a round are run only if their lower limit is
    below the least value of all rounds before; one row of each round comes to the driver."""
    bound, out = None, []
    for k in range(rounds):
        ready = tasks.where(F.col("round") == k)
        n, least = ready.where(F.lit(True) if bound is None else F.col("lower") < bound).agg(F.count("*"), F.min("value")).first()
        bound = least if bound is None or (least is not None and least < bound) else bound
        out.append((k, n, bound))
    return out


def fold_cleared(log: DataFrame, value: str, clears: str) -> DataFrame:
    """(object_id, state, n): the sum of the values after the last update of the method that clears; both steps combine before
    the shuffle."""
    last = log.where(F.col("method") == clears).groupBy("object_id").agg(F.max("seq").alias("__cleared"))
    after = F.when(F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared")), F.col(value)).otherwise(0)
    return log.join(last, "object_id", "left").groupBy("object_id").agg(F.sum(after).alias("state"), F.count("*").alias("n"))


def fold_last(log: DataFrame, value: str) -> DataFrame:
    """(object_id, state, seq): the value of the last update."""
    return log.groupBy("object_id").agg(F.max_by(value, "seq").alias("state"), F.max("seq").alias("seq"))


def fold(log: DataFrame, initial: object, write: Callable[[object, pd.Series], object], schema: str, value_of: Callable[[object], tuple]) -> DataFrame:
    """(object_id, ...): the state of each object after all its updates, in order, by any reducer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, initial
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if key is not None and row.object_id != key:
                    done.append((key, *value_of(state)))
                    state = initial
                key = row.object_id
                state = write(state, row)
            if done:
                yield pd.DataFrame(done)
        if key is not None:
            yield pd.DataFrame([(key, *value_of(state))])

    return log.repartition("object_id").sortWithinPartitions("object_id", "seq").mapInPandas(run, schema)


def known_only(log: DataFrame, objects: DataFrame) -> DataFrame:
    """Updates of objects that exist here; others are dropped, and only those."""
    return log.join(objects, "object_id", "left_semi")


def guarded(tasks: DataFrame, states: DataFrame, guard: Column) -> DataFrame:
    """Tasks that may run, as their guard holds on the state of the object that they name."""
    return tasks.join(states, "object_id", "left").where(F.coalesce(guard, F.lit(False)))


def combined_messages(log: DataFrame, size: str, at: str, most_bytes: int, most_delay: int) -> DataFrame:
    """The log with ``message``: updates of an origin are sent together until they hold most_bytes or the first of
    them is most_delay old."""
    schema = log.schema.add("message", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, message, held, since = None, 0, 0, 0
        for batch in batches:
            out = []
            for row in batch[["object_id", size, at]].itertuples(index=False):
                if row[0] != key:
                    key, message, held, since = row[0], 0, 0, row[2]
                elif held >= most_bytes or row[2] - since > most_delay:
                    message, held, since = message + 1, 0, row[2]
                held += row[1]
                out.append(message)
            yield batch.assign(message=out)

    return log.repartition("object_id").sortWithinPartitions("object_id", "seq").mapInPandas(run, schema)
