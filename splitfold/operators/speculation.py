"""Speculation and abort: the first result wins, the rest is cancelled; errors as values and handlers for them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Found(Exception):
    """A result that ends the search for others."""

    def __init__(self, value: object) -> None:
        super().__init__(value)
        self.value = value


def any_position(rows: DataFrame, pos: str, value: str, wanted: int) -> DataFrame:
    """(pos): any one position of the value; Spark stops reading at the first that it finds."""
    return rows.where(F.col(value) == wanted).select(pos).limit(1)


def first_of(spark: SparkSession, jobs: list[Callable[[], object]], on_error: Callable[[Exception, int], object] | None = None) -> object:
    """The first result that is not None, of jobs that run side by side; the others are cancelled by their job group, with the
    Spark jobs that they would start later.

    An exception of a job goes to on_error(exception, job), whose result counts as the job's; without a handler it is
    raised once no other job has a result. Found gives its value as the result.
    """
    sc, group = spark.sparkContext, f"first-{uuid.uuid4().hex}"
    results: list[tuple[int, object, Exception | None]] = []

    def run(k: int) -> None:
        sc.setJobGroup(f"{group}-{k}", "one of several", interruptOnCancel=True)
        try:
            results.append((k, jobs[k](), None))
        except Found as e:
            results.append((k, e.value, None))
        except Exception as e:  # noqa: BLE001
            results.append((k, None, e))
        if results[-1][1] is not None:
            for other in range(len(jobs)):
                if other != k:
                    sc._jsc.sc().cancelJobGroupAndFutureJobs(f"{group}-{other}")

    threads = [InheritableThread(target=run, args=(k,)) for k in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for _, value, _ in results:
        if value is not None:
            return value
    for k, _, error in results:
        if error is not None:
            if on_error is None:
                raise error
            if (value := on_error(error, k)) is not None:
                return value
    return None


def split_errors(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good results, failed ones) of a table with a nullable error struct."""
    return results.where(F.col(error).isNull()), results.where(F.col(error).isNotNull())


def handled(results: DataFrame, clauses: list[tuple[str, object]], kind: str, value: str) -> DataFrame:
    """The value of the first clause whose kind matches a row's error, in order; rows that none matches keep their error."""
    out = F.col(value)
    for name, replacement in reversed(clauses):
        out = F.when(F.col(kind) == name, F.lit(replacement)).otherwise(out)
    caught = F.col(kind).isin([c[0] for c in clauses])
    return results.withColumn(value, out).withColumn(kind, F.when(~caught, F.col(kind)))
