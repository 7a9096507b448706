"""Update logs as streams: each micro-batch is a safe point at which all updates that have arrived are applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def state_of(log: DataFrame, value: str) -> DataFrame:
    """(object_id, least, n_updates, last): the state store keeps one row for each object."""
    return log.groupBy("object_id").agg(F.min(value).alias("least"), F.count("*").alias("n_updates"), F.max_by(value, "seq").alias("last"))


def apply_updates(log: DataFrame, value: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``state_of`` and gives each micro-batch's changed objects to the sink. Without ``every`` it ends with the log."""
    writer = state_of(log, value).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def runnable(tasks: DataFrame, states: DataFrame, guard: str) -> DataFrame:
    """A stream of tasks joined to the states as of now; tasks whose guard holds."""
    return tasks.join(states, "object_id").where(F.expr(guard))


def abort_requests(requests: DataFrame, jobs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """At each safe point, the jobs that the requests which arrived since the last one name (column path)."""

    def at_safe_point(batch: DataFrame, number: int) -> None:
        sink(jobs.join(batch.select("path").distinct(), "path", "left_semi"), number)

    return requests.writeStream.foreachBatch(at_safe_point).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
