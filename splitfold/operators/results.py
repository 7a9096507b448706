"""A table of results by key, and its checkpoints.

results: path, kind (RESULT or POINTER), value, owner, seq. Upserts keep the row with the greatest seq by one
aggregation (max_by), which combines before the shuffle; a key written by very many sources is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.operators.jobs import prefixes

RESULT, POINTER = "RESULT", "POINTER"


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by seq; seq has no ties within a key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def merge(ours: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Both tables; where both have a key the incoming row wins."""
    rows = ours.withColumn("__source", F.lit(0)).unionByName(incoming.withColumn("__source", F.lit(1)))
    rest = [c for c in ours.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__source", seq)).alias("r")).select(key, "r.*").select(*ours.columns)


def lookup(keys: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """keys with their results; keys without one have nulls."""
    return keys.join(results, key, "left")


def export(results: DataFrame, me: int) -> DataFrame:
    """Results as pointers to this node; pointers as they are."""
    own = F.col("kind") == RESULT
    return results.withColumns({"owner": F.when(own, F.lit(me)).otherwise(F.col("owner")), "value": F.when(~own, F.col("value")), "kind": F.lit(POINTER)})


def dereference(results: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Pointers of live owners with the owner's value; pointers to the dead give none."""
    pointers = results.where(F.col("kind") == POINTER).join(dead, "owner", "left_anti")
    values = results.where(F.col("kind") == RESULT).select(key, "owner", F.col("value").alias("found"))
    return pointers.join(values, [key, "owner"], "left")


class Checkpoints:
    """An append-only Parquet folder of (path, stamp, value, sender, seq), in generations.

    Rows are appended to the current generation, which is the highest one whose folder has Spark's mark of a finished
    write. ``compress`` writes the next one; the mark, which Spark puts there last, is what makes it current. So whenever it
    stops, the one or the other is whole: an unfinished next generation is ignored and written anew, and older ones that
    were left over go with the next ``compress``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, generation: int, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log-{generation}{name}")

    def _files(self):
        return self._path(0).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def generations(self) -> list[int]:
        """The finished ones, oldest first."""
        top = self._path(0).getParent()
        names = [f.getPath().getName() for f in self._files().listStatus(top)] if self._files().exists(top) else []
        found = [int(n[4:]) for n in names if n.startswith("log-") and n[4:].isdigit()]
        return sorted(n for n in found if self._files().exists(self._path(n, "/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.generations())

    def _current(self) -> str:
        return f"{self.folder}/log-{max(self.generations(), default=0)}"

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._current())

    def read(self, senders: list[int] | None = None) -> DataFrame:
        """All rows, or those of some senders; files that can't be read are left out, what came before them stays."""
        rows = self.spark.read.option("ignoreCorruptFiles", "true").parquet(self._current())
        return rows if senders is None else rows.where(F.col("sender").isin(senders))

    def take(self, finished: DataFrame) -> None:
        """Appends the finished jobs that no checkpoint has yet."""
        known = self.read().select("path") if self.exists() else None
        self.append(finished if known is None else finished.join(known, "path", "left_anti"))

    def compress(self) -> None:
        """Rewrites the log with ``compacted`` as the next generation."""
        old = self.generations()
        compacted(self.read()).write.mode("overwrite").parquet(f"{self.folder}/log-{max(old) + 1}")
        for generation in old:
            self._files().delete(self._path(generation), True)

    def resume(self, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(jobs with their earlier result, jobs that remain)."""
        known = upsert(self.read().select("path", "value", "seq"), "path", "seq")
        return jobs.join(known.select("path", "value"), "path"), jobs.join(known, "path", "left_anti")


def compacted(rows: DataFrame) -> DataFrame:
    """Of each key its last row, and only keys without an ancestor in the table."""
    last = upsert(rows, "path", "seq")
    keys = last.select(F.col("path").alias("ancestor"))
    covered = last.select("path", F.explode(prefixes(F.col("stamp"), with_self=False)).alias("ancestor")).join(keys, "ancestor", "left_semi")
    return last.join(covered.select("path").distinct(), "path", "left_anti")
