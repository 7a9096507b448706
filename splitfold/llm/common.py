"""What the training-data operators share: scratch tables, the word rule, label folds."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and \t \n \v \f \r, which is also what bytes.split() yields.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NON_SPACE_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session may set its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="splitfold-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    The shuffle files of the query that writes it go as soon as it is written; ``dropped`` removes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/splitfold/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


#: Where the tables of ``written`` lie, as long as somebody holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Removes tables of ``written``, after their last reader has been written itself."""
    for table in tables:
        if path := _paths.pop(table, None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def by_keys(rows: DataFrame, key: str, columns: list[str], body: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, held_rows: int) -> DataFrame:
    """body(table of whole keys, about held_rows rows or one key) over the rows by a long column; a key's rows lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in filter(len, batches):
            held.append(batch)
            change = np.flatnonzero(np.diff(batch.column(0).to_numpy()))
            before = len(held) > 1 and held[-2].column(0)[-1].as_py() != batch.column(0)[0].as_py()
            if sum(map(len, held)) >= held_rows and (len(change) or before):
                cut = int(change[-1]) + 1 if len(change) else 0  # all but the last key are whole
                held[-1] = batch.slice(0, cut)
                yield from body(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
        if held:
            yield from body(pa.Table.from_batches(held))

    # one sort column of whole numbers is sorted by its digits
    return rows.select(key, *columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; rows with 0 are held out from all fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A repeatable pseudorandom number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def bounded_sample(rows: DataFrame, key: str, stratum: str, per_stratum: int, seed: int = 7) -> DataFrame:
    """About per_stratum rows of each stratum at most, chosen by a hash of the key; all rows of smaller strata.

    The strata's counts are an aggregate over all rows; there are as few strata as there are labels or languages.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_stratum / n))])
    return rows.where(uniform(F.col(key), seed=seed) < rate[F.col(stratum)])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression with intercept by Newton's method."""
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b
