"""Text vectors, random arrays and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_vector(line: Column) -> Column:
    """Numbers separated by single spaces."""
    return F.transform(F.split(line, " "), lambda x: x.cast("double"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(point): one row for each line of a file or of all files of a folder, in no order."""
    return spark.read.text(path).where(F.length("value") > 0).select(parse_vector(F.col("value")).alias("point"))


def read_centres(spark: SparkSession, file: str, limit: int = 100_000) -> list[list[float]]:
    """The centres in line order; at most limit of them, as every task gets them all."""
    rows = spark.read.option("wholetext", True).text(file).select(F.posexplode(F.split("value", "\n"))).where(F.length("col") > 0)
    found = rows.orderBy("pos").select(parse_vector(F.col("col"))).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{file} has more than {limit} centres")
    return [list(r[0]) for r in found]


def write_vectors(vectors: DataFrame, column: str, path: str) -> None:
    """One line for each vector, in the form that read_points reads."""
    vectors.select(F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def random_array(spark: SparkSession, n: int = 2_000_000, bound: int = 1_000_000, seed: int = 0) -> DataFrame:
    """(pos, value): n whole numbers in [0, bound), the same for the same seed however they are partitioned; two rounds of a
    congruential generator, which any engine's whole-number arithmetic repeats."""
    first = ((F.col("id") % (1 << 31) + seed) * 1103515245 + 12345) % (1 << 31)
    second = (F.floor(first / 8) * 48271 + first % 8) % 2147483647
    return spark.range(n).select(F.col("id").alias("pos"), (second % bound).alias("value"))
