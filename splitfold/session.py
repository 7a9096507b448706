"""Session and tables: configuration goes through Spark's own (builder options or spark-defaults.conf)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def session(app: str = "splitfold", **options: str) -> SparkSession:
    """A session with adaptive execution, ANSI arithmetic and UTC; options win over these."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"} | options
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); a local session without one gets its
    own. Checkpoints go there too."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="splitfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
