"""The driver's tables read as the model's: job tree, nodes, messages, points.

region.nation.customer.order is the job tree; the last part of a path gives a job's owner, stealer, state and flags by
fixed rules, the same in SQL (JOBS). events are messages, results and updates; suppliers are nodes, nations clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.operators.jobs import dotted, parent
from splitfold.session import table

STATES = ["queued", "stolen", "running", "finished"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cn = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ocn = orders.join(cn, F.col("o_custkey") == F.col("c_custkey"))
    levels = [
        table(spark, sf_dir, "region").select(F.array(F.col("r_regionkey").cast("long")).alias("stamp")),
        nation.select(F.array(*[F.col(c).cast("long") for c in ("n_regionkey", "n_nationkey")]).alias("stamp")),
        cn.select(F.array(*[F.col(c).cast("long") for c in ("n_regionkey", "n_nationkey", "c_custkey")]).alias("stamp")),
        ocn.select(F.array(*[F.col(c).cast("long") for c in ("n_regionkey", "n_nationkey", "c_custkey", "o_orderkey")]).alias("stamp")),
    ]
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionAll(more)
    last = F.element_at("stamp", -1)
    rows = rows.withColumns({"k": last, "depth": F.size("stamp").cast("long"), "path": dotted(F.col("stamp")), "parent_path": dotted(parent(F.col("stamp")))})
    state = F.when(F.col("depth") < 4, "running").otherwise(F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("k") % 4 + 1).cast("int")))
    return rows.select(
        "stamp", "path", "parent_path", "depth", state.alias("state"), ((F.col("k") * 7 + F.col("depth")) % 11).alias("owner"),
        ((F.col("k") * 5 + F.col("depth")) % 13).alias("stealer"), ((F.col("k") + F.col("depth")) % 29 == 0).alias("aborted"), (F.col("k") * 4 + F.col("depth")).alias("seq"),
    )


JOBS = """tree AS (
  SELECT [r_regionkey::BIGINT] AS stamp FROM region
  UNION ALL SELECT [n_regionkey::BIGINT, n_nationkey::BIGINT] FROM nation
  UNION ALL SELECT [n_regionkey::BIGINT, n_nationkey::BIGINT, c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT [n_regionkey::BIGINT, n_nationkey::BIGINT, c_custkey, o_orderkey] FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
keyed AS (SELECT stamp, stamp[len(stamp)] AS k, len(stamp)::BIGINT AS depth, array_to_string(stamp, '.') AS path, array_to_string(stamp[1:len(stamp)-1], '.') AS parent_path FROM tree),
jobs AS (SELECT stamp, path, parent_path, depth, CASE WHEN depth < 4 THEN 'running' ELSE ['queued', 'stolen', 'running', 'finished'][k % 4 + 1] END AS state,
  (k * 7 + depth) % 11 AS owner, (k * 5 + depth) % 13 AS stealer, (k + depth) % 29 = 0 AS aborted, k * 4 + depth AS seq FROM keyed)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as writes to a result table: key user_id, sequence event_id, errors as pointers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "POINTER").otherwise("RESULT").alias("kind"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("value"), (F.col("event_id") % 17).alias("owner"), F.col("event_id").alias("seq"),
    )


RESULTS = """results AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'POINTER' ELSE 'RESULT' END AS kind,
  floor(value * 100 + 0.5)::BIGINT AS value, event_id % 17 AS owner, event_id AS seq FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("method"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("value"))


LOG = "log AS (SELECT user_id AS object_id, event_id AS seq, event_type AS method, floor(value * 100 + 0.5)::BIGINT AS value FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("point"))


CENTRES = [[5.0, 5.0], [15.0, 20.0], [25.0, 35.0], [35.0, 50.0], [45.0, 70.0]]
POINTS = """centres(cluster, cx, cy) AS (VALUES (0, 5.0::DOUBLE, 5.0::DOUBLE), (1, 15.0::DOUBLE, 20.0::DOUBLE), (2, 25.0::DOUBLE, 35.0::DOUBLE), (3, 35.0::DOUBLE, 50.0::DOUBLE), (4, 45.0::DOUBLE, 70.0::DOUBLE)),
points AS (SELECT row_number() OVER () AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
near AS (SELECT id, x, y, arg_min(cluster, {'d': sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)), 'c': cluster}) AS cluster FROM points, centres GROUP BY id, x, y),
step AS (SELECT cluster, count(*)::BIGINT AS n, floor(sum(floor(x * 100 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5)::BIGINT AS cx, floor(sum(floor(y * 100 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5)::BIGINT AS cy FROM near GROUP BY cluster)"""


def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as what a supplier's node reports: whole-number counters, and the largest table it had."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("node")).agg(
        F.count("*").alias("steal_attempts"), F.count_if(F.col("l_returnflag") == "A").alias("steal_success"), F.sum(F.col("l_quantity").cast("long")).alias("jobs"), F.max(F.col("l_linenumber").cast("long")).alias("table_max")
    )


NODE_STATS = "node_stats AS (SELECT l_suppkey AS node, count(*)::BIGINT AS steal_attempts, count(*) FILTER (l_returnflag = 'A')::BIGINT AS steal_success, sum(l_quantity::BIGINT)::BIGINT AS jobs, max(l_linenumber)::BIGINT AS table_max FROM lineitem GROUP BY l_suppkey)"
