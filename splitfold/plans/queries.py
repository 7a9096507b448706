"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.functions import numbers
from splitfold.operators import divide, jobs, kmeans, results, shared, speculation, stats
from splitfold.plans import model
from splitfold.plans.model import JOBS, LOG, NODE_STATS, POINTS, RESULTS
from splitfold.session import scratch, table
from splitfold.sources.vectors import random_array, read_centres, read_points, write_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
JOB_COLUMNS = ["path", "state", "owner", "aborted"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# divide, solve, combine


@query("SELECT coalesce(min(event_id), -1)::BIGINT AS first_pos FROM events WHERE user_id = 42")
def search_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide.first_position(table(spark, sf_dir, "events"), "event_id", "user_id", 42)


@query("""WITH e AS (SELECT event_id, user_id, ntile(7) OVER (ORDER BY event_id) - 1 AS task FROM events)
SELECT task::INT AS task, min(event_id)::BIGINT AS lo, max(event_id)::BIGINT + 1 AS hi, coalesce(min(event_id) FILTER (user_id = 42), -1)::BIGINT AS first_pos FROM e GROUP BY task""")
def search_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    task = divide.task_of(F.col("event_id"), F.col("n"), 7)
    hit = F.min(F.when(F.col("user_id") == 42, F.col("event_id")))
    return e.crossJoin(n).groupBy(task.alias("task")).agg(F.min("event_id").alias("lo"), (F.max("event_id") + 1).alias("hi"), F.coalesce(hit, F.lit(-1)).cast("long").alias("first_pos"))


@query("""WITH e AS (SELECT event_id, ntile(7) OVER (ORDER BY event_id) - 1 AS task FROM events)
SELECT task::INT AS task, min(event_id)::BIGINT AS lo, max(event_id)::BIGINT + 1 AS hi FROM e GROUP BY task""")
def task_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide.ranges(spark, table(spark, sf_dir, "events").agg(F.count("*").alias("n")), 7)


@query("""WITH RECURSIVE t(lo, hi, depth) AS (SELECT 0::BIGINT, 1024::BIGINT, 0::BIGINT UNION ALL
SELECT CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN s = 0 THEN (lo + hi) // 2 ELSE hi END, depth + 1 FROM t, (VALUES (0), (1)) v(s) WHERE hi - lo > 1)
SELECT depth, count(*)::BIGINT AS nodes, min(hi - lo)::BIGINT AS least, max(hi - lo)::BIGINT AS most FROM t GROUP BY depth""")
def search_recursive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = divide.split_tree(spark, 1024)
    return t.groupBy("depth").agg(F.count("*").alias("nodes"), F.min(F.col("hi") - F.col("lo")).alias("least"), F.max(F.col("hi") - F.col("lo")).alias("most"))


@query("""WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 32) SELECT n, a AS fib FROM f""")
def fib_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide.fibonacci(spark, 32)


@query("SELECT sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS total, count(*)::BIGINT AS n FROM lineitem")
def dc_sum_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(numbers.fixed_sum(F.col("l_extendedprice")).alias("total"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT range AS pos, ((range % 2147483648) * 1103515245 + 12345) % 2147483648 AS first FROM range(2000000)),
b AS (SELECT pos, ((first // 8) * 48271 + first % 8) % 2147483647 % 1000000 AS value FROM a)
SELECT value // 10000 AS part, count(*)::BIGINT AS n, sum(value)::BIGINT AS total, min(pos)::BIGINT AS first_pos, max(value)::BIGINT AS most FROM b GROUP BY 1""")
def random_array_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = random_array(spark)
    return a.groupBy(F.floor(F.col("value") / 10000).alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("pos").alias("first_pos"), F.max("value").alias("most"))


@query("""WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 12) SELECT n, a AS result FROM f""")
def problem_fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unequal sub-problems at each level, solved as rows."""
    one = lambda k: F.struct((F.col("n") - k).alias("n"))
    problem = divide.Problem(lambda t: t["n"] < 2, lambda t: F.array(one(1), one(2)), lambda t: t["n"], F.sum)
    return problem.run(spark.range(13).select(F.col("id").alias("n")))


@query("""SELECT k AS task, CASE WHEN k = 3 THEN -1 ELSE (SELECT coalesce(min(event_id), -1) FROM events WHERE user_id = k) END::BIGINT AS first_pos FROM (SELECT range AS k FROM range(5))""")
def problem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (wanted value) are halved into ranges of positions, a leaf finds its first position, task 3 has nothing to divide."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = events.agg((F.max("event_id") + 1).alias("n"))
    tasks = spark.range(5).select(F.col("id").alias("task"), F.lit(0).cast("long").alias("lo")).crossJoin(F.broadcast(n)).withColumnRenamed("n", "hi")  # one row
    tasks = tasks.withColumn("hi", F.when(F.col("task") == 3, 0).otherwise(F.col("hi")))
    found = events.groupBy("user_id").agg(F.min("event_id").alias("first")).where("user_id < 5")
    held = F.broadcast(found.agg(F.map_from_entries(F.collect_list(F.struct("user_id", "first"))).alias("firsts")))  # five entries
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    part = lambda a, b: F.struct("task", a.alias("lo"), b.alias("hi"), "firsts")
    halves = F.when(F.col("hi") > F.col("lo"), F.array(part(F.col("lo"), middle), part(middle, F.col("hi"))))
    at = F.element_at("firsts", F.col("task"))
    problem = divide.Problem(
        is_leaf=lambda t: (t["hi"] - t["lo"] <= 2500) & (t["task"] != 3), divide=lambda t: halves,
        solve=lambda t: F.when((at >= F.col("lo")) & (at < F.col("hi")), at), combine=F.min, empty=F.lit(-1).cast("long"),
    )
    return problem.run(tasks.crossJoin(held)).select("task", F.coalesce("result", F.lit(-1)).alias("first_pos"))


# k-means


@query(f"WITH {POINTS} SELECT cluster::INT AS cluster, count(*)::BIGINT AS n FROM near GROUP BY cluster")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(model.points(spark, sf_dir), model.CENTRES).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT cluster::INT AS cluster, n, cx, cy FROM step")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kmeans.step(model.points(spark, sf_dir), model.CENTRES)
    return s.select("cluster", "n", F.get("centre", F.lit(0)).alias("cx"), F.get("centre", F.lit(1)).alias("cy"))


@query(f"WITH {POINTS} SELECT floor(sum(sqrt((s.cx / 100 - c.cx) * (s.cx / 100 - c.cx) + (s.cy / 100 - c.cy) * (s.cy / 100 - c.cy))) * 10000 + 0.5)::BIGINT AS shift FROM step s JOIN centres c USING (cluster)")
def kmeans_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kmeans.step(model.points(spark, sf_dir), model.CENTRES)
    old = F.get(kmeans.literal(model.CENTRES), F.col("cluster"))
    new = F.transform("centre", lambda x: x / 100)
    return s.agg(F.floor(F.sum(numbers.distance(old, new)) * 10000 + 0.5).cast("long").alias("shift"))


@query(f"WITH {POINTS} SELECT count(*)::BIGINT AS n, sum(floor(d * 100 + 0.5)::BIGINT)::BIGINT AS distance FROM (SELECT id, min(sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y))) AS d FROM points, centres GROUP BY id)")
def kmeans_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.total_distance(model.points(spark, sf_dir), model.CENTRES)


@query("SELECT count(*)::BIGINT AS n, sum(floor(l_quantity * 100 + 0.5)::BIGINT)::BIGINT AS x, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS y, 5::BIGINT AS centres FROM lineitem")
def vectors_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and centres written as text, one vector for each line, and read again."""
    folder = scratch(spark)
    points = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice").alias("point"))
    write_vectors(points, "point", f"{folder}/points")
    write_vectors(spark.createDataFrame([(c,) for c in model.CENTRES], "point array<double>").coalesce(1), "point", f"{folder}/centres")
    centres = read_centres(spark, f"{folder}/centres/*.txt")
    read = read_points(spark, f"{folder}/points")
    return read.agg(F.count("*").alias("n"), *[F.sum(numbers.hundredths(F.get("point", F.lit(d)))).alias(c) for d, c in enumerate("xy")], F.lit(len(centres)).cast("long").alias("centres"))


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, steps = kmeans.fit(model.points(spark, sf_dir), model.CENTRES)
    return spark.createDataFrame([(k, *c, steps) for k, c in enumerate(centres)], "cluster int, cx double, cy double, steps int")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id AS cid, v AS cv FROM e WHERE vec_id < 4),
d AS (SELECT vec_id, arg_min(cid, {'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - cv[i]) * (v[i] - cv[i]))), 'c': cid}) AS cluster FROM e, c GROUP BY vec_id)
SELECT cluster::BIGINT AS cluster, count(*)::BIGINT AS n FROM d GROUP BY cluster""")
def kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("point"))
    centres = [list(r[0]) for r in e.where("vec_id < 4").orderBy("vec_id").select("point").collect()]  # four rows
    return kmeans.assign(e, centres).groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


# the job table


@query(f"WITH {JOBS} SELECT path, parent_path, depth FROM jobs")
def stamp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.jobs(spark, sf_dir).select("path", "parent_path", "depth")


@query(f"WITH {JOBS} SELECT depth, count(*)::BIGINT AS n FROM jobs GROUP BY depth")
def stamp_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.jobs(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


@query("""SELECT concat_ws('.', o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS path, o_orderkey FROM orders""")
def stamp_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.array("c_custkey").alias("stamp"))
    children = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return jobs.children_stamps(parents, children, "o_custkey", ["o_orderkey"]).select(jobs.dotted(F.col("stamp")).alias("path"), "o_orderkey")


@query(f"WITH {JOBS} SELECT path, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT path, list_sum(list_transform(range(1, len(stamp) + 1), lambda i: stamp[i] * (16 ** (len(stamp) - i))::BIGINT))::BIGINT % 4294967296 AS h FROM jobs)")
def stamp_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = jobs.stamp_hash(F.col("stamp"))
    return model.jobs(spark, sf_dir).select("path", F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).alias("hash"))


@query(f"WITH {JOBS} SELECT path FROM jobs WHERE stamp[1:2] = [1, 2] OR stamp[1:1] = [3]")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, array = model.jobs(spark, sf_dir), lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    return j.where(jobs.is_descendant(F.col("stamp"), array(1, 2)) | jobs.is_descendant(F.col("stamp"), array(3))).select("path")


@query(f"""WITH {JOBS}, r AS (SELECT DISTINCT path FROM jobs WHERE aborted OR (depth = 3 AND owner = 3)),
pre AS (SELECT path, unnest(list_transform(range(1, len(stamp)), lambda n: array_to_string(stamp[1:n], '.'))) AS a FROM jobs),
hit AS (SELECT DISTINCT pre.path FROM pre JOIN r ON pre.a = r.path)
SELECT path, state, owner, (aborted OR path IN (SELECT path FROM hit)) AS aborted FROM jobs""")
def kill_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = model.jobs(spark, sf_dir)
    return jobs.kill_children(j, (F.col("depth") == 3) & (F.col("owner") == 3)).select(*JOB_COLUMNS)


@query(f"WITH {JOBS} SELECT path, state, owner, aborted OR state <> 'finished' AS aborted FROM jobs")
def kill_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.kill_outstanding(model.jobs(spark, sf_dir)).select(*JOB_COLUMNS)


@query(f"""WITH {JOBS}, pre AS (SELECT path, unnest(list_transform(range(1, len(stamp) + 1), lambda n: array_to_string(stamp[1:n], '.'))) AS a FROM jobs),
hit AS (SELECT DISTINCT pre.path FROM pre JOIN jobs r ON pre.a = r.path WHERE r.owner = 5)
SELECT path, state, owner, (aborted OR path IN (SELECT path FROM hit)) AS aborted FROM jobs""")
def kill_subtree_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.kill_owner(model.jobs(spark, sf_dir), 5).select(*JOB_COLUMNS)


@query(f"""WITH {JOBS}, pre AS (SELECT path, unnest(list_transform(range(1, len(stamp)), lambda n: array_to_string(stamp[1:n], '.'))) AS a FROM jobs),
hit AS (SELECT DISTINCT pre.path FROM pre JOIN jobs r ON pre.a = r.path WHERE r.owner = 3 AND r.depth = 3)
SELECT DISTINCT stealer FROM jobs WHERE state = 'stolen' AND path IN (SELECT path FROM hit)""")
def kill_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom to tell that jobs they stole are aborted."""
    j = model.jobs(spark, sf_dir)
    hit = jobs.below(j, j.where("depth = 3 AND owner = 3"), with_self=False)
    return hit.where("state = 'stolen'").select("stealer").distinct()


@query(f"WITH {JOBS} SELECT path, CASE WHEN state = 'stolen' AND stealer = 4 THEN 'queued' ELSE state END AS state, CASE WHEN NOT (state = 'stolen' AND stealer = 4) THEN stealer ELSE -1 END AS stealer, (state = 'stolen' AND stealer = 4) AS redone FROM jobs")
def redo_stolen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.redo_stolen(model.jobs(spark, sf_dir), 4).select("path", "state", F.coalesce("stealer", F.lit(-1)).alias("stealer"), "redone")


@query(f"WITH {JOBS} SELECT path, parent_path FROM jobs WHERE state = 'finished' AND parent_path IN (SELECT path FROM jobs WHERE state = 'running')")
def finished_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.finished_children(model.jobs(spark, sf_dir)).select("path", "parent_path")


@query(f"WITH {JOBS} SELECT path FROM jobs WHERE state = 'finished' AND parent_path IN (SELECT path FROM jobs WHERE state = 'running') AND owner >= 4")
def unsent_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished children that no checkpoint has; owners below 4 have sent theirs."""
    j = model.jobs(spark, sf_dir)
    sent = j.where("owner < 4").select("path")
    return jobs.without(jobs.finished_children(j), sent, "path").select("path")


@query(f"WITH {JOBS} SELECT parent_path, count(*)::BIGINT AS n FROM jobs WHERE state <> 'finished' GROUP BY parent_path")
def outstanding_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.outstanding(model.jobs(spark, sf_dir))


@query("""SELECT coalesce(n_regionkey, -1)::INT AS region, coalesce(n_nationkey, -1)::INT AS nation, count(*)::BIGINT AS n, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    sums = x.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), numbers.fixed_sum(F.col("o_totalprice")).alias("total"))
    return sums.select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("n_nationkey", F.lit(-1)).alias("nation"), "n", "total")


@query(f"WITH {JOBS} SELECT path, seq FROM jobs WHERE state = 'queued' ORDER BY seq, path LIMIT 20")
def steal_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.from_tail(model.jobs(spark, sf_dir), 20).select("path", "seq")


@query(f"WITH {JOBS} SELECT path, seq FROM jobs WHERE state = 'queued' ORDER BY seq DESC, path LIMIT 20")
def local_lifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.from_head(model.jobs(spark, sf_dir), 20).select("path", "seq")


@query(f"WITH {JOBS} SELECT path FROM jobs WHERE state = 'running' AND (path, owner) IN (SELECT path, 2 FROM jobs WHERE depth <= 3)")
def stack_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = model.jobs(spark, sf_dir)
    asked = j.where("depth <= 3").select("path", F.lit(2).cast("long").alias("owner"))
    return jobs.among(j.where("state = 'running'"), asked, ["path", "owner"]).select("path")


@query(f"WITH {JOBS} SELECT path, (path IN (SELECT path FROM jobs WHERE seq % 97 = 0)) AS listed FROM jobs WHERE depth = 3")
def abort_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = model.jobs(spark, sf_dir)
    asked = j.where("seq % 97 = 0").select("path", F.lit(True).alias("listed"))
    return j.where("depth = 3").join(asked, "path", "left").select("path", F.coalesce("listed", F.lit(False)).alias("listed"))


@query(f"WITH {JOBS} SELECT path, state FROM jobs WHERE NOT (seq % 97 = 0)")
def remove_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = model.jobs(spark, sf_dir)
    return jobs.without(j, j.where("seq % 97 = 0").select("path"), "path").select("path", "state")


@query(f"""WITH {JOBS}, pre AS (SELECT path, unnest(list_transform(range(1, len(stamp)), lambda n: array_to_string(stamp[1:n], '.'))) AS a FROM jobs WHERE state = 'finished'),
hit AS (SELECT DISTINCT pre.path FROM pre JOIN jobs r ON pre.a = r.path WHERE r.owner = 3 AND r.depth = 3)
SELECT path, 'RESULT' AS kind, owner FROM jobs WHERE path IN (SELECT path FROM hit)""")
def abort_and_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved of aborted subtrees: their finished jobs, as results."""
    j = model.jobs(spark, sf_dir)
    hit = jobs.below(j.where("state = 'finished'"), j.where("depth = 3 AND owner = 3"), with_self=False)
    return hit.select("path", F.lit("RESULT").alias("kind"), "owner")


@query(f"WITH {JOBS} SELECT path, owner = 3 OR depth = 1 AS is_local FROM jobs")
def local_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.jobs(spark, sf_dir).select("path", ((F.col("owner") == 3) | (F.col("depth") == 1)).alias("is_local"))


# the result table


@query(f"WITH {RESULTS} SELECT c_custkey AS key, coalesce(r.kind, '') AS kind, coalesce(r.value, -1) AS value FROM customer LEFT JOIN (SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM results GROUP BY key) r ON r.key = c_custkey")
def grt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = results.upsert(model.results(spark, sf_dir), "key", "seq")
    return results.lookup(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), last, "key").select("key", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("value", F.lit(-1)).alias("value"))


@query(f"WITH {RESULTS} SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value, arg_max(owner, seq) AS owner, max(seq) AS seq FROM results GROUP BY key")
def grt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.upsert(model.results(spark, sf_dir), "key", "seq")


@query(f"""WITH {RESULTS} SELECT key, arg_max(kind, [(owner < 5)::INT, seq]) AS kind, arg_max(value, [(owner < 5)::INT, seq]) AS value, arg_max(owner, [(owner < 5)::INT, seq]) AS owner FROM results GROUP BY key""")
def grt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = model.results(spark, sf_dir)
    return results.merge(r.where("owner >= 5"), r.where("owner < 5"), "key", "seq").select("key", "kind", "value", "owner")


@query(f"WITH {RESULTS} SELECT key, 'POINTER' AS kind, CASE WHEN kind = 'POINTER' THEN value ELSE -1 END AS value, CASE WHEN kind = 'RESULT' THEN 3 ELSE owner END::BIGINT AS owner, seq FROM results")
def grt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.export(model.results(spark, sf_dir), 3).select("key", "kind", F.coalesce("value", F.lit(-1)).alias("value"), F.col("owner").cast("long").alias("owner"), "seq")


@query(f"WITH {RESULTS}, last AS (SELECT key, arg_max(value, seq) AS value FROM results GROUP BY key) SELECT o_orderkey, last.value FROM orders JOIN last ON o_custkey = key")
def grt_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = results.upsert(model.results(spark, sf_dir), "key", "seq")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(last, "key").select("o_orderkey", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def grt_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"))
    return jobs.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey")


@query(f"""WITH {RESULTS}, v AS (SELECT key, owner, arg_max(value, seq) AS found FROM results WHERE kind = 'RESULT' GROUP BY key, owner)
SELECT p.seq, p.key, p.owner, coalesce(v.found, -1) AS found FROM results p LEFT JOIN v ON v.key = p.key AND v.owner = p.owner WHERE p.kind = 'POINTER' AND p.owner <> 2""")
def grt_dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = model.results(spark, sf_dir)
    held = r.where("kind = 'RESULT'").groupBy("key", "owner").agg(F.max_by(F.struct("kind", "value", "seq"), "seq").alias("x")).select("key", "owner", "x.*")
    rows = r.where("kind = 'POINTER'").unionByName(held.select(*r.columns))
    dead = spark.range(2, 3).select(F.col("id").alias("owner"))
    return results.dereference(rows, dead, "key").select("seq", "key", "owner", F.coalesce("found", F.lit(-1)).alias("found"))


@query(f"WITH {JOBS} SELECT path, owner FROM jobs WHERE state = 'finished' AND stealer IN (3, 7)")
def orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose owner is gone are stored."""
    gone = spark.createDataFrame([(3,), (7,)], "stealer long")
    return jobs.among(model.jobs(spark, sf_dir).where("state = 'finished'"), gone, "stealer").select("path", "owner")


@query("SELECT o_orderkey, coalesce(a.owner, -1)::BIGINT AS owner FROM orders LEFT JOIN (SELECT user_id, max(event_id) AS owner FROM events GROUP BY user_id) a ON o_custkey = a.user_id")
def orphan_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.max("event_id").alias("owner"))
    return table(spark, sf_dir, "orders").join(found, "o_custkey", "left").select("o_orderkey", F.coalesce("owner", F.lit(-1)).cast("long").alias("owner"))


# checkpoints


@query(f"WITH {RESULTS} SELECT key, kind, value, seq FROM results WHERE owner IN (1, 4, 9)")
def ckpt_read_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended to a checkpoint in two parts, and read by sender."""
    r = model.results(spark, sf_dir).withColumnRenamed("owner", "sender")
    log = results.Checkpoints(spark, scratch(spark))
    log.append(r.where("seq % 2 = 0"))
    log.append(r.where("seq % 2 = 1"))
    return log.read([1, 4, 9]).select("key", "kind", "value", "seq")


CKPT = f"""WITH {JOBS}, c AS (SELECT * FROM jobs WHERE (depth = 3 AND seq % 5 = 0) OR (depth = 4 AND state = 'finished') OR (depth = 2 AND seq % 6 = 0)),
pre AS (SELECT path, unnest(list_transform(range(1, len(stamp)), lambda n: array_to_string(stamp[1:n], '.'))) AS a FROM c)"""


def ckpt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.jobs(spark, sf_dir).where("(depth = 3 AND seq % 5 = 0) OR (depth = 4 AND state = 'finished') OR (depth = 2 AND seq % 6 = 0)")


@query(f"{CKPT} SELECT path, owner FROM c WHERE path NOT IN (SELECT pre.path FROM pre JOIN c d ON pre.a = d.path)")
def ckpt_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs taken twice, then compressed; what is read is the new generation."""
    rows, log = ckpt_rows(spark, sf_dir), results.Checkpoints(spark, scratch(spark))
    log.take(rows.where("depth < 4"))
    log.take(rows)
    log.compress()
    return log.read().select("path", "owner")


@query(f"{CKPT} SELECT j.path, (c.path IS NOT NULL) AS reused FROM jobs j LEFT JOIN c ON c.path = j.path")
def ckpt_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a checkpoint has, with its result, and the others, which remain."""
    log = results.Checkpoints(spark, scratch(spark))
    log.take(ckpt_rows(spark, sf_dir).withColumn("value", F.col("seq")))
    reused, remaining = log.resume(model.jobs(spark, sf_dir).select("path"))
    return reused.select("path", F.lit(True).alias("reused")).unionAll(remaining.select("path", F.lit(False)))


@query("""WITH r AS (SELECT s_suppkey AS node, floor(abs(s_acctbal) * 100 + 0.5)::BIGINT AS t, s_suppkey % 10 AS arrival FROM supplier)
SELECT arg_min(node, [t, arrival, node]) AS node, count(*)::BIGINT AS reports FROM r""")
def coordinator_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    r = s.select(F.col("s_suppkey").alias("node"), numbers.hundredths(F.abs("s_acctbal")).alias("t"), F.struct(F.col("s_suppkey") % 10, "s_suppkey").alias("arrival"))
    return stats.fastest(r, "node", "t", "arrival", peers=2)


# shared objects


@query(f"WITH {LOG} SELECT object_id, min(value) AS state, count(*)::BIGINT AS n_updates FROM log GROUP BY object_id")
def so_fold_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.fold_min(model.log(spark, sf_dir), "value")


@query(f"WITH {LOG} SELECT object_id, seq, min(value) OVER (PARTITION BY object_id ORDER BY seq) AS state FROM log")
def so_running_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.running_min(model.log(spark, sf_dir), "value").select("object_id", "seq", "state")


@query(f"WITH {LOG} SELECT object_id, arg_max(value, seq) AS state, max(seq) AS seq FROM log GROUP BY object_id")
def so_fold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.fold_last(model.log(spark, sf_dir), "value")


@query(f"WITH {LOG} SELECT object_id, (sum(CASE WHEN seq > p THEN value ELSE 0 END))::BIGINT AS state, count(*)::BIGINT AS n FROM (SELECT *, coalesce(max(CASE WHEN method = 'error' THEN seq END) OVER (PARTITION BY object_id), -1) AS p FROM log) GROUP BY object_id")
def so_fold_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object whose error method clears it and whose other methods add."""
    return shared.fold_cleared(model.log(spark, sf_dir), "value", "error")


@query("""WITH t AS (SELECT o_orderkey % 4 AS round, floor(o_totalprice * 100 + 0.5)::BIGINT AS value, floor(o_totalprice * 100 + 0.5)::BIGINT // 8 AS lower FROM orders),
a AS (SELECT 0::BIGINT AS round, count(*)::BIGINT AS n, min(value) AS bound FROM t WHERE round = 0),
b AS (SELECT 1::BIGINT AS round, count(*)::BIGINT AS n, least(min(value), min(a.bound), (SELECT bound FROM a)) AS bound FROM t, a WHERE t.round = 1 AND lower < a.bound),
c AS (SELECT 2::BIGINT AS round, count(*)::BIGINT AS n, least(min(value), (SELECT bound FROM b)) AS bound FROM t, b WHERE t.round = 2 AND lower < b.bound),
d AS (SELECT 3::BIGINT AS round, count(*)::BIGINT AS n, least(min(value), (SELECT bound FROM c)) AS bound FROM t, c WHERE t.round = 3 AND lower < c.bound)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def so_bounded_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of tasks, each guarded by the bound that the rounds before have found."""
    value = numbers.hundredths(F.col("o_totalprice"))
    tasks = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("round"), value.alias("value"), F.floor(value / 8).alias("lower"))
    return spark.createDataFrame(shared.bounded_rounds(tasks, 4), "round long, n long, bound long")


@query(f"WITH {LOG} SELECT object_id, seq FROM log WHERE object_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def so_drop_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("object_id"))
    return shared.known_only(model.log(spark, sf_dir), held).select("object_id", "seq")


@query(f"WITH {LOG}, x AS (SELECT object_id, min(seq) FILTER (method = 'signup') AS first FROM log GROUP BY object_id) SELECT log.object_id, seq FROM log JOIN x USING (object_id) WHERE seq >= first")
def so_only_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates are broadcast from the one on that shares the object (signup)."""
    log = model.log(spark, sf_dir)
    shared_at = log.where("method = 'signup'").groupBy("object_id").agg(F.min("seq").alias("first"))
    return log.join(shared_at, "object_id").where("seq >= first").select("object_id", "seq")


@query(f"WITH {LOG}, s AS (SELECT object_id, min(value) AS state FROM log GROUP BY object_id) SELECT o_orderkey FROM orders JOIN s ON o_custkey = object_id WHERE state <= o_orderkey % 1000")
def guard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("object_id"))
    states = shared.fold_min(model.log(spark, sf_dir), "value")
    return shared.guarded(tasks, states, F.col("state") <= F.col("o_orderkey") % 1000).select("o_orderkey")


@query()
def so_combined_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = model.log(spark, sf_dir).withColumn("bytes", F.lit(100).cast("long"))
    return shared.combined_messages(log, "bytes", "seq", most_bytes=1000, most_delay=3000).groupBy("object_id", "message").agg(F.count("*").alias("updates"), F.sum("bytes").alias("bytes"))


# exceptions and speculation


@query("SELECT count(*)::BIGINT AS found, coalesce(bool_and(user_id = 42), true) AS holds FROM (SELECT user_id FROM events WHERE user_id = 42 LIMIT 1)")
def speculative_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which position is found is open; that there is one, and that it holds the value, isn't."""
    events = table(spark, sf_dir, "events")
    found = speculation.any_position(events, "event_id", "user_id", 42)
    return found.join(events.select("event_id", "user_id"), "event_id").agg(F.count("*").alias("found"), F.coalesce(F.bool_and(F.col("user_id") == 42), F.lit(True)).alias("holds"))


@query("SELECT count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*) FILTER (event_type <> 'error')::BIGINT AS good FROM events")
def error_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.struct(F.lit("EventError").alias("type"), F.col("props").alias("message"))))
    good, failed = speculation.split_errors(e)
    return failed.agg(F.count("*").alias("failed")).crossJoin(good.agg(F.count("*").alias("good")))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN -2 ELSE event_id END::BIGINT AS result, CASE WHEN event_type NOT IN ('error', 'click') THEN event_type END AS kind FROM events""")
def inlet_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("result"), F.col("event_type").alias("kind"))
    out = speculation.handled(e, [("error", -1), ("click", -2), ("error", -3)], "kind", "result")
    return out.select("event_id", F.col("result").cast("long").alias("result"), "kind")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id END::BIGINT AS result, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events")
def inlet_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler without a value: the error is gone, and so is the result."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("result"), F.col("event_type").alias("kind"))
    return speculation.handled(e, [("error", None)], "kind", "result")


# statistics and scheduling


@query(f"WITH {NODE_STATS} SELECT sum(steal_attempts)::BIGINT AS steal_attempts, sum(steal_success)::BIGINT AS steal_success, sum(jobs)::BIGINT AS jobs, sum(table_max)::BIGINT AS table_max_sum, max(table_max)::BIGINT AS table_max_max FROM node_stats")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merged(model.node_stats(spark, sf_dir), ["steal_attempts", "steal_success", "jobs"], ["table_max"])


@query(f"WITH {NODE_STATS} SELECT node, steal_attempts, floor(CASE WHEN steal_attempts = 0 THEN 0 ELSE 100.0::DOUBLE * steal_success / steal_attempts END * 100 + 0.5)::BIGINT AS success_pct FROM node_stats")
def stats_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.node_stats(spark, sf_dir)
    return s.select("node", "steal_attempts", numbers.hundredths(numbers.ratio(100.0 * F.col("steal_success"), F.col("steal_attempts"))).alias("success_pct"))


@query(f"WITH {NODE_STATS}, t AS (SELECT sum(steal_attempts)::BIGINT AS a, sum(steal_success)::BIGINT AS b, 1000000::BIGINT AS wall FROM node_stats) SELECT floor(a / 10 * 100 + 0.5)::BIGINT AS attempts_avg, floor(b / 10 * 100 + 0.5)::BIGINT AS success_avg, floor((a / 10 + b / 10) * 100 + 0.5)::BIGINT AS overhead, floor(greatest(0, wall - (a / 10 + b / 10)) * 100 + 0.5)::BIGINT AS application FROM t")
def stats_per_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = stats.merged(model.node_stats(spark, sf_dir), ["steal_attempts", "steal_success"], []).withColumn("wall", F.lit(1_000_000).cast("long"))
    out = stats.per_machine(totals, ["steal_attempts", "steal_success"], 10, "wall")
    return out.select(*[numbers.hundredths(F.col(c)).alias(a) for c, a in (("steal_attempts_avg", "attempts_avg"), ("steal_success_avg", "success_avg"), ("overhead", "overhead"), ("application", "application"))])


@query("""SELECT s_nationkey = c_nationkey AS intra, count(*)::BIGINT AS messages, sum(l_quantity::BIGINT)::BIGINT AS bytes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def traffic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return stats.traffic(rows, "s_nationkey", "c_nationkey", "size")


@query("SELECT o_orderkey AS fails, least(2 ** least(o_orderkey // 64, 60), 256)::BIGINT AS wait_ms FROM orders")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fails"), numbers.back_off(F.col("o_orderkey"), F.lit(64)).alias("wait_ms"))


@query(f"WITH {JOBS}, q AS (SELECT owner, count(*) FILTER (state = 'queued')::BIGINT AS queued FROM jobs GROUP BY owner), n AS (SELECT count(*) AS nodes FROM supplier) SELECT owner, queued, (nodes > 1 AND queued // nodes <= 1000) AS more FROM q, n")
def need_more_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = model.jobs(spark, sf_dir).groupBy("owner").agg(F.count_if(F.col("state") == "queued").alias("queued"))
    nodes = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count("*").alias("nodes")))  # one row
    return q.crossJoin(nodes).select("owner", "queued", numbers.need_more_jobs(F.col("queued"), F.col("nodes")).alias("more"))


@query("SELECT s_nationkey AS cluster, count(*)::BIGINT AS nodes FROM supplier GROUP BY s_nationkey")
def victim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.clusters(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "cluster"), "cluster")


@query("""WITH n AS (SELECT s_suppkey AS node, md5('7:' || s_suppkey) AS h, s_nationkey FROM supplier WHERE s_suppkey <> 1)
SELECT arg_min(node, h) AS node, arg_min(node, h) FILTER (s_nationkey = 3) AS local, arg_min(node, h) FILTER (s_nationkey <> 3) AS remote FROM n""")
def victim_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey")
    pick = lambda name, local: stats.victim(s, "node", 1, 7, "s_nationkey", 3, local).withColumnRenamed("node", name)
    return pick("node", None).crossJoin(pick("local", True)).crossJoin(pick("remote", False))  # three tables of one row


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def dead_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    return jobs.without(table(spark, sf_dir, "events").select("event_id", "user_id"), dead, "user_id").select("event_id")


@query(f"WITH {JOBS} SELECT path, seq FROM jobs WHERE state = 'queued' UNION ALL SELECT path, seq + 1000000 FROM jobs WHERE state = 'stolen' AND stealer NOT IN (2, 3)")
def late_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late replies: jobs of live nodes join the end of the queue, those of dead ones are dropped."""
    j = model.jobs(spark, sf_dir)
    dead = spark.range(2, 4).select(F.col("id").alias("stealer"))
    late = jobs.without(j.where("state = 'stolen'"), dead, "stealer").select("path", (F.col("seq") + 1_000_000).alias("seq"))
    return j.where("state = 'queued'").select("path", "seq").unionAll(late)


@query(f"WITH {JOBS} SELECT path, stealer FROM jobs WHERE state = 'stolen' AND seq % 3 = 0")
def result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of jobs that are outstanding; results of unknown jobs are ignored."""
    j = model.jobs(spark, sf_dir)
    arrived = j.where("seq % 3 = 0").select("path")
    return j.where("state = 'stolen'").join(arrived, "path").select("path", "stealer")


@query(f"WITH {RESULTS} SELECT seq, max(value) OVER (PARTITION BY owner ORDER BY seq) AS entries_max, owner FROM results")
def table_max_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = model.results(spark, sf_dir)
    return shared.running(r, "value", "owner", F.max, F.greatest).select("seq", F.col("state").alias("entries_max"), "owner")
