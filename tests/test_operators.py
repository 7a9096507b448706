import math
import random
import time

import pytest
from pyspark.sql import functions as F

from splitfold.functions import numbers
from splitfold.operators import divide, jobs, kmeans, results, shared, speculation
from splitfold.sources import vectors


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("n", "tasks"), [(0, 3), (1, 3), (7, 3), (10_000, 7), (5, 5)])
def test_ranges_and_task_of_agree(spark, n, tasks):
    size = spark.range(1).select(F.lit(n).alias("n"))
    rows = {r["task"]: (r["lo"], r["hi"]) for r in divide.ranges(spark, size, tasks).collect()}
    lengths = [hi - lo for _, (lo, hi) in sorted(rows.items())]
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and max(lengths) - min(lengths) <= 1
    placed = spark.range(n).select("id", divide.task_of(F.col("id"), F.lit(n), tasks).alias("task")).collect()
    assert all(rows[r["task"]][0] <= r["id"] < rows[r["task"]][1] for r in placed)


def test_fibonacci(spark):
    assert one(divide.fibonacci(spark, 32).where("n = 32").select("fib")) == 2178309
    assert one(divide.fibonacci(spark, 92).where("n = 92").select("fib")) == 7540113804746346429
    with pytest.raises(ValueError):
        divide.fibonacci(spark, 93)


def test_problem_divides_solves_and_combines(spark):
    tasks = spark.createDataFrame([(0, 1000), (5, 6), (10, 10)], "lo long, hi long")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    problem = divide.Problem(
        is_leaf=lambda t: t["hi"] - t["lo"] <= 100,
        divide=lambda t: F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))),
        solve=lambda t: F.aggregate(F.when(t["hi"] > t["lo"], F.sequence(t["lo"], t["hi"] - 1)).otherwise(F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x),
        combine=F.sum,
    )
    assert {(r["lo"], r["hi"]): r["result"] for r in problem.run(tasks).collect()} == {(0, 1000): 499500, (5, 6): 5, (10, 10): 0}


def test_problem_divides_into_nothing(spark):
    tasks = spark.createDataFrame([(0,), (1,), (5,), (None,)], "x long")
    down = lambda t: F.when(F.col("x") > 0, F.array(F.struct((F.col("x") - 1).alias("x")), F.struct((F.col("x") - 2).alias("x"))))
    none = divide.Problem(lambda t: t["x"] < 0, down, lambda t: F.lit(1).cast("long"), F.sum)
    assert {r["x"]: r["result"] for r in none.run(tasks.where("x IS NOT NULL")).collect()} == {0: None, 1: 1, 5: 5}
    zero = divide.Problem(lambda t: F.coalesce(t["x"] < 0, F.lit(False)), down, lambda t: F.lit(1).cast("long"), F.sum, empty=F.lit(100).cast("long"))
    assert {r["x"]: r["result"] for r in zero.run(tasks).collect()} == {0: 100, 1: 101, 5: 805, None: 100}


def test_problem_guard(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "x long")
    problem = divide.Problem(lambda t: F.lit(True), lambda t: F.array(F.struct("x")), lambda t: t["x"] * 10, F.sum, guard=lambda t: t["x"] > 1)
    assert {r["x"]: r["result"] for r in problem.run(tasks).collect()} == {1: None, 2: 20}


def test_search(spark):
    a = vectors.random_array(spark, 5000, 50, seed=3)
    rows = [r["value"] for r in a.orderBy("pos").collect()]
    assert one(divide.first_position(a, "pos", "value", 42)) == rows.index(42)
    assert one(divide.first_position(a, "pos", "value", 50)) == -1
    assert rows[one(speculation.any_position(a, "pos", "value", 42))] == 42
    assert rows == [r["value"] for r in vectors.random_array(spark, 5000, 50, seed=3).repartition(7).orderBy("pos").collect()]


def test_half_hundredths_round_up(spark):
    x = spark.createDataFrame([(-0.025,), (0.025,), (2.5,)], "x double").select(numbers.hundredths(F.col("x")))
    assert [r[0] for r in x.collect()] == [-2, 3, 250]


def test_text_vectors(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a").write_text("1.5 2\n-3 4e1\n")
    (tmp_path / "p/b").write_text("0 0\n")
    assert sorted(list(r[0]) for r in vectors.read_points(spark, str(tmp_path / "p")).collect()) == [[-3.0, 40.0], [0.0, 0.0], [1.5, 2.0]]
    assert vectors.read_centres(spark, str(tmp_path / "p/a")) == [[1.5, 2.0], [-3.0, 40.0]]
    vectors.write_vectors(vectors.read_points(spark, str(tmp_path / "p")), "point", str(tmp_path / "q"))
    assert vectors.read_points(spark, str(tmp_path / "q")).count() == 3


def brute_kmeans(points, centres):
    steps = 0
    while True:
        steps += 1
        sums = {}
        for p in points:
            k = min(range(len(centres)), key=lambda i: (math.dist(centres[i], p), i))
            s = sums.setdefault(k, [0] + [0] * len(p))
            s[0] += 1
            for d, x in enumerate(p):
                s[d + 1] += math.floor(x * 100 + 0.5)
        new = {k: [math.floor(x / s[0] + 0.5) / 100 for x in s[1:]] for k, s in sums.items()}
        shift = sum(math.dist(centres[k], c) for k, c in new.items())
        centres = [new.get(k, c) for k, c in enumerate(centres)]
        if shift < 0.01:
            return centres, steps


def test_kmeans_is_the_same_for_any_partitioning(spark):
    rnd = random.Random(5)
    points = [[rnd.gauss(c, 1), rnd.gauss(-c, 1)] for c in (0, 5, 9) for _ in range(60)]
    start = [[0.0, 0.0], [4.0, -4.0], [10.0, -10.0], [500.0, 500.0]]
    want = brute_kmeans(points, start)
    rows = spark.createDataFrame([(p,) for p in points], "point array<double>")
    assert kmeans.fit(rows, start) == want
    assert kmeans.fit(rows.repartition(5), start) == want


def test_kmeans_reads_equal_points_once(spark):
    points = [[float(k % 7), float(k % 3)] for k in range(420)]
    rows = spark.createDataFrame([(p,) for p in points], "point array<double>")
    once = kmeans.merged(rows, 2)
    assert (once.count(), once.agg({"n": "sum"}).first()[0]) == (21, 420)
    start = [[0.0, 0.0], [3.0, 1.0], [6.0, 2.0]]
    assert kmeans.fit(rows, start) == brute_kmeans(points, start)


def test_kmeans_distances_of_few_centres_are_compiled(spark):
    points = [[1.0, 2.0], [2.0, 2.0], [float("nan"), 1.0], [None, 1.0], [1.0], [1.0, 2.0, 3.0], None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(points)], "k int, point array<double>")
    centres = [[9.0, 9.0], [1.0, 2.0], [3.0, 2.0]]
    near = kmeans.assign(rows, centres)
    assert "lambda" not in near._jdf.queryExecution().toString() and near.columns == ["k", "point", "cluster", "distance"]
    want = rows.select("k", kmeans.nearest(rows.point, kmeans.literal(centres)).alias("near")).orderBy("k").collect()
    assert [repr((r.cluster, r.distance)) for r in near.orderBy("k").collect()] == [repr((r.near.cluster, r.near.distance)) for r in want]


def job_rows(spark):
    rows = [([1], "running", 1, 9, False, 0), ([1, 0], "running", 2, 9, False, 1), ([1, 0, 0], "finished", 1, 9, False, 2), ([1, 0, 1], "stolen", 1, 4, False, 3), ([1, 1], "queued", 3, 9, True, 4), ([1, 1, 0], "queued", 1, 9, False, 5), ([10], "queued", 1, 9, False, 6)]
    df = spark.createDataFrame(rows, "stamp array<long>, state string, owner long, stealer long, aborted boolean, seq long")
    return df.withColumns({"path": jobs.dotted(F.col("stamp")), "parent_path": jobs.dotted(jobs.parent(F.col("stamp")))})


def test_job_tree(spark):
    j = job_rows(spark)
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(jobs.below(j, j.where("path = '1.0'"))) == ["1.0", "1.0.0", "1.0.1"]
    assert paths(jobs.below(j, j.where("path = '1'"))) == ["1", "1.0", "1.0.0", "1.0.1", "1.1", "1.1.0"]
    assert paths(jobs.kill_children(j, F.col("path") == "1.0").where("aborted")) == ["1.0.0", "1.0.1", "1.1", "1.1.0"]
    assert paths(jobs.kill_owner(j, 2).where("aborted")) == ["1.0", "1.0.0", "1.0.1", "1.1"]
    assert paths(jobs.kill_outstanding(j).where("NOT aborted")) == ["1.0.0"]
    assert jobs.kill_children(j, F.lit(False)).columns == j.columns and jobs.kill_children(j.limit(0), F.lit(True)).count() == 0
    assert paths(jobs.redo_stolen(j, 4).where("redone AND state = 'queued' AND stealer IS NULL")) == ["1.0.1"]
    assert paths(jobs.finished_children(j)) == ["1.0.0"]
    assert paths(jobs.from_head(j, 1)) == ["10"] and paths(jobs.from_tail(j, 1)) == ["1.1"]
    assert {r["parent_path"]: r["n"] for r in jobs.outstanding(j).collect()} == {"": 2, "1": 2, "1.0": 1, "1.1": 1}


def test_results(spark):
    r = spark.createDataFrame([("a", "RESULT", 1, 7, 1), ("a", "POINTER", None, 8, 2), ("b", "RESULT", 5, 7, 1)], "path string, kind string, value long, owner long, seq long")
    assert {x["path"]: x["kind"] for x in results.upsert(r, "path", "seq").collect()} == {"a": "POINTER", "b": "RESULT"}
    assert {(x["path"], x["owner"]) for x in results.export(r, 3).collect()} == {("a", 3), ("a", 8), ("b", 3)}
    newer = spark.createDataFrame([("b", "RESULT", 6, 1, 0)], r.schema)
    assert {x["path"]: x["value"] for x in results.merge(r, newer, "path", "seq").collect()} == {"a": None, "b": 6}


def test_checkpoints(spark, tmp_path):
    c = results.Checkpoints(spark, str(tmp_path))
    rows = lambda x: spark.createDataFrame(x, "path string, stamp array<long>, value long, sender int, seq long")
    c.take(rows([("1.0.0", [1, 0, 0], 5, 1, 1), ("2", [2], 7, 2, 2)]))
    c.take(rows([("2", [2], 7, 2, 2), ("1.0", [1, 0], 9, 3, 3)]))
    assert sorted(r["path"] for r in c.read().collect()) == ["1.0", "1.0.0", "2"]
    assert [r["path"] for r in c.read([2]).collect()] == ["2"]
    c.compress()
    assert sorted(r["path"] for r in c.read().collect()) == ["1.0", "2"]
    (tmp_path / "log-1/part-bad.parquet").write_bytes(b"not parquet")
    reused, remaining = c.resume(spark.createDataFrame([("2",), ("3",)], "path string"))
    assert [tuple(r) for r in reused.collect()] == [("2", 7)] and [r["path"] for r in remaining.collect()] == ["3"]


def test_compress_stopped_half_way(spark, tmp_path):
    c = results.Checkpoints(spark, str(tmp_path))
    assert not c.exists()
    rows = spark.createDataFrame([("1", [1], 5, 1, 1), ("1.0", [1, 0], 7, 2, 2)], "path string, stamp array<long>, value long, sender int, seq long")
    c.take(rows)
    (tmp_path / "log-1").mkdir()  # the next generation was begun and not finished
    (tmp_path / "log-1/part-0.parquet").write_bytes(b"half")
    assert c.generations() == [0] and c.read().count() == 2
    c.compress()
    assert c.generations() == [1] and [r["path"] for r in c.read().collect()] == ["1"]
    rows.write.parquet(str(tmp_path / "log-0"))  # or it was finished and the old one was still there
    assert [r["path"] for r in c.read().collect()] == ["1"]
    c.compress()
    assert c.generations() == [2] and c.read().count() == 1


def test_running_extremes_in_stretches(spark):
    rnd = random.Random(4)
    rows = [(k % 3, s, rnd.randrange(1000)) for k, s in enumerate(rnd.sample(range(5000), 400))]
    log = spark.createDataFrame(rows, "object_id long, seq long, value long").repartition(3)
    for span in (1, 64, 100_000):
        got = {(r["object_id"], r["seq"]): r["state"] for r in shared.running(log, "value", "object_id", F.min, F.least, span).collect()}
        assert got == {(o, s): min(v for p, q, v in rows if p == o and q <= s) for o, s, _ in rows}


def test_fold_cleared(spark):
    rows = [(1, 1, "add", 5), (1, 2, "error", 9), (1, 3, "add", 7), (1, 4, "view", 1), (2, 1, "add", 3), (3, 9, "error", 2)]
    log = spark.createDataFrame(rows, "object_id long, seq long, method string, value long")
    assert sorted(map(tuple, shared.fold_cleared(log, "value", "error").collect())) == [(1, 8, 4), (2, 3, 1), (3, 0, 1)]


def test_bounded_rounds(spark):
    tasks = spark.createDataFrame([(0, 1, 50), (0, 2, 40), (1, 45, 10), (1, 39, 60), (2, 30, 20), (3, 25, 1)], "round long, lower long, value long")
    assert shared.bounded_rounds(tasks, 4) == [(0, 2, 40), (1, 1, 40), (2, 1, 20), (3, 0, 20)]


def test_kmeans_with_many_centres(spark, monkeypatch):
    points = spark.createDataFrame([([float(k % 50), 0.3 * k],) for k in range(200)], "point array<double>")
    centres = [[float(k), float(k)] for k in range(30)]
    few = [(r["cluster"], r["distance"]) for r in kmeans.assign(points, centres).orderBy("point").collect()]
    monkeypatch.setattr(kmeans, "LITERALS", 10)
    many = kmeans.assign(points, centres)
    assert [(r["cluster"], r["distance"]) for r in many.orderBy("point").collect()] == few and many.columns == ["point", "cluster", "distance"]


def test_fold_in_order(spark):
    log = spark.createDataFrame([(k % 3, i, (i * 7) % 10) for i, k in enumerate(range(60))], "object_id long, seq long, value long").repartition(4)
    out = shared.fold(log, 0, lambda s, row: s * 2 % 1000 + row.value, "object_id long, state long", lambda s: (s,))
    want = {}
    for i, k in enumerate(range(60)):
        want[k % 3] = want.get(k % 3, 0) * 2 % 1000 + (i * 7) % 10
    assert {r[0]: r[1] for r in out.collect()} == want


def test_message_combining(spark):
    log = spark.createDataFrame([(1, i, 40, i) for i in range(6)] + [(2, 0, 1, 0), (2, 1, 1, 50)], "object_id long, seq long, bytes long, at long")
    out = shared.combined_messages(log, "bytes", "at", 100, 10)
    assert [r["message"] for r in out.orderBy("object_id", "seq").collect()] == [0, 0, 0, 1, 1, 1, 0, 1]


def test_first_result_cancels_the_rest(spark):
    def slow():
        return spark.range(200_000_000_000).selectExpr("sum(id * id % 7) AS s").collect()

    def quick():
        time.sleep(1)
        return spark.range(10).count()

    began = time.time()
    assert speculation.first_of(spark, [slow, quick]) == 10
    assert time.time() - began < 60


def test_losers_start_no_further_job(spark):
    def two():
        time.sleep(4)  # the other one is done by then
        spark.range(10).count()
        return spark.range(200_000_000_000).selectExpr("sum(id * id % 7) AS s").collect()

    began = time.time()
    assert speculation.first_of(spark, [two, lambda: spark.range(7).count()]) == 7
    assert time.time() - began < 60 and spark.range(3).count() == 3


def test_errors_have_handlers(spark):
    def bad():
        raise KeyError("x")

    def found():
        raise speculation.Found(7)

    assert speculation.first_of(spark, [bad, found]) == 7
    assert speculation.first_of(spark, [bad], on_error=lambda e, k: (type(e).__name__, k)) == ("KeyError", 0)
    with pytest.raises(KeyError):
        speculation.first_of(spark, [bad])
