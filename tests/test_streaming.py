from splitfold.operators import shared
from splitfold.streaming import shared_state

SCHEMA = "object_id long, seq long, value long"


def test_stream_ends_in_the_batch_fold(spark, tmp_path):
    rows = [(i % 4, i, (i * 37) % 101) for i in range(200)]
    log = spark.createDataFrame(rows, SCHEMA)
    for part in range(4):
        log.where(f"seq % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = {}
    batches = []

    def sink(batch, number):
        batches.append(number)
        seen.update({r["object_id"]: (r["least"], r["n_updates"], r["last"]) for r in batch.collect()})

    stream = shared_state.read_log(spark, str(tmp_path / "log"), SCHEMA)
    shared_state.apply_updates(stream, "value", sink, str(tmp_path / "state")).awaitTermination()
    least = {r["object_id"]: (r["state"], r["n_updates"]) for r in shared.fold_min(log, "value").collect()}
    last = {r["object_id"]: r["state"] for r in shared.fold_last(log, "value").collect()}
    assert len(batches) == 4
    assert seen == {k: (*least[k], last[k]) for k in least}


def test_abort_requests_at_safe_points(spark, tmp_path):
    spark.createDataFrame([("1.2",), ("9",)], "path string").coalesce(1).write.parquet(str(tmp_path / "r"))
    jobs = spark.createDataFrame([("1.2",), ("1.3",)], "path string")
    hit = []
    stream = shared_state.read_log(spark, str(tmp_path / "r"), "path string")
    shared_state.abort_requests(stream, jobs, lambda b, n: hit.extend(r["path"] for r in b.collect()), str(tmp_path / "c")).awaitTermination()
    assert hit == ["1.2"]
