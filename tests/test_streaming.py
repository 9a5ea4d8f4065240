"""Streams equal their batch twins; stateful lifecycle and throttle semantics."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import rules as R
from clusterloom.sources import testdata as TD
from clusterloom.streaming import events as SE
from helpers import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_stream_triggers_equal_batch(spark):
    raw = TD.upstream_events(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="cl-stream-in-")
    raw.repartition(4).write.mode("overwrite").json(folder)
    stream = SE.read_event_stream(spark, folder, max_files_per_trigger=1)
    q = (SE.stream_triggers(stream).writeStream.format("memory").queryName("t1_out")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cl-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    q.stop()
    cols = ["request_id", "upstream_job_id", "embedding_type", "algorithm"]
    assert _rows(spark.table("t1_out"), cols) == _rows(SE.stream_triggers(raw), cols)


def test_stream_consumer_stats_equal_batch(spark):
    raw = TD.upstream_events(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="cl-stream-in-")
    raw.write.mode("overwrite").json(folder)
    stream = SE.read_event_stream(spark, folder)
    stats = SE.consumer_stats(R.trigger_decision(R.validate_events(stream)))
    q = (stats.writeStream.format("memory").queryName("t3_out").outputMode("complete")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cl-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    q.stop()
    batch = SE.consumer_stats(R.trigger_decision(R.validate_events(raw))).first()
    got = spark.table("t3_out").first()
    assert (got["events_processed"], got["jobs_triggered"], got["errors"]) == (
        batch["events_processed"], batch["jobs_triggered"], batch["errors"])


def test_lifecycle_fold(spark):
    cmds = spark.createDataFrame(
        [("j1", 1, 1, "start"), ("j1", 2, 2, "resume"), ("j1", 3, 3, "pause"), ("j1", 4, 4, "resume"),
         ("j1", 5, 5, "start"), ("j1", 6, 6, "complete"), ("j2", 1, 1, "pause"), ("j2", 2, 2, "cancel")],
        "job_id string, ts long, seq long, command string")
    out = {(r["job_id"], r["seq"]): (r["to_status"], r["legal"]) for r in SE.job_lifecycle_batch(cmds).collect()}
    assert out[("j1", 2)] == ("running", False)      # resume only if paused
    assert out[("j1", 4)] == ("queued", True)
    assert out[("j1", 6)] == ("completed", True)
    assert out[("j2", 1)] == ("queued", False)       # pause only if running
    assert out[("j2", 2)] == ("canceled", True)


def test_throttle_progress(spark):
    rows = [("j", f"2024-01-01 00:00:{s:02d}", s) for s in (0, 1, 4, 5, 6, 11, 12)]
    df = spark.createDataFrame(rows, "job_id string, ts string, processed_items long").withColumn(
        "ts", F.to_timestamp("ts"))
    kept = sorted(r["processed_items"] for r in SE.throttle_progress_batch(df, 5.0).collect())
    assert kept == [0, 5, 11]


def test_error_alerts_window(spark):
    rows = [(f"2024-01-01 00:0{m}:00", "E1") for m in range(5)] * 3
    df = spark.createDataFrame(rows, "ts string, error_type string").withColumn("ts", F.to_timestamp("ts"))
    a = SE.error_alerts(df, "300 seconds", "60 seconds", 10).collect()
    assert a and max(r["n_errors"] for r in a) == 15


def test_stream_dedupe_once_per_upstream_job(spark):
    raw = TD.upstream_events(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="cl-stream-in-")
    raw.write.mode("overwrite").json(folder)
    req = SE.stream_triggers(SE.read_event_stream(spark, folder))
    q = (SE.dedupe_requests_stream(req, "30 days").writeStream.format("memory").queryName("t2_out")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cl-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    q.stop()
    got = spark.table("t2_out")
    assert got.count() == got.select("upstream_job_id", "embedding_type").distinct().count()
    batch = SE.dedupe_requests_batch(SE.stream_triggers(raw), 30 * 86400.0)
    assert got.count() == batch.count()


def test_stream_lifecycle_state_across_batches(spark):
    folder = tempfile.mkdtemp(prefix="cl-cmd-")
    schema = "job_id string, ts long, seq long, command string"
    # one file per command batch, written in order: the stream sees batch a, then batch b
    spark.createDataFrame([("j1", 1, 1, "start"), ("j2", 1, 1, "pause")], schema).coalesce(1).write.json(
        folder + "/a")
    spark.createDataFrame([("j1", 2, 2, "pause"), ("j1", 3, 3, "resume"), ("j2", 2, 2, "start")],
                          schema).coalesce(1).write.json(folder + "/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder + "/*")
    q = (SE.job_lifecycle_stream(stream).writeStream.format("memory").queryName("t4_out").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cl-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    q.stop()
    out = {(r["job_id"], r["seq"]): (r["to_status"], r["legal"]) for r in spark.table("t4_out").collect()}
    assert out[("j1", 3)] == ("queued", True) and out[("j2", 1)] == ("queued", False)
    assert out[("j2", 2)] == ("running", True)


def test_incremental_assign_stream_versions(spark):
    from pyspark.sql import functions as F2

    root = tempfile.mkdtemp(prefix="cl-cent-")
    spark.createDataFrame([(0, [0.0, 0.0], 2, 0), (1, [10.0, 10.0], 1, 0)],
                          "label int, centroid array<double>, size long, version long").write.parquet(root + "/c")
    newdir = tempfile.mkdtemp(prefix="cl-new-")
    spark.createDataFrame([("a", [1.0, 1.0]), ("b", [9.0, 9.0]), ("c", [50.0, 50.0])],
                          "item_id string, embedding array<double>").write.mode("overwrite").json(newdir)
    stream = spark.readStream.schema("item_id string, embedding array<double>").json(newdir)
    q = SE.incremental_assign_stream(stream, root + "/c", tempfile.mkdtemp(prefix="cl-ckpt-"), max_distance=5.0)
    q.awaitTermination(120)
    q.stop()
    cents = spark.read.parquet(root + "/c")
    latest = cents.where(F2.col("version") == cents.select(F2.max("version")).first()[0])
    got = {r["label"]: (r["size"], [round(v, 6) for v in r["centroid"]]) for r in latest.collect()}
    assert got[0] == (3, [1 / 3, 1 / 3]) or got[0] == (3, [round(1 / 3, 6)] * 2)
    assert got[1][0] == 2


def test_long_logs_are_split(spark):
    """A log in chunks of two commands, and stretches cut at long gaps, give what one pass gives."""
    import random

    rng = random.Random(4)
    rows = [(f"j{rng.randint(0, 1)}", i // 2, i, rng.choice(list(SE.TRANSITIONS))) for i in range(40)]
    cmds = spark.createDataFrame(rows, "job_id string, ts long, seq long, command string")
    want = {}
    for job in ("j0", "j1"):
        status = "queued"
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[1], r[2])):
            allowed, nxt = SE.TRANSITIONS[r[3]]
            legal = status in allowed
            want[r[2]] = (status, nxt if legal else status, legal)
            status = want[r[2]][1]
    got = {r["seq"]: (r["from_status"], r["to_status"], r["legal"]) for r in SE.job_lifecycle_batch(cmds, chunk=2).collect()}
    assert got == want


def sequential_throttle(log, every):
    """(key, second, n) of the rows kept, n events each, in the order of (key, second)."""
    kept, last = [], {}
    for key, t in sorted(log, key=lambda r: (r[0] or "", r[1])):
        if key not in last or t - last[key] >= every:
            kept.append([key, t, 0])
            last[key] = t
        kept[-1][2] += 1
    return sorted(map(tuple, kept), key=str)


@pytest.mark.parametrize("every", [7, 0])
def test_throttle_of_dense_logs_in_many_chunks(spark, every):
    rng = np.random.default_rng(8)
    log = [("hot", int(t)) for t in np.cumsum(rng.integers(0, 4, 300))]  # one stretch without a gap, with ties
    log += [(f"k{i % 5}", int(t)) for i, t in enumerate(rng.integers(0, 200, 80))] + [(None, 3), (None, 4), ("lone", 9)]
    df = spark.createDataFrame(log, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"), "s").repartition(3)
    for chunk in (16, 10_000):
        got = SE.throttle_batch(df, ["k"], ["s"], every, chunk).collect()
        assert sorted(((r["k"], r["s"], r["n_events"]) for r in got), key=str) == sequential_throttle(log, every)


def test_throttle_of_an_empty_log_and_of_rows_without_time(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", None)], "k string, s long").select(
        "k", F.timestamp_seconds("s").alias("ts"))
    got = SE.throttle_batch(df, ["k"], [], 3, 16).collect()
    assert sorted((r["ts"] is None, r["n_events"]) for r in got) == [(False, 1), (True, 2)]
    assert SE.throttle_batch(df.limit(0), ["k"], [], 3, 16).count() == 0


def test_lifecycle_groups_are_chunks_of_many_jobs(spark):
    """Jobs of a few commands share a chunk, long ones go on over chunks; a task per job isn't planned."""
    rng = np.random.default_rng(6)
    names = list(SE.TRANSITIONS)
    rows = [(f"j{int(j):02d}", i, i, names[int(c)]) for i, (j, c) in enumerate(zip(
        rng.choice([0, 0, 0, 0, *range(1, 30)], 200), rng.integers(0, len(names), 200)))]
    out = SE.job_lifecycle_batch(spark.createDataFrame(rows, "job_id string, ts long, seq long, command string"), chunk=9)
    assert "FlatMapGroupsInPandas [_chunk" in out._jdf.queryExecution().toString()
    want, status = {}, {}
    for job, _, seq, command in rows:
        allowed, nxt = SE.TRANSITIONS[command]
        old = status.get(job, "queued")
        status[job] = nxt if old in allowed else old
        want[seq] = (old, status[job], old in allowed)
    assert {r["seq"]: (r["from_status"], r["to_status"], r["legal"]) for r in out.collect()} == want
