"""The stream operators over files that arrive one by one."""

import datetime

from pyspark.sql import functions as F

from quire.streaming import lifecycle

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, schema, build, name):
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        if i == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_jobs_follow_events_and_leases(spark, tmp_path):
    schema = "job_id long, event string, ts timestamp"
    batches = [
        [(1, "submit", at(0)), (1, "claim", at(1)), (2, "submit", at(0)), (2, "claim", at(2)), (2, "doubt", at(3)), (2, "finish", at(4))],
        [(9, "submit", at(60))],
        [(9, "submit", at(61))],
        [(1, "claim", at(62)), (1, "finish", at(63)), (2, "accept", at(64))],
    ]
    rows = run(spark, tmp_path, batches, schema, lifecycle.track_jobs, "jobs").collect()
    of = lambda job: [(r["status"], r["attempts"]) for r in rows if r["job_id"] == job]
    assert of(1) == [("received", 0), ("processing", 1), ("received", 1), ("processing", 2), ("done", 2)]
    assert of(2) == [("received", 0), ("processing", 1), ("needs_review", 1), ("done", 1)]


def test_replays_are_dropped(spark, tmp_path):
    schema = "request_id string, ts timestamp"
    rows = run(spark, tmp_path, [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]], schema, lifecycle.first_requests, "replays")
    assert sorted(r["request_id"] for r in rows.collect()) == ["a", "b", "c"]


def test_windows_agree_with_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    last = events.agg(F.max("ts")).first()[0]
    cut = last - datetime.timedelta(hours=4)
    batches = [events.collect()]
    made = run(spark, tmp_path, batches, events.schema, lambda s: lifecycle.activity(s, F.window("ts", "1 hour")).select("w", "event_type", "n"), "hours").where(F.col("w.end") < F.lit(cut))
    want = lifecycle.activity(events, F.window("ts", "1 hour")).select("w", "event_type", "n").where(F.col("w.end") < F.lit(cut))
    plain = lambda df: sorted((r["w"]["start"], r["event_type"], r["n"]) for r in df.collect())
    assert plain(made) == plain(want) != []


def test_concurrency_has_a_limit(spark):
    calls = spark.createDataFrame([(i, "h", at(i), at(i + 3)) for i in range(6)], "call_id long, host string, start timestamp, end timestamp")
    made = {r["call_id"]: r["admitted"] for r in lifecycle.concurrency(calls, 2).collect()}
    assert made == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
