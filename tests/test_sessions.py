"""Sessions with state: they go on after a restart, and idle ones are forgotten."""

from __future__ import annotations

from larkspur.streaming.sessions import session_turns
from pyspark.sql import functions as F

SCHEMA = "session_id string, seq long, exam string, query string, answer string, ts string"


def run(spark, base, rows, **more):
    """The stream up to its end, from its checkpoint; what it has given so far, and the number of sessions it holds."""
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA.replace("ts string", "ts timestamp")).parquet(f"{base}/in")
    q = session_turns(stream, **more).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return {(r.session_id, r.seq): r.history_len for r in spark.read.parquet(f"{base}/out").collect()}, held


def test_a_restart_goes_on(spark, tmp_path):
    base = f"file://{tmp_path}"
    at = "2024-01-01 00:00:00"
    run(spark, base, [("s", 1, "A1", "q", "a", at), ("s", 2, "A1", "q", "a", at), ("t", 1, "A1", "q", "a", at)])
    got, _ = run(spark, base, [("s", 3, "A1", "q", "a", at), ("t", 2, "A1", "q", "", at), ("s", 4, "A1", "q", "a", at)])
    assert got == {("s", 1): 0, ("s", 2): 2, ("t", 1): 0, ("s", 3): 4, ("t", 2): 2, ("s", 4): 6}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    base, hour = f"file://{tmp_path}", {"time": "ts", "idle_ms": 3_600_000, "late": "0 seconds"}
    run(spark, base, [("s", 1, "A1", "q", "a", "2024-01-01 00:00:00"), ("s", 2, "A1", "q", "a", "2024-01-01 00:59:00"), ("t", 1, "A1", "q", "a", "2024-01-01 00:10:00")], **hour)
    # more than an hour after the last message of s; the watermark passes both timers
    got, held = run(spark, base, [("s", 3, "A1", "q", "a", "2024-01-01 02:00:00"), ("s", 4, "A1", "q", "a", "2024-01-01 02:30:00")], **hour)
    assert got == {("s", 1): 0, ("s", 2): 2, ("t", 1): 0, ("s", 3): 0, ("s", 4): 2}
    got, held = run(spark, base, [("u", 1, "A1", "q", "a", "2024-01-01 09:00:00"), ("s", 5, "A1", "q", "a", "2024-01-01 09:00:00")], **hour)
    assert got["s", 5] == 0
    _, last = run(spark, base, [("v", 1, "A1", "q", "a", "2024-01-02 09:00:00")], **hour)
    assert last[-1] < max(held + last)  # what the timers of the others have removed
