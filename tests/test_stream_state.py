"""The streaming as-of join: late rows, ties, restarts from a checkpoint, and state that a batch leaves alone."""

import random

from logweave.streaming import twins

SHAPE = "episode_id string, topic string, ts_ns long, seq long, payload string"
MINUTE = 60 * 10**9


def drain(spark, folder, **more):
    rows = spark.readStream.schema(SHAPE).parquet(f"{folder}/in")
    q = twins.trigger_join(rows, "/t", "/j", **more).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def add(spark, folder, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def found(spark, folder):
    return sorted((r["episode_id"], r["ts_ns"] // MINUTE, r["seq"], r["match"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_late_rows_ties_and_restart(spark, tmp_path):
    add(spark, tmp_path, [("e", "/j", MINUTE, 0, "a"), ("e", "/t", 50 * MINUTE, 1, "p"), ("e", "/t", 95 * MINUTE, 2, "q"), ("e", "/other", 100 * MINUTE, 3, "x"), ("f", "/t", 10 * MINUTE, 4, "r"), ("f", "/j", 100 * MINUTE, 5, "b")])
    drain(spark, tmp_path, lateness="10 minutes")
    assert found(spark, tmp_path) == [("e", 50, 1, "a"), ("f", 10, 4, None)]  # 95 is not passed yet
    late, in_time = ("e", "/j", 60 * MINUTE, 6, "late"), ("e", "/j", 95 * MINUTE, 7, "tie")
    add(spark, tmp_path, [late, in_time, ("e", "/t", 40 * MINUTE, 8, "late trigger"), ("e", "/t", 99 * MINUTE, 9, "s"), ("f", "/t", 130 * MINUTE, 10, "u"), ("f", "/j", 200 * MINUTE, 11, "c")])
    drain(spark, tmp_path, lateness="10 minutes")
    assert found(spark, tmp_path) == [("e", 50, 1, "a"), ("e", 95, 2, "tie"), ("e", 99, 9, "tie"), ("f", 10, 4, None), ("f", 130, 10, "b")]


def test_batches_agree_with_a_plain_join(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ef"), r.choice(["/t", "/j", "/other"]), (i + 1) * MINUTE + r.randrange(3) * MINUTE, i, str(i)) for i in range(240)]
    for part in (rows[:80], rows[80:160], rows[160:]):
        add(spark, tmp_path, part)
        q = drain(spark, tmp_path, lateness="10 minutes")
    mark = (max(x[2] for x in rows) - 10 * MINUTE) // 10**6
    want = []
    for e, topic, ts, seq, _ in rows:
        if topic == "/t" and ts // 10**6 < mark:
            before = [x for x in rows if x[0] == e and x[1] == "/j" and x[2] <= ts]
            want.append((e, ts // MINUTE, seq, max(before, key=lambda x: (x[2], x[3]))[4] if before else None))
    assert found(spark, tmp_path) == sorted(want)
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsUpdated"] for s in state) < 400  # the last part alone: its messages, timers and last matches
