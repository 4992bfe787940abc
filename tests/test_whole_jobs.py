"""Queries over the whole tables: rows that filters of earlier queries left out."""

import base64
import json

from logweave.operators import inspection
from logweave.registry import QUERIES


def test_every_document_has_an_envelope(spark, tmp_path):
    texts = ["short", "", None, "long é " * 900, "two\nlines" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["envelope"] for r in QUERIES["src3_raw_envelope"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts))) and got[2] is None
    assert all(base64.b64decode(json.loads(got[i])["value"]).decode() == t for i, t in enumerate(texts) if t is not None)


def test_empty_lists_are_merged(spark, tmp_path):
    rows = [(i, 1, kind, float(i), '{"k": %d}' % k) for i, (kind, k) in enumerate([("click", 0), ("click", 3), ("view", 0), ("view", 1), ("error", 2)])]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    frame.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["topic"]: r["dim"] for r in QUERIES["ins4_shape_merge"](spark, str(tmp_path)).collect()}
    assert got == {"/click": 0, "/view": -1, "/error": 2}


def test_four_items_of_a_list_are_entered(spark):
    sample = spark.createDataFrame([("e", "/t", 1, 1, json.dumps({"a": [{"x": i} for i in range(6)]}))], "episode_id string, topic string, ts_ns long, seq long, payload string")
    assert {r["path"] for r in inspection.walk(sample).where("depth = 2").collect()} == {f"a.{i}" for i in range(4)}


def test_streams_give_the_last_hour_too(spark, tmp_path):
    rows = [(i, 1, kind, float(i), '{"k": 1}', at) for i, (kind, at) in enumerate([("view", "00:00:00"), ("purchase", "01:00:00"), ("view", "08:00:00"), ("purchase", "08:30:00")])]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at string")
    frame.selectExpr("* except (at)", "cast('2024-01-01 ' || at as timestamp_ntz) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["seq"] for r in QUERIES["str2_bucket_latest"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    got = sorted((r["seq"], r["match_ts_ns"]) for r in QUERIES["str3_trigger_join"](spark, str(tmp_path)).collect())
    assert [x[0] for x in got] == [1, 3] and got[1][1] - got[0][1] == 8 * 3600 * 10**9


def test_triggers_before_a_last_message_of_another_topic(spark, tmp_path):
    """The stream's watermark follows the two joined topics; what is held begins there, whatever other topics say later."""
    rows = [(i, 1, kind, float(i), '{"k": 1}', at) for i, (kind, at) in enumerate([("view", "00:00:00"), ("purchase", "08:30:00"), ("purchase", "08:59:00"), ("error", "10:00:00")])]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at string")
    frame.selectExpr("* except (at)", "cast('2024-01-01 ' || at as timestamp_ntz) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["str3_trigger_join"](spark, str(tmp_path)).collect()
    assert sorted((r["seq"], (r["ts_ns"] - r["match_ts_ns"]) // (60 * 10**9)) for r in got) == [(1, 510), (2, 539)]
