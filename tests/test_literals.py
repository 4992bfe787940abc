"""Small message streams with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.functions import features, images, transforms
from logweave.operators import align, inspection, layout, mapping, profile, validate
from logweave.sources import files, sinks, tfrecord
from logweave.sources.messages import bytes_envelope, decoded, decoded_by_hint, embedded_payloads, glob_topics

S = 1_000_000_000


def stream(spark, rows, payload="value double"):
    data = [("e", t, ts, i, "pkg/Type", json.dumps(p)) for i, (t, ts, p) in enumerate(rows)]
    frame = spark.createDataFrame(data, "episode_id string, topic string, ts_ns long, seq long, msgtype string, payload string")
    return decoded(frame, payload)


def test_union_has_a_row_per_time(spark):
    m = stream(spark, [("/cmd", S, {"value": 1}), ("/odom", 2 * S, {"value": 5})])
    got = align.union_timeline(m, {"cmd": "/cmd", "odom": "/odom"}).orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["cmd"] and r["cmd"]["value"], r["odom"] and r["odom"]["value"]) for r in got] == [(S, 1.0, None), (2 * S, None, 5.0)]


def test_downsample_takes_the_latest(spark):
    m = stream(spark, [("/c", 0, {"value": 1}), ("/c", S // 10, {"value": 2}), ("/c", 7 * S // 10, {"value": 3})])
    got = align.downsample_latest(m, {"c": "/c"}, S // 2).orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["c"]["value"]) for r in got] == [(0, 2.0), (S // 2, 3.0)]


def test_downsample_keeps_empty_buckets_and_clamps_to_the_anchor(spark):
    m = stream(spark, [("/early", 0, {"value": 9}), ("/a", S, {"value": 1}), ("/a", 4 * S, {"value": 2})])
    got = align.downsample_latest(m, {"a": "/a", "early": "/early"}, S, anchor="/a").orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["a__present"], r["early__present"]) for r in got] == [(S, 1, 1), (2 * S, 0, 0), (3 * S, 0, 0), (4 * S, 1, 0)]


def test_interpolation_midpoint(spark):
    m = stream(spark, [("/c", 0, {"value": 0.0}), ("/c", S, {"value": 2.0})])
    got = align.interpolate(m, {"c": "/c"}, S // 2).orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["c"]["value"]) for r in got] == [(0, 0.0), (S // 2, 1.0), (S, 2.0)]


def test_interpolation_of_nested_values_and_ties(spark):
    m = stream(spark, [("/j", 0, {"axes": [0.0, 4.0], "name": "lo"}), ("/j", 0, {"axes": [2.0, 4.0], "name": "last"}), ("/j", 2 * S, {"axes": [4.0, 0.0], "name": "hi"}), ("/j", 2 * S, {"axes": [9.0, 9.0], "name": "later"})], "axes array<double>, name string")
    got = align.interpolate(m, {"j": "/j"}, S).orderBy("ts_ns").collect()
    assert [(r["j"]["axes"], r["j"]["name"]) for r in got] == [([2.0, 4.0], "last"), ([3.0, 2.0], "last"), ([9.0, 9.0], "later")]


def test_last_known_before(spark):
    m = stream(spark, [("/joy", 80, {"value": 1}), ("/t", 100, {"value": 1}), ("/t", 200, {"value": 2})])
    got = align.trigger_rows(m, "/t", [align.Join("/joy", "joy", required=True)]).orderBy("ts_ns").collect()
    assert [(r["joy"]["value"], r["joy__present"], r["_dropped"]) for r in got] == [(1.0, 1, False)] * 2


def test_asof_ties_and_policies(spark):
    m = stream(spark, [("/j", 90, {"value": 1}), ("/j", 110, {"value": 2}), ("/j", 110, {"value": 3}), ("/t", 100, {"value": 0}), ("/t", 110, {"value": 0}), ("/t", 300, {"value": 0})])
    take = lambda **k: [r["match"] and r["match"]["value"] for r in align.asof_join(m, "/t", "/j", **k).orderBy("ts_ns").collect()]
    assert take() == [1.0, 3.0, 3.0]
    assert take(policy="nearest") == [1.0, 2.0, 3.0]
    assert take(policy="exact-within-tolerance") == [None, 2.0, None]
    assert take(policy="exact-within-tolerance", tolerance_ns=10) == [1.0, 2.0, None]
    assert take(staleness_ns=9) == [None, 3.0, None]
    long = align.asof_join_bucketed(m, "/t", "/j", 50).orderBy("ts_ns").collect()
    assert [r["match"]["value"] for r in long] == [1.0, 3.0, 3.0]
    for bucket in (7, 50, 1_000):
        assert take(policy="nearest", bucket_ns=bucket) == [1.0, 2.0, 3.0]
        assert take(policy="exact-within-tolerance", tolerance_ns=10, bucket_ns=bucket) == [1.0, 2.0, None]
        assert take(policy="exact-within-tolerance", bucket_ns=bucket) == [None, 2.0, None]
    with pytest.raises(ValueError):
        align.asof_join(m, "/t", "/j", policy="other")


def test_frames_of_nearest_only_grow_and_buckets_agree(spark):
    import random

    r = random.Random(3)
    m = stream(spark, [(r.choice(["/t", "/a", "/b"]), r.randrange(400), {"value": i}) for i in range(300)])
    joins = [align.Join("/a", "a", "nearest"), align.Join("/b", "b", "nearest", tolerance_ns=5), align.Join("/b", "c", staleness_ns=9)]
    whole = sorted(map(repr, align.trigger_rows(m, "/t", joins).collect()))
    assert whole == sorted(map(repr, align.trigger_rows(m, "/t", joins, bucket_ns=11).collect())) and len(whole) > 80
    plan = align.trigger_rows(m, "/t", joins)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    from pathlib import Path

    from logweave.sources.messages import messages

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the given tables")
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    by_topic = plan(messages(spark, data, topics=["/view", "/error"]).select("seq"))
    assert "PushedFilters: [In(event_type" in by_topic or "PushedFilters: [Or(EqualTo(event_type" in by_topic
    by_time = plan(messages(spark, data, start_ns=1_704_500_000_000_000_001, stop_ns=1_704_600_000_000_000_000).select("seq"))
    assert "GreaterThanOrEqual(ts" in by_time and "LessThan(ts" in by_time


def test_datasets_are_not_written_by_one_task(spark, tmp_path):
    rows = spark.range(4000).selectExpr("'e' as episode_id", "id as ts_ns", "'all' as split", "cast(id as string) as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        sinks.write_dataset(rows, str(tmp_path / "d"), partitions=("split",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = sinks.read_dataset(spark, str(tmp_path / "d"))
    assert back.count() == 4000 and len(back.inputFiles()) > 1


def test_defaults_zeros_and_drops(spark):
    m = stream(spark, [("/t", 100, {"value": 1})])
    joins = [align.Join("/a", "a", required=True, default='{"value": 7}'), align.Join("/b", "b", missing="zeros", required=True), align.Join("/c", "c")]
    r = align.trigger_rows(m, "/t", joins).first()
    assert (r["a"]["value"], r["a__present"], r["b"]["value"], r["b__present"], r["c"], r["_dropped"]) == (7.0, 0, 0.0, 0, None, False)
    assert align.trigger_rows(m, "/t", [align.Join("/a", "a", required=True)]).first()["_dropped"]
    with pytest.raises(Exception, match="no message"):
        align.trigger_rows(m, "/t", [align.Join("/a", "a", missing="error")]).select("a").collect()


def test_time_split_and_shards(spark):
    rows = spark.createDataFrame([("e", t, t) for t in (30, 10, 20, 50, 40)], "episode_id string, ts_ns long, seq long")
    got = layout.time_split(rows, (0.4, 0.2, 0.4)).groupBy("split").agg(F.sort_array(F.collect_list("ts_ns")).alias("t")).collect()
    assert {r["split"]: r["t"] for r in got} == {"train": [10, 20], "val": [30], "test": [40, 50]}
    sizes = layout.shards(layout.no_split(rows), 3).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes] == [2, 2, 1]
    names = layout.shards(layout.no_split(rows), 3).select(layout.file_name(3, ".parquet").alias("f")).distinct().orderBy("f").collect()
    assert names[0]["f"] == "e-00000-of-00003.parquet"


def test_random_split_is_repeatable(spark):
    rows = spark.createDataFrame([("e", t, t) for t in range(50)], "episode_id string, ts_ns long, seq long")
    a, b, c = (sorted(map(tuple, layout.random_split(rows, (0.5, 0.3, 0.2), seed=s).collect())) for s in (1, 1, 2))
    assert a == b and a != c and sum(r[-1] == "train" for r in a) == 25


def test_topic_names(spark):
    frame = spark.createDataFrame([("/a/b",), ("/a_b",), ("/A-b/",), ("///",), ("/x",)], "topic string")
    got = {r["topic"]: r["field"] for r in mapping.field_names(frame).collect()}
    assert got == {"/A-b/": "a_b", "/a/b": "a_b_2", "/a_b": "a_b_3", "///": "topic", "/x": "x"}


def test_globs(spark):
    frame = spark.createDataFrame([("/camera/image",), ("/joy",), ("/tf",)], "topic string")
    assert {r["topic"] for r in glob_topics(frame, ["/camera/*", "/joy"], ["/tf"]).collect()} == {"/camera/image", "/joy"}


def test_message_classes(spark):
    types = ["sensor_msgs/Image", "sensor_msgs/msg/PointCloud2", "sensor_msgs/LaserScan", " SENSOR_MSGS/IMU ", "nav_msgs/Odometry", "x/Foo"]
    frame = spark.createDataFrame([(t,) for t in types], "t string")
    got = [(r["m"], r["f"]) for r in frame.select(profile.modality(F.col("t")).alias("m"), profile.sensor_family(F.col("t")).alias("f")).collect()]
    assert got == [("image", "camera"), ("points", "lidar"), ("points", "lidar"), ("scalar_series", "imu"), ("scalar_series", "telemetry"), ("other", "other")]


def test_decode_policies(spark):
    frame = spark.createDataFrame([("e", "/a", 1, 1, "x", '{"value": 2}'), ("e", "/a", 2, 2, "x", "{broken")], "episode_id string, topic string, ts_ns long, seq long, msgtype string, payload string")
    assert [r["payload"]["value"] for r in decoded(frame).collect()] == [2.0]
    assert decoded(frame, on_failure="null").where("payload is null").count() == 1
    with pytest.raises(Exception, match="undecodable"):
        decoded(frame, on_failure="fail").collect()


def test_type_hints_and_warnings(spark):
    frame = spark.createDataFrame([("e", "/a", 1, 1, "x", '{"value": 2, "k": 1}'), ("e", "/a", 2, 2, "x", "{broken"), ("e", "/b", 3, 3, "x", '{"k": 5}')], "episode_id string, topic string, ts_ns long, seq long, msgtype string, payload string")
    out, seen = decoded_by_hint(frame, {"/a": "k int"})
    assert sorted((r["seq"], r["payload"]) for r in out.collect()) == [(1, '{"k":1}'), (3, '{"k": 5}')] and seen.get["failures"] == 1
    with pytest.raises(Exception, match="undecodable"):
        decoded_by_hint(frame, {}, on_failure="fail")[0].collect()


def test_concat_and_stack(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [0.25, -0.25], [1.0])], "a array<double>, b array<double>, c array<double>")
    r = frame.select(features.concat(F.col("a"), F.array(F.lit(9.0))).alias("c1"), features.stack(F.col("b"), F.array(F.lit(0.0), F.lit(0.0))).alias("s0"), features.stack(F.col("a"), F.col("b"), axis=1).alias("s1"), features.stack(F.col("a"), F.col("c")).alias("bad")).first()
    assert r["c1"] == [1.0, 2.0, 9.0] and r["s0"] == [[0.25, -0.25], [0.0, 0.0]] and r["s1"] == [[1.0, 0.25], [2.0, -0.25]] and r["bad"] is None


def test_transforms(spark):
    frame = spark.createDataFrame([([1, 2, 3], 3.8, "x", 7)], "l array<int>, d double, s string, i int")
    r = frame.select(
        transforms.length(pad_to=5)(F.col("l")).alias("pad"),
        transforms.length(pad_to=2)(F.col("l")).alias("cut"),
        transforms.length(exact=4)(F.col("l")).alias("exact"),
        transforms.cast("int64")(F.col("d")).alias("whole"),
        transforms.cast("bool", source="string")(F.col("s")).alias("truth"),
        transforms.cast("int64", source="string")(F.col("s")).alias("no_int"),
        transforms.one_hot(8)(F.col("i")).alias("hot"),
        transforms.one_hot(7)(F.col("i")).alias("cold"),
        transforms.multi_hot(4)(F.col("l")).alias("multi"),
        transforms.chain(transforms.scale(2, 1, array=True), transforms.clamp(high=3, array=True))(F.col("l")).alias("chained"),
    ).first()
    assert r["pad"] == [1, 2, 3, 0, 0] and r["cut"] == [1, 2] and r["exact"] is None and r["whole"] == 3 and r["truth"] and r["no_int"] is None
    assert r["hot"] == [0] * 7 + [1] and r["cold"] is None and r["multi"] == [0, 1, 1, 1] and r["chained"] == [0, 2, 3]
    with pytest.raises(ValueError):
        transforms.normalize(1, 1)


def test_shapes(spark):
    frame = spark.createDataFrame([([[1, 2], [3, 4]],)], "x array<array<int>>")
    r = frame.select(*[features.has_shape(F.col("x"), s).alias(f"s{i}") for i, s in enumerate([[2, 2], [2, 3], [-1, 9], [], [2, -1], [3]])]).first()
    assert list(r) == [True, False, True, True, True, False]


def test_embedded_payloads(spark):
    frame = spark.createDataFrame([(1, b"\x00\xff" * 100)], "id int, raw binary")
    rows = frame.select("id", F.concat(F.lit('{"x":['), F.regexp_replace(bytes_envelope(F.col("raw")), r"\\r\\n", ""), F.lit(',{"y":'), bytes_envelope(F.lit(b"ab")), F.lit("}]}")).alias("p"))
    got = embedded_payloads(rows, "p", "id").orderBy("position").collect()
    assert [bytes(r["content"]) for r in got] == [b"\x00\xff" * 100, b"ab"]
    with pytest.raises(Exception, match="not JSON"):
        embedded_payloads(spark.createDataFrame([(1, "oops")], "id int, p string"), "p", "id").collect()


def test_flatten_and_presence(spark):
    frame = spark.sql("select 1L as ts, named_struct('v', 1, 'ok', true, '__hidden__', 5) as cmd, array(1.5D, 2D) as xs, cast(null as int) as odom")
    flat = sinks.flattened(frame)
    assert flat.columns == ["ts", "cmd__v", "cmd__ok", "__sequence_length__xs", "xs", "odom"]
    r = sinks.presence_encoded(flat, ["cmd__v", "odom"], "ts").first()
    assert (r["cmd__v__present"], r["cmd__v"], r["odom__present"], r["odom"]) == (1, 1, 0, None)
    clash = spark.sql("select 1 as a__present, cast(null as int) as a")
    with pytest.raises(Exception, match="marked present"):
        sinks.presence_encoded(clash, ["a"]).collect()


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_records_round_trip(spark, tmp_path, codec):
    tfrecord.register(spark)
    frame = spark.sql("select * from values (1L, -5L, 1.5F, 'a', X'00FF', array(1L, -2L)), (2L, null, null, '', X'', cast(array() as array<bigint>)) as t(id, n, x, s, b, l)")
    frame.write.format("tfrecord").option("compression", codec).mode("append").save(str(tmp_path / "r"))
    back = spark.read.format("tfrecord").schema(frame.schema).load(str(tmp_path / "r"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))


def test_record_checksum():
    parts = [bytes(range(256)) * k + b"x" * (k % 7) for k in (0, 1, 3, 70)]
    assert tfrecord.masked_crcs(parts) == [tfrecord.masked_crc(p) for p in parts] and tfrecord.masked_crcs([]) == []
    assert tfrecord.masked_crc(b"123456789") == ((((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF)


def test_file_classes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.bag").write_bytes(b"BZh9")
    (tmp_path / "deep" / "b.mcap").write_bytes(bytes.fromhex("28B52FFD00"))
    (tmp_path / "c.txt").write_text("no")
    got = files.inventory(spark, [str(tmp_path), str(tmp_path / "deep")]).select(files.log_family(F.col("path")).alias("f")).select("f.version").orderBy("version").collect()
    assert [r["version"] for r in got] == ["ROS1", "ROS2"]
    kinds = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(files.compression(F.col("content")).alias("c")).collect()
    assert sorted(r["c"] for r in kinds) == ["bz2", "none", "zstd"]
    with pytest.raises(FileNotFoundError):
        files.inventory(spark, [str(tmp_path)], suffixes=(".nothing",))


def test_images():
    import numpy as np

    pixels = np.arange(2 * 2 * 4, dtype=np.uint8).reshape(2, 2, 4)
    assert images.convert(pixels, "rgba", "bgr")[0, 0].tolist() == [2, 1, 0]
    assert images.convert(pixels[:, :, :3], "rgb", "bgra")[0, 0].tolist() == [2, 1, 0, 255]
    assert images.convert(pixels, "rgba", "gray")[1, 1].tolist() == [13]
    assert images.crop(pixels, 1, 0, 1, 2)[:, 0, 0].tolist() == [4, 12]
    assert images.payload_layout(["data", "format"]) == "packed" and images.payload_layout(["data", "height"]) is None
    with pytest.raises(ValueError):
        images.crop(pixels, 1, 1, 2, 2)


def test_image_payload_contracts(spark):
    frame = spark.createDataFrame([([0, 255, 7],), (None,)], "p array<int>")
    got = frame.select(images.payload(F.col("p")).alias("b"), images.payload(F.col("p"), "legacy_list_v1").alias("l")).collect()
    assert (bytes(got[0]["b"]), got[0]["l"], got[1]["b"], got[1]["l"]) == (b"\x00\xff\x07", [0, 255, 7], None, None)
    with pytest.raises(Exception, match="range 0 to 255"):
        spark.createDataFrame([([256],)], "p array<int>").select(images.payload(F.col("p"))).collect()
    with pytest.raises(ValueError):
        images.payload(F.col("p"), "other")


def test_candidates_and_drafts(spark):
    rows = [("e", "/joy", i, i, "m/Joy", json.dumps({"axes": [0.5, 1.0], "buttons": [1] * (1 + i % 2), "on": True, "pose": {"x": i}})) for i in range(4)]
    rows += [("e", "/cam", i, i, "m/Image", json.dumps({"data": {"__bytes__": True, "encoding": "base64", "value": "AA=="}, "height": 2})) for i in range(3)]
    rows += [("e", "/broken", 9, 9, "m/Broken", "{")]
    m = spark.createDataFrame(rows, "episode_id string, topic string, ts_ns long, seq long, msgtype string, payload string")
    found = {(r["topic"], r["path"]): r for r in inspection.candidates(inspection.walk(m)).collect()}
    assert found["/joy", "axes"]["dtypes"] == ["float32", "float64"] and found["/joy", "axes"]["shape"] == [2] and found["/joy", "axes"]["confidence"] == 0.95
    buttons = found["/joy", "buttons"]
    assert buttons["variable_length"] and buttons["shape"] == [-1] and buttons["dtypes"] == ["int64"] and buttons["warnings"] == ["observed shape varies across samples"]
    assert found["/joy", "on"]["dtypes"] == ["bool"] and found["/joy", "pose.x"]["dtypes"] == ["int64"] and found["/joy", "pose"]["kind"] == "struct"
    # The struct that is the payload has no path, so its keys alone don't mark a field; bytes named data do.
    assert found["/cam", "data"]["kind"] == "image" and not found["/cam", "height"]["image_like"]
    drafts = {(r["topic"], r["role"], r["name"], r["dtype"], r["missing"], r["required"]) for r in inspection.drafts(m, 1).collect()}
    assert drafts == {("/cam", "trigger", "image", "bytes", "default", True), ("/joy", "join", "buttons", "int64", "zeros", False), ("/broken", "join", "broken", "json", "default", False)}
    report = {r["topic"]: r for r in inspection.topic_report(m).collect()}
    assert report["/cam"]["times"] == [0, 1, 2] and json.loads(report["/joy"]["preview"])["keys"] == ["axes", "buttons", "on", "pose"] and report["/broken"]["fields"] is None


def test_walks_of_odd_payloads(spark):
    payloads = ["3", '"text"', "null", "[[1, 2], [3, null], {\"a\": null}, 5, [9]]", '{"l": [1, null, "x"], "deep": {"a": {"b": {"c": {"d": 1}}}}}', '{"image": [], "e": {}}']
    m = spark.createDataFrame([("e", f"/t{i}", i, i, "x", p) for i, p in enumerate(payloads)], "episode_id string, topic string, ts_ns long, seq long, msgtype string, payload string")
    got = {(r["topic"], r["path"]): (r["kind"], r["dtypes"], r["shape"], r["nullable"], r["image_like"], r["warnings"]) for r in inspection.candidates(inspection.walk(m)).collect()}
    assert got == {
        ("/t0", "__root__"): ("scalar", ["int64"], None, False, False, []),
        ("/t1", "__root__"): ("bytes", ["bytes", "json"], None, False, False, []),
        ("/t3", "0"): ("sequence", ["int64"], [2], False, False, []),
        ("/t3", "1"): ("sequence", ["int64"], [2], True, False, []),
        ("/t3", "2"): ("struct", ["json"], None, False, False, []),
        ("/t3", "2.a"): ("unknown", ["json"], None, True, False, []),
        ("/t4", "l"): ("sequence", ["json"], [3], True, False, []),
        ("/t4", "deep"): ("struct", ["json"], None, False, False, []),
        ("/t4", "deep.a"): ("struct", ["json"], None, False, False, []),
        ("/t4", "deep.a.b"): ("struct", ["json"], None, False, False, []),
        ("/t4", "deep.a.b.c"): ("struct", ["json"], None, False, False, ["max depth reached"]),
        ("/t5", "image"): ("image", ["bytes"], [0], False, True, []),
        ("/t5", "e"): ("struct", ["json"], None, False, False, []),
    }


def test_validation(spark):
    rows = spark.createDataFrame([("e", i, i, None if i < 3 else i, int(i >= 3)) for i in range(10)], "episode_id string, ts_ns long, seq long, f long, f__present int")
    r = validate.missing_features(rows, ["f"], 5).first()
    assert (r["missing"], r["rows"], r["rate"]) == (3, 5, 0.6)
    b = validate.bad_records(rows, ["f"], 5).first()
    assert (b["bad"], b["first_bad_ns"]) == (3, 0) and validate.over_budget(rows, ["f"], 5, 3).isEmpty()
    s = validate.label_summary(rows, "f", 9).first()
    assert (s["present"], s["missing"], s["examples"]) == (6, 3, ["3", "4", "5", "6", "7"])
    odd = ['{"data":1,"height":2}', '{"data":1,"format":"x"}', '{"a":[[{"b":{"data":1,"step":2}}]]}', '{"data":1}', "[]", "3", "{"]
    frame = spark.createDataFrame([(p,) for p in odd], "p string")
    assert [r["a"] for r in frame.select(validate.ambiguous_payload(F.try_parse_json("p")).alias("a")).collect()] == [True, False, True, False, False, False, False]


def test_the_rest_does_not_need_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['logweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
