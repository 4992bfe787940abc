"""File inventories, payloads as JSON, and features that fail in each step."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.functions import features, payloads, transforms
from logweave.sources import files


@pytest.fixture
def logs(tmp_path):
    for name in ("a.mcap", "B.BAG", "note.txt", "deep/c.bag", "deep/x=1/d.mcap", "other/e.mcap"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    return tmp_path


def names(frame):
    return sorted(r["path"].rsplit("/", 1)[-1] for r in frame.collect())


def test_folders_patterns_and_paths_together(spark, logs):
    assert names(files.inventory(spark, [str(logs)])) == ["B.BAG", "a.mcap", "c.bag", "d.mcap", "e.mcap"]
    assert names(files.inventory(spark, [str(logs)], recursive=False)) == ["B.BAG", "a.mcap"]
    assert names(files.inventory(spark, [str(logs / "deep"), str(logs / "a.mcap")], recursive=False)) == ["a.mcap", "c.bag"]
    many = [str(logs / "*.mcap"), str(logs / "a.mcap"), f"{logs}/deep/../a.mcap", f"{logs}//{{other,deep}}/*", str(logs / "other")]
    assert names(files.inventory(spark, many)) == ["a.mcap", "c.bag", "d.mcap", "e.mcap"]
    assert files.inventory(spark, many).select("length").distinct().first()[0] == 5


def test_paths_that_name_nothing(spark, logs):
    for paths, kind in (([str(logs / "none.bag")], FileNotFoundError), ([str(logs / "*.none")], FileNotFoundError), ([str(logs / "note.txt")], ValueError), ([str(logs / "n*.txt")], FileNotFoundError)):
        with pytest.raises(kind):
            files.inventory(spark, paths)
    (logs / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.inventory(spark, [str(logs / "empty")])


def test_payloads_of_every_type(spark):
    shape = "v struct<f:double, g:float, b:binary, l:array<binary>, s:array<string>, m:map<int,struct<x:double,y:string>>, d:decimal(5,2), t:date, n:int, o:struct<p:array<array<double>>>, w:boolean>"
    import datetime
    import decimal

    nan, inf = float("nan"), float("inf")
    rows = [((nan, inf, b"\x00" * 90, [b"a", None], ["b", "a", None, "b"], {1: (nan, None), 2: None}, decimal.Decimal("1.50"), datetime.date(2020, 1, 2), None, ([[nan, 1.5], None],), True),), (None,), ((1.0, 2.0, None, None, [], {}, None, None, 3, None, False),)]
    frame = spark.createDataFrame(rows, shape)
    got = [r[0] for r in frame.select(payloads.payload_json(F.col("v"), frame.schema["v"].dataType, sets=("s",))).collect()]
    env = lambda x: {"__bytes__": True, "encoding": "base64", "value": x}
    assert json.loads(got[0]) == {"f": None, "g": None, "b": env("A" * 120), "l": [env("YQ=="), None], "s": ["a", "b", None], "m": {"1": {"x": None, "y": None}, "2": None}, "d": "1.50", "t": "2020-01-02", "n": None, "o": {"p": [[None, 1.5], None]}, "w": True}
    assert got[1] is None and json.loads(got[2]) == {"f": 1.0, "g": 2.0, "b": None, "l": None, "s": [], "m": {}, "d": None, "t": None, "n": 3, "o": None, "w": False}
    plain = spark.createDataFrame([(1.5, "t", [1, 2]), (nan, None, None)], "d double, s string, a array<int>")
    texts = plain.select(*[payloads.payload_json(F.col(c), plain.schema[c].dataType) for c in plain.columns]).collect()
    assert [tuple(r) for r in texts] == [("1.5", '"t"', "[1,2]"), ("null", None, None)]


def test_number_keys_of_structs_and_places_of_lists(spark):
    rows = spark.createDataFrame([('{"a":{"0":{"1":7}}}',), ('{"a":[{"1":8}]}',), ('{"a":[[5,9]]}',), ('{"a":3}',)], "payload string")
    assert [r[0] for r in rows.select(features.path("payload", "a.0.1", "long")).collect()] == [7, 8, 9, None]


def test_a_row_fails_in_each_step(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([None, [1, 2, 3, 4], [1, 2], [1, 2, 300], [1, None, 2], [0, 128, 255]])], "i int, v array<int>")
    own = [features.Feature("f", F.col("v"), [transforms.length(maximum=3)], shape=[3], dtype="bytes"), features.Feature("g", F.col("v"), dtype="float32"), features.Feature("h", F.col("v"), dtype="bool")]
    built = features.build(rows, own, "i", failures=True)
    got = sorted((r["i"], r["f__failure"], bytes(r["f"]) if r["f"] is not None else None, r["f__present"], r["g__failure"], r["h__failure"]) for r in built.collect())
    assert got == [(0, "source", None, 0, "source", "source"), (1, "transform", None, 0, None, "dtype"), (2, "shape", None, 0, None, "dtype"), (3, "dtype", None, 0, None, "dtype"), (4, "dtype", None, 0, "dtype", "dtype"), (5, None, bytes([0, 128, 255]), 1, None, "dtype")]
    counts = {(r["feature"], r["step"]): r["n"] for r in features.failure_counts(built, own).collect()}
    assert counts == {("f", "source"): 1, ("f", "transform"): 1, ("f", "shape"): 1, ("f", "dtype"): 2, ("g", "source"): 1, ("g", "dtype"): 1, ("h", "source"): 1, ("h", "dtype"): 5}


@pytest.mark.parametrize(("dtype", "kinds"), [("int64", "x"), ("float64", "xy"), ("bool", "z"), ("bytes", "b"), ("json", "xyzbt")])
def test_types_of_columns(spark, dtype, kinds):
    rows = spark.createDataFrame([(1, 1.5, True, b"1", "t")], "x long, y double, z boolean, b binary, t string")
    built = features.build(rows, [features.Feature(f"f{c}", F.col(c), dtype=dtype) for c in "xyzbt"]).first()
    assert {c for c in "xyzbt" if built[f"f{c}__present"]} == set(kinds)
