"""Inspection in one pass over the samples, and payloads of any depth."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.operators import inspection, validate
from logweave.plans.feature_queries import QUERIES, rich

DATA = "/root/testdata/sf0.001"
SHAPE = "episode_id string, topic string, ts_ns long, seq long, payload string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["drf4_draft_table", "drf3_feature_proposals", "drf1_trigger_choice", "ins6_field_candidates", "ins7_topic_report"])
def test_samples_are_read_and_sorted_once(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert plan.count("FileScan") == 1 and plan.count("Sort [") <= 1 + plan.count("WindowGroupLimit") and plan.count("Exchange") <= 2


def test_drafts_of_samples_need_two_exchanges(spark):
    plan = plan_of(inspection.drafts(inspection.first_samples(rich(spark, DATA), 4), 2))
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 1 and "Join" not in plan


def nested(depth, inside):
    for i in range(depth):
        inside = {"a": inside} if i % 2 else [0, inside]
    return inside


@pytest.mark.parametrize("depth", [1, 2, 39, 40, 400])
def test_images_at_any_depth(spark, depth):
    cases = [{"data": 1, "height": 2}, {"data": [1], "height": 2, "width": 1, "encoding": "x"}, {"data": "}{", "note": '"data":\\ "height":'}, {"data": 1, "format": 2}, {"data": 1, "is_bigendian": None}]
    frame = spark.createDataFrame([(json.dumps(nested(depth, c)),) for c in cases], "p string")
    assert [r[0] for r in frame.select(validate.ambiguous_payload(F.try_parse_json("p"))).collect()] == [True, False, False, False, True]


def test_hints_of_other_structs_do_not_count(spark):
    rows = ['{"data":{"height":1}}', '{"height":1,"x":{"data":1}}', '[{"data":1},{"step":1}]', '{"x":{"step":1},"data":1,"y":[{"format":2}]}', '{"da\\nta":1,"height":2}', "[]", "3", "null", None, "{"]
    frame = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [r[0] for r in frame.select(validate.ambiguous_payload(F.try_parse_json("p"))).collect()] == [False] * len(rows)


def plain_shape(value, items):
    if not isinstance(value, list):
        return None
    inner = [s for s in (plain_shape(x, items) for x in value[:items]) if s is not None]
    if not inner:
        return [len(value)]
    return [len(value), *(inner[0] if all(s == inner[0] for s in inner) else [-1] * len(inner[0]))]


def test_shapes_of_lists_at_any_depth(spark):
    deep = 7
    for _ in range(40):
        deep = [deep, [deep, "x]["], {"k": [1, 2]}] if _ < 5 else [deep]
    values = [[], [1, 2, 3], [[1, 2], [3]], [[1, 2], [3, 4]], [[], []], [[[1], [2]], [[3], [4]], [[5], [6]], [[7], [8]], [9]], [{"a": [1, [2]]}, [1], "[", None], ["a,b", "{}", 'q"\\'], [1, [2, [3, [4]]], [5, [6, 7]]], deep, {"no": "list"}, 4]
    rows = [("e", "/t", i, i, json.dumps({"v": v})) for i, v in enumerate(values)]
    seen = inspection.walk(spark.createDataFrame(rows, SHAPE)).where("path = 'v'").select("seq", "shape").collect()
    assert {r["seq"]: r["shape"] for r in seen} == {i: plain_shape(v, 4) for i, v in enumerate(values)}
