"""Drafts that are asked for: chosen topics, joins, trigger and label."""

import json

from logweave.operators import inspection
from logweave.operators.inspection import DraftRequest

SHAPE = "episode_id string, topic string, ts_ns long, seq long, payload string"


def samples(spark):
    rows = [("e", "/joy", i, i, json.dumps({"axes": [0.5, 1.0], "buttons": [1, 0]})) for i in range(3)]
    rows += [("e", "/cam", 5 + i, i, json.dumps({"data": {"__bytes__": True, "encoding": "base64", "value": "AA=="}, "height": 2})) for i in range(3)]
    rows += [("e", "/broken", 9, 9, "{"), ("e", "/pose", 10, 1, json.dumps({"x": 1, "y": 2, "z": 3}))]
    rows += [("f", "/joy", 1, 1, json.dumps({"axes": [0.5]}))]
    return spark.createDataFrame(rows, SHAPE)


def report(spark, **request):
    return {r["episode_id"]: r for r in inspection.draft_report(samples(spark), DraftRequest(**request)).collect()}


def test_without_wishes(spark):
    e = report(spark)["e"]
    assert (e["trigger"], e["joins"], e["selected"]) == ("/cam", ["/joy", "/broken", "/pose"], ["/joy", "/cam", "/broken", "/pose"])
    assert [f["name"] for f in e["features"]] == ["buttons", "axes", "image", "height", "broken", "x", "y"]
    assert e["unresolved"] == ["/broken"] and e["warnings"] == [] and e["label"] is None


def test_topics_joins_and_label(spark):
    got = report(spark, topics=("/pose", "/joy", "/none"), joins=("/cam", "/pose", "/pose"), label="axes", features_per_topic=2)
    e, f = got["e"], got["f"]
    assert (e["trigger"], e["joins"], e["selected"]) == ("/pose", ["/cam"], ["/pose", "/joy", "/cam"])
    assert e["label"].asDict() == {"name": "axes", "topic": "/joy", "path": "axes"} and e["unresolved"] == []
    assert (f["trigger"], f["joins"], f["selected"]) == ("/joy", [], ["/joy"]) and f["label"]["topic"] == "/joy"


def test_trigger_outside_the_topics_comes_first(spark):
    e = report(spark, topics=("/joy",), trigger="/pose")["e"]
    assert (e["trigger"], e["joins"], e["selected"]) == ("/pose", ["/joy"], ["/pose", "/joy"])


def test_what_a_log_lacks(spark):
    got = report(spark, trigger="/cam", label="none")
    assert got["e"]["unresolved"] == ["/broken", "none"] and "was not found" in got["e"]["warnings"][0] and got["e"]["label"] is None
    f = got["f"]
    assert f["trigger"] is None and f["features"] == [] and f["selected"] == [] and f["joins"] == [] and f["warnings"] == ["trigger topic not found: /cam"]
    assert report(spark, topics=("/none",))["e"]["warnings"] == ["no topic to draft"]


def test_roles_of_asked_drafts(spark):
    rows = inspection.drafts(samples(spark), 1, DraftRequest(topics=("/joy", "/cam"), trigger="/joy")).where("episode_id = 'e'").collect()
    assert sorted((r["topic"], r["role"], r["required"], r["name"]) for r in rows) == [("/cam", "join", False, "image"), ("/joy", "trigger", True, "buttons")]
