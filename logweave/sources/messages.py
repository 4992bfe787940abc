"""The message table: ``episode_id, topic, ts_ns, seq, msgtype, payload`` (JSON text), and scans over it."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.plans.session import table

PAYLOAD = "value double, k long"
#: Message types of the topics made from the events table.
TYPES = {"click": "sensor_msgs/Image", "view": "sensor_msgs/PointCloud2", "purchase": "sensor_msgs/Imu", "signup": "nav_msgs/Odometry", "error": "custom_msgs/Foo"}


def epoch_ns(column: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))") * F.lit(1000)


def _moment(ns: int) -> str:
    """The first microsecond at or after a time, as a timestamp in SQL; events have whole microseconds."""
    at = datetime(1970, 1, 1) + timedelta(microseconds=-(-ns // 1000))
    return f"TIMESTAMP_NTZ'{at.isoformat(sep=' ', timespec='microseconds')}'"


def _events(spark: SparkSession, sf_dir: str, topics: list[str] | None = None, start_ns: int | None = None, stop_ns: int | None = None) -> DataFrame:
    """The message columns of events, and ``value`` and ``k`` of their payloads."""
    events = table(spark, sf_dir, "events")
    if topics is not None:
        events = events.where(F.col("event_type").isin([t.removeprefix("/") for t in topics if t.startswith("/")]))
    for op, bound in ((">=", start_ns), ("<", stop_ns)):
        if bound is not None:
            events = events.where(f"ts {op} {_moment(bound)}")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return events.select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("episode_id"),
        F.concat(F.lit("/"), F.col("event_type")).alias("topic"),
        epoch_ns("ts").alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.element_at(kind, F.col("event_type")).alias("msgtype"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


_HEAD = ("episode_id", "topic", "ts_ns", "seq", "msgtype")


def messages(spark: SparkSession, sf_dir: str, topics: list[str] | None = None, start_ns: int | None = None, stop_ns: int | None = None) -> DataFrame:
    """Events as messages: an episode for each user, a topic for each event type.

    Topics and the half-open time range are asked of the events' own columns, so both filters reach the Parquet scan.
    """
    return _events(spark, sf_dir, topics, start_ns, stop_ns).select(*_HEAD, F.to_json(F.struct("value", "k")).alias("payload"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose payloads are structs (``payload.value``, ``payload.k``), straight from the events."""
    return _events(spark, sf_dir).select(*_HEAD, F.struct("value", "k").alias("payload"))


def decoded(frame: DataFrame, schema: str = PAYLOAD, on_failure: str = "skip") -> DataFrame:
    """Payloads as structs. Failures: ``skip`` drops the message, ``null`` keeps it without payload, ``fail`` stops the job."""
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("payload").isNotNull()
    if on_failure == "fail":
        return frame.withColumn("payload", F.when(valid, parsed).otherwise(F.raise_error(F.concat(F.lit("undecodable message "), F.col("seq").cast("string")))))
    if on_failure == "null":
        return frame.withColumn("payload", F.when(valid, parsed))
    if on_failure != "skip":
        raise ValueError(f"unknown failure policy {on_failure!r}")
    return frame.where(valid).withColumn("payload", parsed)


def decoded_by_hint(frame: DataFrame, hints: dict[str, str], on_failure: str = "warn") -> tuple[DataFrame, Observation | None]:
    """Payloads (JSON text) as the type that their topic is hinted to have, whatever their own says; others stay as they are.

    Failures: ``skip`` drops the message, ``warn`` drops and counts it (``failures`` of the observation, once the frame has
    run), ``fail`` stops the job.
    """
    if on_failure not in ("skip", "warn", "fail"):
        raise ValueError(f"unknown failure policy {on_failure!r}")
    shaped = F.col("payload")
    for topic, schema in hints.items():
        shaped = F.when(F.col("topic") == topic, F.to_json(F.from_json("payload", schema))).otherwise(shaped)
    valid, seen = F.try_parse_json("payload").isNotNull(), None
    if on_failure == "fail":
        return frame.withColumn("payload", F.when(valid, shaped).otherwise(F.raise_error(F.concat(F.lit("undecodable message "), F.col("seq").cast("string"))))), None
    if on_failure == "warn":
        seen = Observation()
        frame = frame.observe(seen, F.count_if(~valid).alias("failures"))
    return frame.where(valid).withColumn("payload", shaped), seen


def scan(frame: DataFrame, topics: list[str] | None = None, start_ns: int | None = None, stop_ns: int | None = None) -> DataFrame:
    """Messages of some topics in the half-open time range; over a stored message table both filters reach its scan."""
    if topics is not None:
        frame = frame.where(F.col("topic").isin(topics))
    if start_ns is not None:
        frame = frame.where(F.col("ts_ns") >= start_ns)
    if stop_ns is not None:
        frame = frame.where(F.col("ts_ns") < stop_ns)
    return frame


def headers(frame: DataFrame) -> DataFrame:
    """Episode, topic and time only: payloads are neither read nor decoded."""
    return frame.select("episode_id", "topic", "ts_ns", "seq")


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern (``*`` also matches ``/``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", r"\\")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob_topics(frame: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, column: str = "topic") -> DataFrame:
    """Rows whose topic matches an include pattern and no exclude pattern."""
    for patterns, keep in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.col(column).rlike(glob_regex(p))
            frame = frame.where(hit if keep else ~hit)
    return frame


def bytes_envelope(raw: Column) -> Column:
    """Undecoded bytes as JSON text that marks itself as base64."""
    return F.to_json(F.struct(F.lit(True).alias("__bytes__"), F.lit("base64").alias("encoding"), F.base64(raw).alias("value")))


def embedded_payloads(frame: DataFrame, column: str, *keys: str) -> DataFrame:
    """Every base64 envelope in a JSON text column, decoded: ``keys, position, content``; text that isn't JSON is an error."""
    text = F.when(F.col(column).isNull() | F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col(column))))
    found = F.regexp_extract_all(text, F.lit(r'"__bytes__":true,"encoding":"base64","value":"([^"]*)"'), F.lit(1))
    each = frame.select(*keys, F.posexplode(found).alias("position", "encoded"))
    return each.select(*keys, "position", F.unbase64(F.regexp_replace("encoded", r"\\r|\\n|\\/", "")).alias("content"))
