"""Structured Streaming twins of the profile, the downsampling and the trigger join; the first two also run on batch frames."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.plans.session import ship_package

EPISODE = "episode_id"


def topic_profile(stream: DataFrame) -> DataFrame:
    """Count, first and last time of each topic of each episode, updated as messages arrive."""
    return stream.groupBy(EPISODE, "topic").agg(F.count("*").alias("message_count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def event_time(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Add ``event_time`` (microseconds) and a watermark."""
    out = stream.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))
    return out.withWatermark("event_time", lateness) if lateness else out


def bucket_latest(stream: DataFrame, step_seconds: int, origin_seconds: int = 0, lateness: str = "1 hour") -> DataFrame:
    """Latest payload of each topic per bucket of a grid from a given origin; buckets without messages aren't emitted."""
    rows = event_time(stream, lateness)
    window = F.window("event_time", f"{step_seconds} seconds", f"{step_seconds} seconds", f"{origin_seconds % step_seconds} seconds")
    out = rows.groupBy(EPISODE, "topic", window.alias("w")).agg(F.max_by("payload", F.struct("ts_ns", "seq")).alias("payload"))
    return out.select(EPISODE, "topic", (F.unix_micros("w.start") * 1000).alias("bucket_ns"), "payload")


_OUT = f"{EPISODE} string, ts_ns long, seq long, payload string, match_ts_ns long, match string"
#: Fixed value: the state store that timers and map state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _AsOf(StatefulProcessor):
    """Messages of an episode wait by their millisecond until the watermark has passed it; then they are joined in order.

    A batch reads and writes the milliseconds of its own messages and the last joined message, whatever else waits.
    """

    def __init__(self, trigger: str) -> None:
        self.trigger = trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "messages array<struct<ts_ns:long,triggers:boolean,seq:long,payload:string>>")
        self.last = handle.getValueState("last", "ts_ns long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, new = timerValues.getCurrentWatermarkInMs(), defaultdict(list)
        for r in rows:
            ms = r["ts_ns"] // 1_000_000
            if ms >= mark:
                new[ms].append((r["ts_ns"], r["topic"] == self.trigger, r["seq"], r["payload"]))
        for ms, messages in new.items():
            if self.waiting.containsKey((ms,)):
                messages += [tuple(m) for m in self.waiting.getValue((ms,))[0]]
            else:
                self.handle.registerTimer(ms + 1)
            self.waiting.updateValue((ms,), (messages,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Timers of an episode come in the order of time."""
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        last, moved, out = (tuple(self.last.get()) if self.last.exists() else (None, None)), False, []
        order = lambda m: (m[0], m[1], m[2] is not None, m[2] or 0)
        for ts, triggers, seq, payload in sorted((tuple(m) for m in self.waiting.getValue((ms,))[0]), key=order):
            if triggers:
                out.append(Row(**dict(zip([x.split()[0] for x in _OUT.split(", ")], (key[0], ts, seq, payload, *last), strict=True))))
            else:
                last, moved = (ts, payload), True
        if moved:
            self.last.update(last)
        self.waiting.removeKey((ms,))
        return iter(out)

    def close(self) -> None:
        pass


def trigger_join(stream: DataFrame, trigger: str, topic: str, lateness: str = "1 hour") -> DataFrame:
    """Each trigger of a stream with the last-known message of another topic, once the watermark has passed it.

    State of an episode: messages the watermark has not passed, a map entry for each millisecond, and the last joined one; messages at or
    before the watermark (which begins at 1970) are late and dropped; of one time, the other topic's message counts as before the trigger.  The session's state store becomes RocksDB,
    so a stream that was begun with another store cannot go on.  The watermark follows the messages of the two topics alone: Spark moves
    a filter on topics below a watermark wherever it stands.
    """
    ship_package(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = event_time(stream.where(F.col("topic").isin(trigger, topic)), lateness)
    return rows.groupBy(EPISODE).transformWithState(_AsOf(trigger), _OUT, "append", "eventTime")
