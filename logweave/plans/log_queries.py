"""Queries of the log operators over the events and lineitem tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import align, layout, mapping, profile
from logweave.plans.session import table
from logweave.sources.messages import epoch_ns, glob_topics, headers, messages, scan, typed

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
FIELDS = {"buy": "/purchase", "look": "/view"}

#: The message table as SQL, for the oracles.
MSG = """msg AS (SELECT 'user_' || user_id AS episode_id, '/' || event_type AS topic, epoch_ns(CAST(ts AS TIMESTAMP)) AS ts_ns, event_id AS seq, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'click' THEN 'sensor_msgs/Image' WHEN 'view' THEN 'sensor_msgs/PointCloud2' WHEN 'purchase' THEN 'sensor_msgs/Imu'
        WHEN 'signup' THEN 'nav_msgs/Odometry' WHEN 'error' THEN 'custom_msgs/Foo' END AS msgtype FROM events)"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle; the SQL starts after the message table's definition."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {MSG}{sql}" if sql.lstrip().startswith(",") else f"WITH {MSG} {sql}"
        return f

    return keep


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with equal times: shipments by supplier; arrival order is the whole row's order."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supp_"), F.col("l_suppkey")).alias("episode_id"),
        F.concat(F.lit("/"), F.col("l_returnflag")).alias("topic"),
        epoch_ns("l_shipdate").alias("ts_ns"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("seq"),
        F.struct(F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("k")).alias("payload"),
    )


TIED = """, tied AS (SELECT 'supp_' || l_suppkey AS episode_id, '/' || l_returnflag AS topic, epoch_ns(CAST(l_shipdate AS TIMESTAMP)) AS ts_ns, l_extendedprice AS value,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq FROM lineitem)"""


@query("src1_message_scan", "SELECT episode_id, topic, ts_ns, seq, msgtype, value, k FROM msg")
def message_scan(spark, sf_dir):
    return typed(spark, sf_dir).select("episode_id", "topic", "ts_ns", "seq", "msgtype", "payload.value", "payload.k")


@query("src2_header_scan", "SELECT episode_id, topic, ts_ns, seq FROM msg")
def header_scan(spark, sf_dir):
    return headers(messages(spark, sf_dir))


@query("src4_topic_pushdown", "SELECT episode_id, topic, ts_ns, seq FROM msg WHERE topic IN ('/view', '/error')")
def topic_pushdown(spark, sf_dir):
    return headers(messages(spark, sf_dir, topics=["/view", "/error"]))


_T0 = 1_704_500_000_000_000_000


@query("src5_time_range", f"SELECT episode_id, topic, ts_ns, seq FROM msg WHERE ts_ns >= {_T0} AND ts_ns < {_T0 + 3 * DAY}")
def time_range(spark, sf_dir):
    return headers(messages(spark, sf_dir, start_ns=_T0, stop_ns=_T0 + 3 * DAY))


@query("src10_topic_globs", "SELECT topic, count(*) AS n FROM msg WHERE (topic GLOB '/[cp]*' OR topic GLOB '/v?ew') AND NOT topic GLOB '*ick' GROUP BY topic")
def topic_globs(spark, sf_dir):
    return glob_topics(messages(spark, sf_dir), ["/[cp]*", "/v?ew"], ["*ick"]).groupBy("topic").agg(F.count("*").alias("n"))


@query("map1_field_names", """, t AS (SELECT DISTINCT topic FROM msg UNION SELECT DISTINCT upper(topic) || '/' FROM msg UNION SELECT DISTINCT topic || '-2' FROM msg WHERE topic < '/p' UNION SELECT '//' FROM msg),
    n AS (SELECT topic, CASE WHEN topic = '//' THEN 'topic' ELSE trim(regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), '_') END AS base FROM t)
    SELECT topic, CASE WHEN topic = lower(topic) AND topic NOT LIKE '%-2' AND topic <> '//' THEN base || '_2' WHEN topic LIKE '%-2' THEN base || '_2' ELSE base END AS field FROM n""")
def field_names(spark, sf_dir):
    """Topics that differ in case, that have a number already, and that have no letters: ``/CLICK/``, ``/click`` and ``/click-2`` are click, click_2 and click_2_2."""
    topics = messages(spark, sf_dir).select("topic").distinct()
    more = topics.select(F.explode(F.array("topic", F.concat(F.upper("topic"), F.lit("/")), F.when(F.col("topic") < "/p", F.concat("topic", F.lit("-2"))), F.lit("//"))).alias("topic"))
    return mapping.field_names(more.where("topic IS NOT NULL"))


_MAPPING = {"motion": ["/twist", "/purchase", "/view"], "picture": ["/click"], "status": ["/error", "/signup"], "none": ["/absent"]}
_MAP_SQL = ", mapping(field, priority, topic) AS (VALUES ('motion', 0, '/twist'), ('motion', 1, '/purchase'), ('motion', 2, '/view'), ('picture', 0, '/click'), ('status', 0, '/error'), ('status', 1, '/signup'), ('none', 0, '/absent'))"


@query("map2_mapping_problems", _MAP_SQL + """, have AS (SELECT DISTINCT topic FROM msg)
    SELECT 'missing' AS problem, topic FROM (SELECT DISTINCT topic FROM mapping) WHERE topic NOT IN (SELECT topic FROM have)
    UNION ALL SELECT 'unmapped', topic FROM have WHERE topic NOT IN (SELECT topic FROM mapping)
    UNION ALL SELECT 'duplicate', topic FROM mapping GROUP BY topic HAVING count(DISTINCT field) > 1""")
def mapping_problems(spark, sf_dir):
    return mapping.mapping_problems(mapping.mapping_table(spark, _MAPPING), messages(spark, sf_dir))


@query("map3_first_available", _MAP_SQL + " SELECT episode_id, field, arg_min(topic, priority) AS topic FROM (SELECT DISTINCT episode_id, topic FROM msg) JOIN mapping USING (topic) GROUP BY ALL")
def first_available(spark, sf_dir):
    return mapping.resolve(mapping.mapping_table(spark, _MAPPING), profile.topic_directory(messages(spark, sf_dir)))


@query("map4_resolution_report", _MAP_SQL + """, found AS (SELECT episode_id, field, arg_min(topic, priority) AS topic FROM (SELECT DISTINCT episode_id, topic FROM msg) JOIN mapping USING (topic) GROUP BY ALL)
    SELECT e.episode_id, f.field, found.topic FROM (SELECT DISTINCT episode_id FROM msg) e, (SELECT DISTINCT field FROM mapping) f LEFT JOIN found ON found.episode_id = e.episode_id AND found.field = f.field""")
def resolution_report(spark, sf_dir):
    return mapping.resolution_report(mapping.mapping_table(spark, _MAPPING), profile.topic_directory(messages(spark, sf_dir)))


@query("row1_per_message", "SELECT episode_id, ts_ns, seq, value, k FROM msg WHERE topic = '/click'")
def per_message(spark, sf_dir):
    return align.per_message(typed(spark, sf_dir), "/click").select("episode_id", "ts_ns", "seq", "payload.value", "payload.k")


@query("row2_union_timeline", TIED + """ SELECT episode_id, ts_ns, arg_max(value, seq) FILTER (topic = '/A') AS a, arg_max(value, seq) FILTER (topic = '/R') AS r
    FROM tied WHERE topic IN ('/A', '/R') GROUP BY ALL""")
def union_timeline(spark, sf_dir):
    return align.union_timeline(tied(spark, sf_dir), {"a": "/A", "r": "/R"}).select("episode_id", "ts_ns", F.col("a.value").alias("a"), F.col("r.value").alias("r"))


@query("row3_out_of_order", TIED + """ SELECT episode_id, topic, ts_ns, previous_ts_ns FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY episode_id ORDER BY seq) AS previous_ts_ns FROM tied) WHERE previous_ts_ns > ts_ns""")
def out_of_order(spark, sf_dir):
    return align.out_of_order(tied(spark, sf_dir)).select("episode_id", "topic", "ts_ns", "previous_ts_ns")


def _down_sql(anchor: str | None) -> str:
    t0 = f"coalesce(min(ts_ns) FILTER (topic = '{anchor}'), min(ts_ns))" if anchor else "min(ts_ns)"
    return f""", m AS (SELECT * FROM msg WHERE topic IN ('/purchase', '/view')), b AS (SELECT episode_id, {t0} AS t0 FROM m GROUP BY 1),
    p AS (SELECT m.*, t0, greatest(CAST(floor((ts_ns - t0) / {HOUR}) AS BIGINT), 0) AS bucket FROM m JOIN b USING (episode_id)),
    v AS (SELECT episode_id, t0, bucket, arg_max(value, ts_ns) FILTER (topic = '/purchase') AS buy, arg_max(value, ts_ns) FILTER (topic = '/view') AS look FROM p GROUP BY ALL),
    g AS (SELECT episode_id, t0, unnest(range(0, max(bucket) + 1)) AS bucket FROM v GROUP BY 1, 2)
    SELECT g.episode_id, g.t0 + bucket * {HOUR} AS ts_ns, buy, look, CAST(buy IS NOT NULL AS INT) AS buy__present, CAST(look IS NOT NULL AS INT) AS look__present FROM g LEFT JOIN v USING (episode_id, bucket)"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("episode_id", "ts_ns", F.col("buy.value").alias("buy"), F.col("look.value").alias("look"), "buy__present", "look__present")


@query("row4_downsample_latest", _down_sql(None))
def downsample_latest(spark, sf_dir):
    return _flat(align.downsample_latest(typed(spark, sf_dir), FIELDS, HOUR))


@query("row5_downsample_anchored", _down_sql("/purchase"))
def downsample_anchored(spark, sf_dir):
    return _flat(align.downsample_latest(typed(spark, sf_dir), FIELDS, HOUR, anchor="/purchase"))


def _lerp_sql(anchor: str | None) -> str:
    t = [f"coalesce({f}(ts_ns) FILTER (topic = '{anchor}'), {f}(ts_ns))" if anchor else f"{f}(ts_ns)" for f in ("min", "max")]
    return f""", m AS (SELECT * FROM msg WHERE topic IN ('/purchase', '/view')), b AS (SELECT episode_id, {t[0]} AS t0, {t[1]} AS t1 FROM m GROUP BY 1),
    s AS (SELECT m.*, lead(ts_ns) OVER w AS hi_ns, lead(value) OVER w AS hi FROM m WINDOW w AS (PARTITION BY episode_id, topic ORDER BY ts_ns, seq)),
    g AS (SELECT episode_id, t0 + i * {HOUR} AS ts_ns FROM (SELECT episode_id, t0, unnest(range(0, CAST((t1 - t0) // {HOUR} AS BIGINT) + 1)) AS i FROM b)),
    c AS (SELECT g.episode_id, g.ts_ns, topic, CASE WHEN g.ts_ns = s.ts_ns OR hi_ns IS NULL THEN value ELSE value + (g.ts_ns - s.ts_ns) / (hi_ns - s.ts_ns) * (hi - value) END AS v
          FROM g JOIN s ON g.episode_id = s.episode_id AND g.ts_ns >= s.ts_ns AND g.ts_ns < coalesce(hi_ns, s.ts_ns + 1)),
    x AS (SELECT episode_id, ts_ns, max(v) FILTER (topic = '/purchase') AS buy, max(v) FILTER (topic = '/view') AS look FROM c GROUP BY 1, 2)
    SELECT g.episode_id, g.ts_ns, round(buy, 6) AS buy, round(look, 6) AS look, CAST(buy IS NOT NULL AS INT) AS buy__present, CAST(look IS NOT NULL AS INT) AS look__present FROM g LEFT JOIN x USING (episode_id, ts_ns)"""


def _rounded(rows: DataFrame) -> DataFrame:
    return _flat(rows).withColumns({c: F.round(c, 6) for c in ("buy", "look")})


@query("row6_interpolate", _lerp_sql(None))
def interpolate(spark, sf_dir):
    return _rounded(align.interpolate(typed(spark, sf_dir), FIELDS, HOUR))


@query("row7_interpolate_anchored", _lerp_sql("/purchase"))
def interpolate_anchored(spark, sf_dir):
    return _rounded(align.interpolate(typed(spark, sf_dir), FIELDS, HOUR, anchor="/purchase"))


@query("row8_leaf_interpolation", f""", s AS (SELECT *, lead(ts_ns) OVER w AS hi_ns, lead(value) OVER w AS hi, lead(k) OVER w AS hk FROM msg WHERE topic = '/view' WINDOW w AS (PARTITION BY episode_id ORDER BY ts_ns, seq))
    SELECT episode_id, seq, round(value + 0.25 * (hi - value), 6) AS x, round(k + 0.25 * (hk - k), 6) AS a0, round(2 * k + 0.25 * (2 * hk - 2 * k), 6) AS a1, 'n' || k AS name FROM s WHERE hi_ns IS NOT NULL""")
def leaf_interpolation(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = typed(spark, sf_dir).where("topic = '/view'")
    rows = rows.withColumn("p", F.struct(F.col("payload.value").alias("x"), F.array(F.col("payload.k"), 2 * F.col("payload.k")).alias("a"), F.concat(F.lit("n"), F.col("payload.k")).alias("name")))
    pairs = rows.withColumn("q", F.lead("p").over(W.partitionBy("episode_id").orderBy("ts_ns", "seq"))).where("q is not null")
    mid = align.lerp(F.col("p"), F.col("q"), F.lit(0.25), rows.schema["p"].dataType)
    return pairs.select("episode_id", "seq", mid.alias("m")).select("episode_id", "seq", F.round("m.x", 6).alias("x"), F.round(F.col("m.a")[0], 6).alias("a0"), F.round(F.col("m.a")[1], 6).alias("a1"), "m.name")


@query("row9_resample_bounds", """ SELECT episode_id, coalesce(min(ts_ns) FILTER (topic = '/signup'), min(ts_ns)) AS t0, coalesce(max(ts_ns) FILTER (topic = '/signup'), max(ts_ns)) AS t1 FROM msg GROUP BY 1""")
def resample_bounds(spark, sf_dir):
    return align.grid_bounds(messages(spark, sf_dir), "/signup")


def _matched(rows: DataFrame) -> DataFrame:
    return rows.select("episode_id", "ts_ns", "seq", F.coalesce("match_ts_ns", F.lit(-1)).alias("match_ts_ns"), F.col("match.value").alias("match_value"))


@query("join1_last_known_before", f""" SELECT t.episode_id, t.ts_ns, t.seq, CASE WHEN t.ts_ns - j.ts_ns <= {7 * DAY} THEN j.ts_ns ELSE -1 END AS match_ts_ns, CASE WHEN t.ts_ns - j.ts_ns <= {7 * DAY} THEN j.value END AS match_value
    FROM (SELECT * FROM msg WHERE topic = '/purchase') t ASOF LEFT JOIN (SELECT * FROM msg WHERE topic = '/view') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns""")
def last_known_before(spark, sf_dir):
    return _matched(align.asof_join(typed(spark, sf_dir), "/purchase", "/view", staleness_ns=7 * DAY))


@query("join1_long_episodes", """ SELECT t.episode_id, t.ts_ns, t.seq, coalesce(j.ts_ns, -1) AS match_ts_ns, j.value AS match_value
    FROM (SELECT * FROM msg WHERE topic = '/purchase') t ASOF LEFT JOIN (SELECT * FROM msg WHERE topic = '/view') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns""")
def long_episodes(spark, sf_dir):
    return _matched(align.asof_join_bucketed(typed(spark, sf_dir), "/purchase", "/view", 2 * DAY))


@query("join1_ties", TIED + """, t AS (SELECT * FROM tied WHERE topic = '/R'), j AS (SELECT episode_id, ts_ns, arg_max(value, seq) AS value FROM tied WHERE topic = '/A' GROUP BY ALL)
    SELECT t.episode_id, t.ts_ns, t.value, coalesce(j.ts_ns, -1) AS match_ts_ns, j.value AS match_value FROM t ASOF LEFT JOIN j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns""")
def last_known_ties(spark, sf_dir):
    return align.asof_join(tied(spark, sf_dir), "/R", "/A").select("episode_id", "ts_ns", "payload.value", F.coalesce("match_ts_ns", F.lit(-1)).alias("match_ts_ns"), F.col("match.value").alias("match_value"))


_NEAR = """, t AS (SELECT * FROM msg WHERE topic = '/purchase'), j AS (SELECT * FROM msg WHERE topic = '/view'),
    n AS (SELECT t.episode_id, t.ts_ns, t.seq, first(j.ts_ns ORDER BY abs(j.ts_ns - t.ts_ns), j.ts_ns) AS m, first(j.value ORDER BY abs(j.ts_ns - t.ts_ns), j.ts_ns) AS v FROM t JOIN j USING (episode_id) GROUP BY ALL)"""


@query("join2_nearest", _NEAR + " SELECT t.episode_id, t.ts_ns, t.seq, coalesce(m, -1) AS match_ts_ns, v AS match_value FROM t LEFT JOIN n USING (episode_id, ts_ns, seq)")
def nearest(spark, sf_dir):
    return _matched(align.asof_join(typed(spark, sf_dir), "/purchase", "/view", "nearest"))


@query("join3_within_tolerance", _NEAR + f" SELECT t.episode_id, t.ts_ns, t.seq, CASE WHEN abs(m - t.ts_ns) <= {6 * HOUR} THEN m ELSE -1 END AS match_ts_ns, CASE WHEN abs(m - t.ts_ns) <= {6 * HOUR} THEN v END AS match_value FROM t LEFT JOIN n USING (episode_id, ts_ns, seq)")
def within_tolerance(spark, sf_dir):
    return _matched(align.asof_join(typed(spark, sf_dir), "/purchase", "/view", "exact-within-tolerance", tolerance_ns=6 * HOUR))


@query("join3_exact_time", TIED + """, j AS (SELECT episode_id, ts_ns, arg_min(value, seq) AS v FROM tied WHERE topic = '/N' GROUP BY ALL)
    SELECT t.episode_id, t.ts_ns, t.value, CASE WHEN v IS NOT NULL THEN t.ts_ns ELSE -1 END AS match_ts_ns, v AS match_value FROM (SELECT * FROM tied WHERE topic = '/R') t LEFT JOIN j USING (episode_id, ts_ns)""")
def exact_time(spark, sf_dir):
    return align.asof_join(tied(spark, sf_dir), "/R", "/N", "exact-within-tolerance").select("episode_id", "ts_ns", "payload.value", F.coalesce("match_ts_ns", F.lit(-1)).alias("match_ts_ns"), F.col("match.value").alias("match_value"))


JOINS = [
    align.Join("/view", "view", staleness_ns=7 * DAY, required=True),
    align.Join("/click", "click", staleness_ns=DAY, default='{"value": 0.0, "k": -1}'),
    align.Join("/error", "error", policy="nearest", tolerance_ns=12 * HOUR, missing="zeros"),
    align.Join("/signup", "signup", policy="nearest"),
]


@query("join4_trigger_assembly", f""", t AS (SELECT * FROM msg WHERE topic = '/purchase'),
    v AS (SELECT t.seq, j.value FROM t ASOF JOIN (SELECT * FROM msg WHERE topic = '/view') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns WHERE t.ts_ns - j.ts_ns <= {7 * DAY}),
    c AS (SELECT t.seq, j.value, j.k FROM t ASOF JOIN (SELECT * FROM msg WHERE topic = '/click') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns WHERE t.ts_ns - j.ts_ns <= {DAY}),
    e AS (SELECT t.seq, first(j.value ORDER BY abs(j.ts_ns - t.ts_ns), j.ts_ns) AS value FROM t JOIN msg j ON j.episode_id = t.episode_id AND j.topic = '/error' WHERE abs(j.ts_ns - t.ts_ns) <= {12 * HOUR} GROUP BY 1),
    s AS (SELECT t.seq, first(j.value ORDER BY abs(j.ts_ns - t.ts_ns), j.ts_ns) AS value FROM t JOIN msg j ON j.episode_id = t.episode_id AND j.topic = '/signup' GROUP BY 1)
    SELECT t.episode_id, t.ts_ns, t.seq, t.value, v.value AS view_value, CAST(v.value IS NOT NULL AS INT) AS view__present, coalesce(c.value, 0.0) AS click_value, coalesce(c.k, -1) AS click_k,
        CAST(c.value IS NOT NULL AS INT) AS click__present, coalesce(e.value, 0.0) AS error_value, CAST(e.value IS NOT NULL AS INT) AS error__present, s.value AS signup_value,
        CAST(s.value IS NOT NULL AS INT) AS signup__present, v.value IS NULL AS dropped
    FROM t LEFT JOIN v USING (seq) LEFT JOIN c USING (seq) LEFT JOIN e USING (seq) LEFT JOIN s USING (seq)""")
def trigger_assembly(spark, sf_dir):
    rows = align.trigger_rows(typed(spark, sf_dir), "/purchase", JOINS)
    return rows.select("episode_id", "ts_ns", "seq", "payload.value", F.col("view.value").alias("view_value"), "view__present", F.col("click.value").alias("click_value"), F.col("click.k").alias("click_k"), "click__present", F.col("error.value").alias("error_value"), "error__present", F.col("signup.value").alias("signup_value"), "signup__present", F.col("_dropped").alias("dropped"))


_ISO = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00')"


@query("agg1_temporal_bounds", f""" SELECT episode_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS message_count, (max(ts_ns) - min(ts_ns)) / 1e9 AS duration_s,
    min({_ISO}) AS start_iso, max({_ISO}) AS end_iso FROM msg GROUP BY 1""")
def temporal_bounds(spark, sf_dir):
    return profile.temporal_bounds(messages(spark, sf_dir)).withColumns({"start_iso": profile.iso_micros(F.col("start_ns")), "end_iso": profile.iso_micros(F.col("end_ns"))})


_EVERY = ", dir AS (SELECT episode_id, topic, msgtype FROM (SELECT DISTINCT episode_id FROM msg), (SELECT DISTINCT topic, msgtype FROM msg))"
_STATS = _EVERY + """, b AS (SELECT episode_id, (max(ts_ns) - min(ts_ns)) / 1e9 AS d FROM msg GROUP BY 1),
    stats AS (SELECT dir.episode_id, dir.topic, dir.msgtype, count(msg.seq) AS message_count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,
        coalesce(CASE WHEN any_value(d) > 0 THEN round(count(msg.seq) / any_value(d), 2) END, 0.0) AS rate_hz
        FROM dir LEFT JOIN msg ON msg.episode_id = dir.episode_id AND msg.topic = dir.topic JOIN b ON b.episode_id = dir.episode_id GROUP BY 1, 2, 3)"""


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log lists the five topics, with messages or without."""
    from logweave.sources.messages import TYPES

    topics = F.explode(F.array(*[F.struct(F.lit(f"/{t}").alias("topic"), F.lit(m).alias("msgtype")) for t, m in TYPES.items()]))
    return messages(spark, sf_dir).select("episode_id").distinct().select("episode_id", topics.alias("t")).select("episode_id", "t.*")


@query("agg2_topic_stats", _STATS + " SELECT * REPLACE (coalesce(first_ns, -1) AS first_ns, coalesce(last_ns, -1) AS last_ns) FROM stats")
def topic_stats(spark, sf_dir):
    rows = profile.topic_stats(messages(spark, sf_dir), directory(spark, sf_dir))
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("first_ns", "last_ns")})


@query("agg3_log_profile", _STATS + """ SELECT s.episode_id, m.start_ns, m.end_ns, m.message_count, len(list(topic)) AS n_topics, string_agg(topic || '=' || s.message_count, ',' ORDER BY topic) AS topics
    FROM stats s JOIN (SELECT episode_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS message_count FROM msg GROUP BY 1) m USING (episode_id) GROUP BY ALL""")
def log_profile(spark, sf_dir):
    p = profile.log_profile(messages(spark, sf_dir), directory(spark, sf_dir))
    return p.select("episode_id", "start_ns", "end_ns", "message_count", F.size("topics").cast("long").alias("n_topics"), F.array_join(F.transform("topics", lambda t: F.concat(t["topic"], F.lit("="), t["message_count"].cast("string"))), ",").alias("topics"))


_CLASS = """CASE WHEN lower(msgtype) LIKE '%image%' THEN 'image' WHEN lower(msgtype) LIKE '%pointcloud%' THEN 'points' WHEN lower(msgtype) LIKE '%imu%' OR lower(msgtype) LIKE '%odometry%' THEN 'scalar_series' ELSE 'other' END"""
_FAMILY = """CASE WHEN lower(msgtype) LIKE '%image%' THEN 'camera' WHEN lower(msgtype) LIKE '%pointcloud%' THEN 'lidar' WHEN lower(msgtype) LIKE '%imu%' THEN 'imu' WHEN lower(msgtype) LIKE '%odometry%' THEN 'telemetry' ELSE 'other' END"""


@query("agg4_message_classes", f" SELECT msgtype, {_CLASS} AS modality, {_FAMILY} AS family, count(*) AS n FROM msg GROUP BY ALL")
def message_classes(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("msgtype").agg(F.count("*").alias("n")).select("msgtype", profile.modality(F.col("msgtype")).alias("modality"), profile.sensor_family(F.col("msgtype")).alias("family"), "n")


@query("agg5_topic_summary", f""", d AS (SELECT DISTINCT episode_id, topic, {_CLASS} AS m, {_FAMILY} AS f FROM msg)
    SELECT episode_id, count_if(m = 'image') AS n_image, count_if(m = 'points') AS n_points, count_if(m = 'scalar_series') AS n_scalar_series, count_if(m = 'other') AS n_other,
    count_if(f = 'camera') AS family_camera, count_if(f = 'lidar') AS family_lidar, count_if(f = 'imu') AS family_imu, count_if(f = 'telemetry') AS family_telemetry, count_if(f = 'other') AS family_other,
    count_if(m <> 'other') AS visualizable, count_if(m <> 'other') > 0 AS has_visualizable FROM d GROUP BY 1""")
def topic_summary(spark, sf_dir):
    return profile.topic_summary(profile.topic_directory(messages(spark, sf_dir)))


@query("agg6_index_payload", f""", d AS (SELECT episode_id, topic, {_CLASS} AS m, {_FAMILY} AS f, count(*) AS n FROM msg GROUP BY ALL), fam AS (SELECT episode_id, f, min(topic) AS began FROM d GROUP BY 1, 2),
    kinds AS (SELECT episode_id, coalesce(string_agg(f, ',' ORDER BY began) FILTER (f <> 'other'), 'other') AS sensor_types FROM fam GROUP BY 1)
    SELECT episode_id, episode_id || ':default' AS default_episode, string_agg(topic || ':' || m || ':' || n, ',' ORDER BY topic) AS lanes, any_value(sensor_types) AS sensor_types, CAST(sum(n) AS BIGINT) AS message_count,
    count(*) AS topic_count, count_if(m <> 'other') AS default_lane_count, CASE WHEN length(episode_id) % 2 = 0 THEN episode_id || '.bag' ELSE episode_id || '.mcap' END AS file_path, length(episode_id) AS file_size_bytes,
    CASE WHEN length(episode_id) % 2 = 0 THEN 'ROS1' ELSE 'ROS2' END AS ros_version, 'zstd' AS compression_format FROM d JOIN kinds USING (episode_id) GROUP BY 1""")
def index_payload(spark, sf_dir):
    m = messages(spark, sf_dir)
    name = F.length("episode_id")
    logs = m.select("episode_id").distinct().select("episode_id", F.concat("episode_id", F.when(name % 2 == 0, ".bag").otherwise(".mcap")).alias("path"), name.cast("long").alias("length"), F.lit("zstd").alias("compression"))
    p = profile.index_payload(m, profile.topic_directory(m), logs)
    lanes = F.array_join(F.transform("lanes", lambda x: F.concat_ws(":", x["topic"], x["modality"], x["message_count"].cast("string"))), ",").alias("lanes")
    return p.select("episode_id", "default_episode", lanes, F.array_join("sensor_types", ",").alias("sensor_types"), "message_count", "topic_count", "default_lane_count", "file_path", "file_size_bytes", "ros_version", "compression_format")


@query("agg7_index_upsert", """ SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_acctbal >= 0 THEN 'new ' || c_name WHEN c_custkey % 2 = 0 THEN 'old ' || c_name END AS payload,
    CASE WHEN c_custkey % 3 <> 0 AND c_acctbal < 0 THEN 'negative' END AS error FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0""")
def index_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("old "), F.col("c_name")).alias("payload"), F.lit(None).cast("string").alias("error"))
    new = c.where("c_custkey % 3 <> 0").select("c_custkey", F.concat(F.lit("new "), F.col("c_name")).alias("payload"), F.when(F.col("c_acctbal") < 0, "negative").alias("error"))
    return profile.upsert_index(old, new, "c_custkey", "payload", "error")


@query("agg8_modality_histogram", f""", d AS (SELECT DISTINCT topic, {_CLASS} AS modality FROM msg WHERE episode_id = (SELECT min(episode_id) FROM msg)) SELECT modality, count(*) AS n FROM d GROUP BY 1""")
def modality_histogram(spark, sf_dir):
    m = messages(spark, sf_dir)
    return profile.modality_histogram(profile.topic_directory(m), m.agg(F.min("episode_id")).first()[0])


_SPLIT = (0.7, 0.2, 0.1)
#: Largest remainders with the same double arithmetic on both sides.
_COUNTS = """, c AS (SELECT episode_id, count(*) AS n, 0.7::DOUBLE * count(*) - floor(0.7::DOUBLE * count(*)) AS r0, 0.2::DOUBLE * count(*) - floor(0.2::DOUBLE * count(*)) AS r1, 0.1::DOUBLE * count(*) - floor(0.1::DOUBLE * count(*)) AS r2,
        floor(0.7::DOUBLE * count(*))::BIGINT AS f0, floor(0.2::DOUBLE * count(*))::BIGINT AS f1, floor(0.1::DOUBLE * count(*))::BIGINT AS f2 FROM msg GROUP BY 1),
    k AS (SELECT episode_id, n, f0 + CASE WHEN (r1 > r0)::INT + (r2 > r0)::INT < n - f0 - f1 - f2 THEN 1 ELSE 0 END AS n0, f1 + CASE WHEN (r0 >= r1)::INT + (r2 > r1)::INT < n - f0 - f1 - f2 THEN 1 ELSE 0 END AS n1 FROM c)"""


@query("lay1_remainder_counts", _COUNTS + " SELECT episode_id, n, n0 AS train, n1 AS val, n - n0 - n1 AS test FROM k")
def remainder_counts(spark, sf_dir):
    rows = messages(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("n"))
    return rows.select("episode_id", "n", *[c.cast("long").alias(s) for s, c in zip(("train", "val", "test"), layout.remainder_counts(F.col("n"), _SPLIT), strict=True)])


_TIME_SPLIT = _COUNTS + """, sp AS (SELECT msg.episode_id, ts_ns, seq, CASE WHEN row_number() OVER w <= n0 THEN 'train' WHEN row_number() OVER w <= n0 + n1 THEN 'val' ELSE 'test' END AS split
    FROM msg JOIN k USING (episode_id) WINDOW w AS (PARTITION BY msg.episode_id ORDER BY ts_ns, seq))"""


@query("lay2_time_split", _TIME_SPLIT + " SELECT * FROM sp")
def time_split(spark, sf_dir):
    return layout.time_split(headers(messages(spark, sf_dir)).drop("topic"), _SPLIT)


@query("lay3_random_split_counts", _COUNTS + " SELECT episode_id, 'train' AS split, n0 AS n FROM k WHERE n0 > 0 UNION ALL SELECT episode_id, 'val', n1 FROM k WHERE n1 > 0 UNION ALL SELECT episode_id, 'test', n - n0 - n1 FROM k WHERE n > n0 + n1")
def random_split_counts(spark, sf_dir):
    return layout.split_counts(layout.random_split(headers(messages(spark, sf_dir)), _SPLIT, seed=7))


@query("lay3_random_split", _COUNTS + """ SELECT msg.episode_id, ts_ns, seq, CASE WHEN row_number() OVER w <= n0 THEN 'train' WHEN row_number() OVER w <= n0 + n1 THEN 'val' ELSE 'test' END AS split
    FROM msg JOIN k USING (episode_id) WINDOW w AS (PARTITION BY msg.episode_id ORDER BY md5(concat_ws('|', 7, msg.episode_id, ts_ns, seq)), ts_ns, seq)""")
def random_split(spark, sf_dir):
    return layout.random_split(headers(messages(spark, sf_dir)).drop("topic"), _SPLIT, seed=7)


@query("lay4_no_split", " SELECT episode_id, 'all' AS split, count(*) AS n FROM msg GROUP BY 1")
def no_split(spark, sf_dir):
    return layout.split_counts(layout.no_split(headers(messages(spark, sf_dir))))


_SHARDS = _TIME_SPLIT + ", sh AS (SELECT *, ntile(3) OVER (PARTITION BY episode_id, split ORDER BY ts_ns, seq) - 1 AS shard FROM sp)"


@query("lay5_shards", _SHARDS + " SELECT episode_id, seq, split, CAST(shard AS INT) AS shard FROM sh")
def shard_rows(spark, sf_dir):
    return layout.time_split_shards(headers(messages(spark, sf_dir)), _SPLIT, 3).select("episode_id", "seq", "split", "shard")


@query("lay6_file_names", _SHARDS + " SELECT DISTINCT episode_id || '-' || split || '-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '-of-00003.parquet' AS file FROM sh")
def file_names(spark, sf_dir):
    rows = layout.time_split_shards(headers(messages(spark, sf_dir)), _SPLIT, 3)
    return rows.select("episode_id", "split", "shard").distinct().select(layout.file_name(3, ".parquet").alias("file"))


@query("lay7_split_counts", _TIME_SPLIT + " SELECT episode_id, split, count(*) AS n FROM sp GROUP BY ALL")
def split_counts(spark, sf_dir):
    return layout.split_counts(layout.time_split(headers(messages(spark, sf_dir)), _SPLIT))
