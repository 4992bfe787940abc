"""Queries of the record files, image payloads, rule checks and streams, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import images
from logweave.operators import align, inspection, validate
from logweave.plans.feature_queries import _SAMPLE, built
from logweave.plans.log_queries import HOUR, MSG
from logweave.plans.session import shared_folder, ship_package, table
from logweave.sources import tfrecord
from logweave.sources.files import inventory
from logweave.sources.messages import epoch_ns, messages, typed
from logweave.streaming import twins

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def new_folder(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_RECORD = "seq bigint, topic string, value float, k bigint, list array<bigint>"


@query("snk2_src14_tfrecord", f"WITH {MSG} SELECT seq, topic, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) AS value, k, k % 3 AS n, CASE WHEN k % 3 > 0 THEN k ELSE -1 END AS first FROM msg")
def records(spark, sf_dir):
    tfrecord.register(spark)
    k = F.col("payload.k")
    rows = typed(spark, sf_dir).select("seq", "topic", F.col("payload.value").cast("float").alias("value"), k.alias("k"), F.array_repeat(k, (k % 3).cast("int")).alias("list"))
    path = new_folder(spark, "records")
    rows.write.format("tfrecord").option("compression", "gzip").mode("append").save(path)
    back = spark.read.format("tfrecord").schema(_RECORD).load(path)
    return back.select("seq", "topic", F.round(F.col("value").cast("double"), 2).alias("value"), "k", F.size("list").cast("long").alias("n"), F.coalesce(F.get("list", F.lit(0)), F.lit(-1)).alias("first"))


@query("src6_file_inventory", "SELECT name, TRUE AS listed_once, TRUE AS has_bytes FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) AS t(name)")
def file_inventory(spark, sf_dir):
    """The given tables' own files, named by their folder, by patterns and by one path of its own."""
    folder = sf_dir.rstrip("/")
    found = inventory(spark, [folder, f"{folder}/*.parquet", f"{folder}/{{events,orders}}.parquet", f"{folder}/../{folder.rsplit('/', 1)[-1]}/region.parquet"], suffixes=(".parquet",))
    name = F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]+)?$", 1)
    return found.groupBy(name.alias("name")).agg((F.count("*") == F.count_distinct("path")).alias("listed_once"), (F.min("length") > 0).alias("has_bytes"))


_PIX = "list_transform(embedding, lambda x: CAST(abs(round(x * 100)) AS BIGINT) % 256)"


def pixels(spark, sf_dir) -> DataFrame:
    """Embeddings as 4 x 4 RGBA images."""
    values = F.transform("embedding", lambda x: F.abs(F.round(x.cast("double") * 100)).cast("bigint") % 256)
    ship_package(spark)
    return table(spark, sf_dir, "embeddings").select("vec_id", values.alias("list")).withColumn("data", images.pixel_bytes(F.col("list")))


_PIXD = _PIX.replace("x * 100", "x::DOUBLE * 100")


_HEX = "array_to_string(list_transform({}, lambda x: printf('%02X', CAST(x AS BIGINT))), '')"
_SIXTEEN = "list_transform(range(16), lambda i: {})"


@query("snk5_pixel_bytes", f"SELECT vec_id, {_HEX.format('p')} AS bytes, array_to_string(p, ',') AS listed FROM (SELECT vec_id, {_PIXD} AS p FROM embeddings)")
def pixel_bytes(spark, sf_dir):
    """The same pixels under both payload contracts."""
    kept = images.payload(F.col("list"), "legacy_list_v1")
    return pixels(spark, sf_dir).select("vec_id", F.hex(images.payload(F.col("list"))).alias("bytes"), F.array_join(kept.cast("array<string>"), ",").alias("listed"))


@query("trf8_color_convert", f"""SELECT vec_id, array_to_string({_SIXTEEN.format("printf('%02X%02X%02X', p[4 * i + 3], p[4 * i + 2], p[4 * i + 1])")}, '') AS bgr, array_to_string({_SIXTEEN.format("printf('%02X', CAST(floor((p[4 * i + 1] + p[4 * i + 2] + p[4 * i + 3]) / 3.0) AS BIGINT))")}, '') AS gray
    FROM (SELECT vec_id, {_PIXD} AS p FROM embeddings)""")
def color_convert(spark, sf_dir):
    """Every pixel of every image, turned and greyed."""
    side = F.lit(4)
    return pixels(spark, sf_dir).select("vec_id", *[F.hex(images.color_convert(F.col("data"), side, side, "rgba", to)).alias(to) for to in ("bgr", "gray")])


@query("trf9_image_crop", f"SELECT vec_id, {_HEX.format('list_concat(p[21:28], p[37:44])')} AS box FROM (SELECT vec_id, {_PIXD} AS p FROM embeddings)")
def image_crop(spark, sf_dir):
    """Two by two pixels from the second row and column on."""
    return pixels(spark, sf_dir).select("vec_id", F.hex(images.image_crop(F.col("data"), F.lit(4), F.lit(4), 4, (1, 1, 2, 2))).alias("box"))


@query("val3_over_budget", f"WITH {MSG}" + _SAMPLE + " SELECT episode_id, CAST(count_if(view_value__present = 0) AS BIGINT) AS bad FROM first GROUP BY 1 HAVING count_if(view_value__present = 0) > 1")
def over_budget(spark, sf_dir):
    return validate.over_budget(built(spark, sf_dir), ["view_value"], 10, 1).select("episode_id", "bad")


@query("val6_ambiguous_images", f"""WITH {MSG} SELECT seq, CASE topic WHEN '/click' THEN k % 2 = 0 WHEN '/view' THEN FALSE WHEN '/purchase' THEN k % 3 > 0 ELSE FALSE END AS ambiguous FROM msg""")
def ambiguous_images(spark, sf_dir):
    """Images whole and not, at the top, inside structs and inside lists."""
    k = F.get_json_object("payload", "$.k").cast("int")
    whole, half, packed, plain = ('{"data":[1],"height":1,"width":1,"encoding":"rgb8"}', '{"data":[1],"height":1}', '{"format":"png","data":"x","step":3}', '{"data":[1,2]}')
    made = F.when(F.col("topic") == "/click", F.when(k % 2 == 0, half).otherwise(whole)).when(F.col("topic") == "/view", packed)
    made = made.when(F.col("topic") == "/purchase", F.concat(F.lit('{"a":[1,[{"b":'), F.when(k % 3 > 0, half).otherwise(packed), F.lit("}]]}"))).otherwise(F.lit(f'{{"x":{plain}}}'))
    return messages(spark, sf_dir).select("seq", validate.ambiguous_payload(F.try_parse_json(made)).alias("ambiguous"))


@query("ins5_image_like", f"""WITH {MSG} SELECT topic, tail, kind, CASE tail WHEN 'rgb_data' THEN TRUE WHEN 'pixels' THEN contains(topic, '/Camera') OR kind IN ('bytes', 'struct') ELSE contains(topic, '/Camera') AND kind = 'bytes' END AS image
    FROM (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN '/Camera' || topic ELSE topic END AS topic FROM msg), (VALUES ('rgb_data'), ('height'), ('pixels'), ('blob')) AS t(tail), (VALUES ('int'), ('bytes'), ('struct')) AS d(kind)""")
def image_like(spark, sf_dir):
    k = F.get_json_object("payload", "$.k").cast("int")
    topics = messages(spark, sf_dir).select(F.when(k % 2 == 0, F.concat(F.lit("/Camera"), "topic")).otherwise(F.col("topic")).alias("topic")).distinct()
    tails, kinds = (F.explode(F.array(*map(F.lit, words))) for words in (("rgb_data", "height", "pixels", "blob"), ("int", "bytes", "struct")))
    each = topics.select("topic", tails.alias("tail")).select("topic", "tail", kinds.alias("kind"))
    keys = F.when(F.col("kind") == "struct", F.array(F.lit("Width"), F.lit("height"), F.lit("data"), F.lit("step")))
    return each.select("topic", "tail", "kind", inspection.is_image(F.col("topic"), F.concat(F.lit("a."), "tail"), F.col("kind"), keys).alias("image"))


def stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream of messages with text payloads."""
    source = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(sf_dir.rstrip("/") + "/events.parque[t]")
    return rows.select(F.concat(F.lit("user_"), F.col("user_id")).alias("episode_id"), F.concat(F.lit("/"), F.col("event_type")).alias("topic"), epoch_ns("ts").alias("ts_ns"), F.col("event_id").alias("seq"), F.col("value").cast("string").alias("payload"))


def drained(frame: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives once its input is read, from files in the shared folder."""
    spark = frame.sparkSession
    target, mark = new_folder(spark, "stream"), new_folder(spark, "stream-state")
    if mode == "append":
        q = frame.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start()
    else:
        q = frame.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(target)).start()
    q.awaitTermination()
    return spark.read.schema(frame.schema).parquet(target)


@query("str1_topic_profile", f"WITH {MSG} SELECT episode_id, topic, count(*) AS message_count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM msg GROUP BY 1, 2")
def stream_profile(spark, sf_dir):
    return drained(twins.topic_profile(stream(spark, sf_dir)), "complete")


def final_watermark_ms(spark, sf_dir, topics: list[str] | None = None) -> int:
    """The watermark of a drained stream: an hour before the last message (of its topics); what lies at or after it is never emitted."""
    last = messages(spark, sf_dir, topics).agg(F.max("ts_ns")).first()[0]
    return 0 if last is None else last // 1_000_000 - 3_600_000


@query("str2_bucket_latest", f"WITH {MSG} SELECT episode_id, topic, ts_ns // {6 * HOUR} * {6 * HOUR} AS bucket_ns, arg_max(seq, ts_ns) AS seq FROM msg GROUP BY ALL")
def stream_buckets(spark, sf_dir):
    """The stream's closed buckets, and those still open at its end from the batch form."""
    number = lambda rows: rows.select("episode_id", "topic", "bucket_ns", F.col("payload").cast("long").alias("seq"))
    closed = drained(twins.bucket_latest(stream(spark, sf_dir).withColumn("payload", F.col("seq").cast("string")), 6 * 3600), "append")
    rows = messages(spark, sf_dir).withColumn("payload", F.col("seq").cast("string"))
    held = twins.bucket_latest(rows, 6 * 3600).where(F.col("bucket_ns") / 1_000_000 + 6 * 3_600_000 > final_watermark_ms(spark, sf_dir))
    return number(closed).unionByName(number(held))


@query("str3_trigger_join", f"WITH {MSG} SELECT t.episode_id, t.ts_ns, t.seq, coalesce(j.ts_ns, -1) AS match_ts_ns FROM (SELECT * FROM msg WHERE topic = '/purchase') t ASOF LEFT JOIN (SELECT * FROM msg WHERE topic = '/view') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns")
def stream_join(spark, sf_dir):
    """The stream's triggers, and those it still holds at its end from the batch as-of join."""
    matched = lambda rows: rows.select("episode_id", "ts_ns", "seq", F.coalesce("match_ts_ns", F.lit(-1)).alias("match_ts_ns"))
    passed = drained(twins.trigger_join(stream(spark, sf_dir), "/purchase", "/view"), "append")
    mark = final_watermark_ms(spark, sf_dir, ["/purchase", "/view"])
    held = align.asof_join(messages(spark, sf_dir), "/purchase", "/view").where(F.expr("ts_ns div 1000000") >= mark)
    return matched(passed).unionByName(matched(held))
