"""Queries of features, transforms, validation and inspection over the message table, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import features, payloads, transforms
from logweave.operators import align, inspection, validate
from logweave.plans.log_queries import DAY, MSG, TIED, directory, tied
from logweave.plans.session import table
from logweave.sources.messages import bytes_envelope, decoded, decoded_by_hint, embedded_payloads, messages, typed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register a query and its oracle; ``plain`` SQL doesn't use the message table."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if plain else f"WITH {MSG}{sql}" if sql.lstrip().startswith(",") else f"WITH {MSG} {sql}"
        return f

    return keep


@query("src3_raw_envelope", """ SELECT doc_id, '{"__bytes__":true,"encoding":"base64","value":"' || to_base64(encode(text)) || '"}' AS envelope FROM documents""", plain=True)
def raw_envelope(spark, sf_dir):
    """Every row and its whole text; a null text has no bytes and a null envelope."""
    envelope = F.regexp_replace(bytes_envelope(F.col("text").cast("binary")), r"\\r\\n", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), envelope).alias("envelope"))


@query("src9_decode_policy", " SELECT episode_id, topic, seq, value, k FROM msg WHERE seq % 7 <> 0")
def decode_policy(spark, sf_dir):
    broken = messages(spark, sf_dir).withColumn("payload", F.when(F.col("seq") % 7 == 0, F.lit("{broken")).otherwise(F.col("payload")))
    return decoded(broken, on_failure="skip").select("episode_id", "topic", "seq", "payload.value", "payload.k")


@query("src9_type_hints", """ SELECT seq, CASE WHEN topic = '/view' THEN 'k=' || k WHEN topic = '/click' THEN 'v=' || CAST(round(value * 100) AS BIGINT) ELSE 'raw' END AS decoded FROM msg WHERE topic <> '/error'""")
def type_hints(spark, sf_dir):
    """Payloads by the types that topics are hinted to have; broken ones are left out, and counted."""
    broken = messages(spark, sf_dir).withColumn("payload", F.when(F.col("topic") == "/error", F.lit("{broken")).otherwise(F.col("payload")))
    out, _ = decoded_by_hint(broken, {"/view": "k long", "/click": "value double"}, on_failure="warn")
    k, v = F.get_json_object("payload", "$.k"), F.get_json_object("payload", "$.value")
    return out.select("seq", F.when(v.isNull(), F.concat(F.lit("k="), k)).when(k.isNull(), F.concat(F.lit("v="), F.round(v.cast("double") * 100).cast("long").cast("string"))).otherwise("raw").alias("decoded"))


@query("src11_payload_json", " SELECT seq, json_extract_string(props, '$.k') AS k_text FROM (SELECT event_id AS seq, props FROM events)")
def payload_json(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", F.get_json_object("payload", "$.k").alias("k_text"))


@query("src11_payload_normaliser", """ SELECT seq, '{"number":' || CASE WHEN seq % 3 = 0 THEN 'null' ELSE CAST(CAST(k AS DOUBLE) AS VARCHAR) END || ',"raw":' || CASE WHEN seq % 5 = 0 THEN 'null' ELSE '{"__bytes__":true,"encoding":"base64","value":"' || to_base64(encode(topic)) || '"}' END
    || ',"names":["' || CASE WHEN topic < 'b' THEN topic || '","b' ELSE 'b","' || topic END || '"],"inner":[{"far":null,"by":{"' || k || '":true}},' || CASE WHEN seq % 2 = 0 THEN 'null' ELSE '{"far":0.5,"by":{}}' END || '],"on":"1997-01-01"}' AS payload FROM msg""")
def payload_normaliser(spark, sf_dir):
    """Numbers that are none, bytes, sets, structs in lists, maps with number keys, nulls and dates."""
    k, seq = F.col("payload.k"), F.col("seq")
    number = F.when(seq % 3 == 0, F.lit(float("nan"))).otherwise(k.cast("double"))
    raw = F.when(seq % 5 != 0, F.col("topic").cast("binary"))
    first = F.struct(F.lit(float("-inf")).alias("far"), F.create_map(k, F.lit(True)).alias("by"))
    second = F.when(seq % 2 == 1, F.struct(F.lit(0.5).alias("far"), F.map_filter(F.create_map(k, F.lit(True)), lambda key, held: F.lit(False)).alias("by")))
    value = F.struct(number.alias("number"), raw.alias("raw"), F.array(F.lit("b"), "topic", F.lit("b")).alias("names"), F.array(first, second).alias("inner"), F.lit("1997-01-01").cast("date").alias("on"))
    rows = typed(spark, sf_dir).select("seq", value.alias("v"))
    return rows.select("seq", payloads.payload_json(F.col("v"), rows.schema["v"].dataType, sets=("names",)).alias("payload"))


@query("src13_embedded_payloads", """ SELECT page_id, CAST(p AS INT) AS position, CASE p WHEN 0 THEN url ELSE reverse(url) END AS content FROM pages, (VALUES (0), (1)) AS v(p)""", plain=True)
def embedded(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit('{"a":'), bytes_envelope(F.col("url").cast("binary")), F.lit(',"b":['), bytes_envelope(F.reverse("url").cast("binary")), F.lit("]}"))
    found = embedded_payloads(pages.select("page_id", text.alias("payload")), "payload", "page_id")
    return found.select("page_id", "position", F.decode("content", "UTF-8").alias("content"))


@query("fea1_path_extraction", """ SELECT seq, value AS v, k AS second, CAST(NULL AS DOUBLE) AS absent FROM msg""")
def path_extraction(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("payload", F.concat(F.lit('{"a":{"b":['), F.get_json_object("payload", "$.value"), F.lit(","), F.get_json_object("payload", "$.k"), F.lit("]}}")))
    return rows.select("seq", features.path("payload", "a.b.0", "double").alias("v"), features.path("payload", "a.b.1", "bigint").alias("second"), features.path("payload", "a.c.0", "double").alias("absent"))


@query("fea2_constant", " SELECT seq, 9 AS c, '1,2' AS list FROM msg")
def constant(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", features.constant(9).alias("c"), F.array_join(features.constant([1, 2]), ",").alias("list"))


def assembled(spark, sf_dir) -> DataFrame:
    """Triggers with two joined topics, as the later stages get them."""
    joins = [align.Join("/view", "view", staleness_ns=7 * DAY), align.Join("/click", "click", staleness_ns=DAY)]
    return align.trigger_rows(typed(spark, sf_dir), "/purchase", joins)


_ASM = f""", t AS (SELECT * FROM msg WHERE topic = '/purchase'),
    v AS (SELECT t.seq, j.value, j.k FROM t ASOF JOIN (SELECT * FROM msg WHERE topic = '/view') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns WHERE t.ts_ns - j.ts_ns <= {7 * DAY}),
    c AS (SELECT t.seq, j.value, j.k FROM t ASOF JOIN (SELECT * FROM msg WHERE topic = '/click') j ON t.episode_id = j.episode_id AND t.ts_ns >= j.ts_ns WHERE t.ts_ns - j.ts_ns <= {DAY}),
    asm AS (SELECT t.episode_id, t.ts_ns, t.seq, t.value, t.k, v.value AS vv, v.k AS vk, c.value AS cv, c.k AS ck FROM t LEFT JOIN v USING (seq) LEFT JOIN c USING (seq))"""


@query("fea3_metadata_source", _ASM + " SELECT seq, ts_ns, array_to_string(list_filter(['/click', '/view'], lambda x: (x = '/click' AND cv IS NOT NULL) OR (x = '/view' AND vv IS NOT NULL)), ',') AS present FROM asm")
def metadata_source(spark, sf_dir):
    return assembled(spark, sf_dir).select("seq", "ts_ns", F.array_join(features.present_topics({"/view": "view__present", "/click": "click__present"}), ",").alias("present"))


@query("fea4_concat_source", " SELECT seq, list_sum([value, k::DOUBLE, 9.0, value]) AS total, 4 AS n FROM msg")
def concat_source(spark, sf_dir):
    whole = features.concat(F.array("payload.value", F.col("payload.k").cast("double")), F.array(F.lit(9.0)), F.array("payload.value"))
    return typed(spark, sf_dir).select("seq", whole.alias("x")).select("seq", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("x").alias("n"))


@query("fea5_stack_source", " SELECT seq, value || '' AS first, k || '' AS last FROM (SELECT seq, k AS value, k + 3 AS k FROM msg)")
def stack_source(spark, sf_dir):
    a, b = F.array(F.col("payload.k"), F.col("payload.k") + 1), F.array(F.col("payload.k") + 2, F.col("payload.k") + 3)
    both = typed(spark, sf_dir).select("seq", features.stack(a, b).alias("rows"), features.stack(a, b, axis=1).alias("cols"))
    return both.select("seq", F.col("cols")[0][0].cast("string").alias("first"), F.col("rows")[1][1].cast("string").alias("last"))


def wanted() -> list[features.Feature]:
    """The features of the conversion."""
    return [
        features.Feature("price", F.col("payload.value"), required=True),
        features.Feature("view_value", F.when(F.col("view__present") == 1, F.col("view.value")), [transforms.clamp(10.0, 90.0), transforms.scale(0.5, 10.0)], required=True),
        features.Feature("click_bin", F.when(F.col("click__present") == 1, F.col("click.k")), [transforms.one_hot(50)], shape=[50]),
    ]


_FEA = _ASM + """, fea AS (SELECT episode_id, ts_ns, seq, value AS price, CASE WHEN vv IS NOT NULL THEN (greatest(least(vv, 90.0), 10.0) - 10.0) * 0.5 END AS view_value, CASE WHEN ck BETWEEN 0 AND 49 THEN ck END AS click_bin,
    CAST(value IS NOT NULL AS INT) AS price__present, CAST(vv IS NOT NULL AS INT) AS view_value__present, CAST(ck IS NOT NULL AND ck BETWEEN 0 AND 49 AS INT) AS click_bin__present FROM asm)"""


def built(spark, sf_dir) -> DataFrame:
    """Features over the assembled rows."""
    return features.build(assembled(spark, sf_dir), wanted(), "episode_id", "ts_ns", "seq")


@query("fea6_feature_build", _FEA + " SELECT seq, price, view_value, coalesce(click_bin, -1) AS click_bin, price__present, view_value__present, click_bin__present FROM fea")
def feature_build(spark, sf_dir):
    rows = built(spark, sf_dir)
    return rows.select("seq", "price", "view_value", F.coalesce(F.array_position("click_bin", 1) - 1, F.lit(-1)).alias("click_bin"), "price__present", "view_value__present", "click_bin__present")


_STRICT = """, strict AS (SELECT seq, CASE seq % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'transform' WHEN 2 THEN 'shape' WHEN 3 THEN 'dtype' END AS pixels_failure, CASE seq % 3 WHEN 0 THEN 'dtype' WHEN 1 THEN NULL ELSE 'source' END AS mixed_failure, k FROM msg)"""


def strict(spark, sf_dir):
    """Features of which some rows fail in each step: pixels as bytes, and a variant that must be a whole number."""
    k, turn = F.col("payload.k"), F.col("seq") % 6
    pixels = F.when(turn == 0, None).when(turn == 1, F.array_repeat(k % 256, 4)).when(turn == 2, F.array_repeat(k % 256, 2)).when(turn == 3, F.array(k % 256, F.lit(300), F.lit(0))).otherwise(F.array_repeat(k % 256, 3))
    mixed = F.when(F.col("seq") % 3 == 0, F.try_parse_json(F.lit('"text"'))).when(F.col("seq") % 3 == 1, F.try_parse_json(k.cast("string")))
    own = [features.Feature("pixels", pixels.cast("array<bigint>"), [transforms.length(maximum=3)], shape=[3], dtype="bytes"), features.Feature("mixed", mixed, dtype="int64")]
    return features.build(typed(spark, sf_dir), own, "seq", failures=True), own


@query("fea6_strict_build", _STRICT + " SELECT seq, CASE WHEN pixels_failure IS NULL THEN repeat(printf('%02X', k % 256), 3) ELSE '-' END AS pixels, CAST(pixels_failure IS NULL AS INT) AS pixels__present, coalesce(pixels_failure, '-') AS pixels_failure, coalesce(mixed_failure, '-') AS mixed_failure FROM strict")
def strict_build(spark, sf_dir):
    rows, _ = strict(spark, sf_dir)
    told = [F.coalesce(f"{c}__failure", F.lit("-")).alias(f"{c}_failure") for c in ("pixels", "mixed")]
    return rows.select("seq", F.coalesce(F.hex("pixels"), F.lit("-")).alias("pixels"), "pixels__present", *told)


@query("fea6_failure_counts", _STRICT + " SELECT 'pixels' AS feature, pixels_failure AS step, count(*) AS n FROM strict WHERE step IS NOT NULL GROUP BY ALL UNION ALL SELECT 'mixed', mixed_failure AS step, count(*) FROM strict WHERE mixed_failure IS NOT NULL GROUP BY ALL")
def failure_counts(spark, sf_dir):
    return features.failure_counts(*strict(spark, sf_dir))


@query("fea7_shape_check", " SELECT vec_id, vec_id % 4 = 2 AS flat, vec_id % 4 = 3 AS nested, vec_id % 4 = 1 AS deep FROM embeddings", plain=True)
def shape_check(spark, sf_dir):
    """Lists of 0 to 3 values, alone, in a list, and in a list of lists."""
    e = F.slice("embedding", F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", features.has_shape(e, [2]).alias("flat"), features.has_shape(F.array(e, e), [2, 3]).alias("nested"), features.has_shape(F.array(F.array(e), F.array(e)), [2, 1, 1]).alias("deep"))


@query("fea8_dtype_check", " SELECT seq, seq % 5 = 0 AS is_int, seq % 5 < 2 AS is_float, seq % 5 = 2 AS is_bool, topic IN ('/view', '/click') AND seq % 5 = 0 AS int_of_some FROM msg")
def dtype_check(spark, sf_dir):
    """Whole numbers, fractions, truth values, texts and lists in turn."""
    k, turn = F.get_json_object("payload", "$.k"), F.col("seq") % 5
    v = F.try_parse_json(F.when(turn == 0, k).when(turn == 1, F.concat(k, F.lit(".5"))).when(turn == 2, "true").when(turn == 3, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.concat(F.lit("["), k, F.lit("]"))))
    some = F.when(F.col("topic").isin("/view", "/click"), v).otherwise(F.try_parse_json(F.lit('"text"')))
    return messages(spark, sf_dir).select("seq", features.has_dtype(v, "int64").alias("is_int"), features.has_dtype(v, "float64").alias("is_float"), features.has_dtype(v, "bool").alias("is_bool"), features.has_dtype(some, "int64").alias("int_of_some"))


@query("fea9_bytes_coercion", " SELECT seq, CASE WHEN k BETWEEN 0 AND 255 THEN printf('%02X', k) || '00FF' ELSE 'none' END AS bytes FROM msg")
def bytes_coercion(spark, sf_dir):
    return typed(spark, sf_dir).select("seq", F.coalesce(F.hex(features.as_bytes(F.array(F.col("payload.k"), F.lit(0), F.lit(255)))), F.lit("none")).alias("bytes"))


@query("trf1_cast", " SELECT seq, CAST(trunc(value) AS BIGINT) AS whole, k <> 0 AS truth, CAST(k AS DOUBLE) AS real FROM msg")
def trf_cast(spark, sf_dir):
    v, k = F.col("payload.value"), F.col("payload.k")
    return typed(spark, sf_dir).select("seq", transforms.cast("int64")(v).alias("whole"), transforms.cast("bool")(k).alias("truth"), transforms.cast("float64")(k).alias("real"))


@query("trf2_length", """ WITH e AS (SELECT vec_id, embedding[1:vec_id % 64] AS v FROM embeddings) SELECT vec_id, round(CAST(coalesce(v[30], 0) AS DOUBLE), 6) AS thirtieth, 30 AS padded, CASE WHEN len(v) < 3 THEN -1 ELSE least(len(v), 10) END AS cut, len(v) = 7 AS exact FROM e""", plain=True)
def trf_length(spark, sf_dir):
    """Lists of 0 to 63 values: filled or cut to 30, cut to 10 (missing below 3), and of 7 only."""
    v = F.slice("embedding", F.lit(1), (F.col("vec_id") % 64).cast("int"))
    padded, cut = transforms.length(pad_to=30, pad_value=0.0)(v), transforms.length(truncate_to=10, minimum=3)(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(padded[29].cast("double"), 6).alias("thirtieth"), F.size(padded).alias("padded"), F.when(cut.isNull(), -1).otherwise(F.size(cut)).alias("cut"), transforms.length(exact=7)(v).isNotNull().alias("exact"))


def _total(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 4)


def _vector(name: str, sql: str, step):
    @query(name, f" SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: {sql})), 4) AS total FROM embeddings", plain=True)
    def run(spark, sf_dir):
        values = F.transform("embedding", lambda v: v.cast("double"))
        return table(spark, sf_dir, "embeddings").select("vec_id", values.alias("v")).select("vec_id", _total(step(F.col("v"))).alias("total"))

    return run


_vector("trf3_clamp", "greatest(least(x::DOUBLE, 0.1), -0.1)", transforms.clamp(-0.1, 0.1, array=True))
_vector("trf4_scale", "(x::DOUBLE - 0.5) * 3", transforms.scale(3.0, 0.5, array=True))
_vector("trf5_normalize", "(x::DOUBLE + 2) / 4", transforms.normalize(-2.0, 2.0, mean=7.0, array=True))
_vector("trf10_chain", "greatest(least((x::DOUBLE - 0.25) / 2, 0.2), -0.2)", transforms.chain(transforms.normalize(mean=0.25, std=2.0, array=True), transforms.clamp(-0.2, 0.2, array=True)))


@query("trf6_one_hot", " SELECT vec_id, label BETWEEN 0 AND 4 AS valid, CASE WHEN label BETWEEN 0 AND 4 THEN label ELSE -1 END AS at FROM embeddings", plain=True)
def trf_one_hot(spark, sf_dir):
    hot = transforms.one_hot(5)(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", hot.isNotNull().alias("valid"), F.coalesce(F.array_position(hot, 1).cast("int") - 1, F.lit(-1)).alias("at"))


@query("trf7_multi_hot", " SELECT vec_id, CASE WHEN label BETWEEN 0 AND 7 THEN CASE WHEN label = 0 THEN 1 ELSE 2 END ELSE -1 END AS ones FROM embeddings", plain=True)
def trf_multi_hot(spark, sf_dir):
    hot = transforms.multi_hot(8)(F.array(F.lit(0), F.col("label")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(hot.isNotNull(), F.aggregate(hot, F.lit(0), lambda a, b: a + b)).otherwise(-1).alias("ones"))


_SAMPLE = _FEA + ", first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts_ns, seq) AS rn FROM fea) WHERE rn <= 10)"
_NAMES = ["price", "view_value", "click_bin"]


@query("val1_missing_features", _SAMPLE + """ SELECT episode_id, feature, CAST(sum(1 - p) AS BIGINT) AS missing, count(*) AS rows, sum(1 - p) / count(*) AS rate FROM (
    SELECT episode_id, 'price' AS feature, price__present AS p FROM first UNION ALL SELECT episode_id, 'view_value', view_value__present FROM first UNION ALL SELECT episode_id, 'click_bin', click_bin__present FROM first) GROUP BY ALL""")
def val_missing_features(spark, sf_dir):
    return validate.missing_features(built(spark, sf_dir), _NAMES, 10)


@query("val2_missing_topics", _ASM + """, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts_ns, seq) AS rn FROM asm) WHERE rn <= 10)
    SELECT episode_id, topic, CAST(sum(m) AS BIGINT) AS missing, sum(m) / count(*) AS rate FROM (SELECT episode_id, '/view' AS topic, 2 * (vv IS NULL)::INT AS m FROM first UNION ALL SELECT episode_id, '/click', (cv IS NULL)::INT FROM first) GROUP BY ALL""")
def val_missing_topics(spark, sf_dir):
    return validate.missing_topics(assembled(spark, sf_dir), {"/view": ("view__present", 2), "/click": ("click__present", 1)}, 10)


@query("val3_bad_records", _SAMPLE + " SELECT episode_id, CAST(count_if(view_value__present = 0) AS BIGINT) AS bad, coalesce(min(ts_ns) FILTER (view_value__present = 0), -1) AS first_bad_ns FROM first GROUP BY 1")
def val_bad_records(spark, sf_dir):
    return validate.bad_records(built(spark, sf_dir), ["price", "view_value"], 10).withColumn("first_bad_ns", F.coalesce("first_bad_ns", F.lit(-1)))


@query("val4_label_summary", _SAMPLE + """ SELECT episode_id, CAST(count_if(view_value__present = 1) AS BIGINT) AS present, CAST(count_if(view_value__present = 0) AS BIGINT) AS missing,
    len((list(view_value ORDER BY ts_ns, seq) FILTER (view_value IS NOT NULL))[1:5]) AS n_examples FROM first GROUP BY 1""")
def val_label_summary(spark, sf_dir):
    out = validate.label_summary(built(spark, sf_dir), "view_value", 10)
    return out.select("episode_id", "present", "missing", F.when(F.size("examples") > 0, F.size("examples").cast("long")).alias("n_examples"))


@query("val5_preview", _SAMPLE + " SELECT episode_id, seq, price, view_value, view_value__present FROM first WHERE rn <= 5")
def val_preview(spark, sf_dir):
    return validate.first_rows(built(spark, sf_dir), 5).select("episode_id", "seq", "price", "view_value", "view_value__present")


@query("val5_preview_report", _SAMPLE + """, m AS (SELECT episode_id, list(seq ORDER BY ts_ns, seq)[1:3] AS seqs, count(*) AS checked, CAST(count_if(view_value__present = 0) AS BIGINT) AS bad, count_if(view_value__present = 0) / count(*) AS rate,
    bool_or(rn <= 3 AND seq % 2 = 0) AS warned FROM first GROUP BY 1) SELECT episode_id, array_to_string(seqs, ',') AS seqs, checked, bad, bad AS missing, rate, 2 * bad AS missing_topic, CAST(warned AS INT) AS warnings FROM m""")
def preview_report(spark, sf_dir):
    payload = F.when(F.col("seq") % 2 == 0, '[{"data":1,"width":2}]').otherwise('{"data":1,"format":"x"}')
    out = validate.preview(built(spark, sf_dir).withColumn("raw", payload), ["price", "view_value"], ["price", "view_value"], {"/view": ("view_value__present", 2)}, 3, 10, {"view_value": "raw"})
    return out.select("episode_id", F.array_join(F.transform("rows", lambda r: r["seq"].cast("string")), ",").alias("seqs"), "checked", "bad", F.col("missing")["view_value"].alias("missing"), F.col("rates")["view_value"].alias("rate"), F.col("missing_topics")["/view"].alias("missing_topic"), F.size("warnings").alias("warnings"))


@query("snk4_presence_encoding", _FEA + " SELECT seq, view_value__present, CASE WHEN view_value__present = 1 THEN 'kept' ELSE 'omitted' END AS state FROM fea")
def presence_encoding(spark, sf_dir):
    from logweave.sources.sinks import presence_encoded

    rows = presence_encoded(built(spark, sf_dir), ["view_value"], "seq")
    return rows.select("seq", "view_value__present", F.when(F.col("view_value").isNull(), "omitted").otherwise("kept").alias("state"))


@query("snk3_typed_flatten", " SELECT seq, ts_ns, value AS payload__value, k AS payload__k, [k, k + 1][1] AS list__first, 2 AS __sequence_length__list FROM msg")
def typed_flatten(spark, sf_dir):
    from logweave.sources.sinks import flattened

    rows = typed(spark, sf_dir).select("seq", "ts_ns", "payload", F.array("payload.k", F.col("payload.k") + 1).alias("list"))
    return flattened(rows).withColumn("list__first", F.col("list")[0]).drop("list")


@query("ins1_first_samples", " SELECT episode_id, topic, seq FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, topic ORDER BY ts_ns, seq) AS rn FROM msg) WHERE rn <= 3")
def first_samples(spark, sf_dir):
    return inspection.first_samples(messages(spark, sf_dir), 3).select("episode_id", "topic", "seq")


_INS = """, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, topic ORDER BY ts_ns, seq) AS rn FROM msg) WHERE rn <= 4)"""


def rich(spark, sf_dir):
    """The messages with payloads that differ by topic: images, lists of lists, mixed and missing values, deep structs."""
    k, value = (F.get_json_object("payload", f"$.{name}") for name in ("k", "value"))
    made = {
        "/click": ('{"image":{"data":{"__bytes__":true,"encoding":"base64","value":"AA=="},"height":2,"width":', k, "}}"),
        "/view": ('{"height":', k, ',"pose":{"x":', value, ',"tag":"t"}}'),
        "/purchase": ('{"buttons":', F.to_json(F.array_repeat(F.lit(1), k.cast("int") % 3)), ',"axes":[', value, ',0.5],"grid":[[1,2],[', k, "]]}"),
        "/signup": ('{"mixed":', F.when(k.cast("int") % 2 == 0, k).otherwise(value), ',"maybe":', F.when(k.cast("int") % 5 == 0, "null").otherwise("true"), "}"),
        "/error": ('{"deep":{"a":{"b":{"c":{"d":1}}}},"note":"text"}',),
    }
    payload = F.lit(None).cast("string")
    for topic, parts in made.items():
        payload = F.when(F.col("topic") == topic, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(payload)
    return messages(spark, sf_dir).withColumn("payload", payload)


def rich_samples(spark, sf_dir):
    return inspection.first_samples(rich(spark, sf_dir), 4)


#: What the payloads of ``rich`` hold, by the rules of inspection: a row for each field of each topic of each episode.
_RICH = _INS + """, g AS (SELECT episode_id, topic, count(*) AS n, min(k % 3) AS least, max(k % 3) AS most, count_if(k % 2 = 0) AS even, count_if(k % 5 = 0) AS nulls, min((ts_ns, seq)) AS began FROM s GROUP BY 1, 2),
    v(topic, path, kind, dtypes, shape, image_like, warning) AS (VALUES
        ('/click', 'image', 'struct', ['bytes'], NULL::INT[], TRUE, ''), ('/click', 'image.data', 'image', ['bytes'], NULL, TRUE, ''), ('/click', 'image.height', 'image', ['bytes'], NULL, TRUE, ''), ('/click', 'image.width', 'image', ['bytes'], NULL, TRUE, ''),
        ('/view', 'height', 'scalar', ['int64'], NULL, FALSE, ''), ('/view', 'pose', 'struct', ['json'], NULL, FALSE, ''), ('/view', 'pose.x', 'scalar', ['float32', 'float64'], NULL, FALSE, ''), ('/view', 'pose.tag', 'bytes', ['bytes', 'json'], NULL, FALSE, ''),
        ('/purchase', 'axes', 'sequence', ['float32', 'float64'], [2], FALSE, ''), ('/purchase', 'grid', 'sequence', ['json'], [2, -1], FALSE, ''), ('/purchase', 'grid.0', 'sequence', ['int64'], [2], FALSE, ''), ('/purchase', 'grid.1', 'sequence', ['int64'], [1], FALSE, ''),
        ('/error', 'deep', 'struct', ['json'], NULL, FALSE, ''), ('/error', 'deep.a', 'struct', ['json'], NULL, FALSE, ''), ('/error', 'deep.a.b', 'struct', ['json'], NULL, FALSE, ''), ('/error', 'deep.a.b.c', 'struct', ['json'], NULL, FALSE, 'max depth reached'), ('/error', 'note', 'bytes', ['bytes', 'json'], NULL, FALSE, '')),
    f AS (SELECT episode_id, topic, n, began, path, kind, 0 AS nulls_, dtypes, shape, image_like, 2 AS modes, warning FROM g JOIN v USING (topic)
        UNION ALL SELECT episode_id, topic, n, began, 'buttons', 'sequence', 0, CASE WHEN most > 0 THEN ['int64'] ELSE ['json'] END, [CASE WHEN least = most THEN least ELSE -1 END], FALSE, 2, CASE WHEN least < most THEN 'observed shape varies across samples' ELSE '' END FROM g WHERE topic = '/purchase'
        UNION ALL SELECT episode_id, topic, n, began, 'mixed', 'scalar', 0, CASE WHEN even = n THEN ['int64'] ELSE ['float32', 'float64'] END, NULL, FALSE, CASE WHEN even = n OR even = 0 THEN 2 ELSE 3 END, '' FROM g WHERE topic = '/signup'
        UNION ALL SELECT episode_id, topic, n, began, 'maybe', CASE WHEN nulls = n THEN 'unknown' ELSE 'scalar' END, nulls, CASE WHEN nulls = n THEN ['json'] ELSE ['bool'] END, NULL, FALSE, CASE WHEN nulls = n THEN 1 ELSE 2 END, '' FROM g WHERE topic = '/signup'),
    c AS (SELECT *, coalesce(list_contains(shape, -1), FALSE) AS variable_length, CAST(round(least(1.0, 1 - 0.15 * (modes - 1) + CASE WHEN shape IS NOT NULL AND NOT list_contains(shape, -1) THEN 0.1 ELSE 0 END), 4) AS DOUBLE) AS confidence FROM f),
    top AS (SELECT *, row_number() OVER (PARTITION BY episode_id, topic ORDER BY CASE path WHEN 'image.data' THEN 0 WHEN 'buttons' THEN 1 WHEN 'axes' THEN 2 WHEN 'image.height' THEN 16 WHEN 'image.width' THEN 16
            ELSE CASE kind WHEN 'bytes' THEN 3 WHEN 'sequence' THEN 4 WHEN 'scalar' THEN 5 ELSE 6 END END, -len(string_split(path, '.')), confidence DESC, least(n, 3), path) AS rank FROM c),
    trig AS (SELECT episode_id, arg_min(topic, (-images, -fields, -n, began)) AS topic FROM (SELECT episode_id, topic, n, began, count_if(image_like) AS images, count(*) AS fields FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1),
    prop AS (SELECT episode_id, topic, path, CASE WHEN path = 'image' THEN 'image_2' WHEN path = 'image.data' THEN 'image' ELSE replace(path, '.', '_') END AS name,
            CASE WHEN image_like THEN 'bytes' WHEN dtypes[1] = 'bytes' THEN 'json' ELSE dtypes[1] END AS dtype, CASE WHEN kind IN ('sequence', 'image') THEN shape END AS shape FROM top WHERE rank <= 2)"""
#: Lists and numbers as text, as both engines write them.
_TEXT = "array_to_string(dtypes, ',') AS dtypes, coalesce(array_to_string(shape, ','), '-') AS shape"


def texts(frame, *names):
    """Columns of lists as text, `-` for null."""
    return frame.withColumns({n: F.coalesce(F.array_join(F.col(n).cast("array<string>"), ","), F.lit("-")) for n in names})


@query("ins2_field_paths", _RICH + " SELECT episode_id, topic, path, CAST(len(string_split(path, '.')) AS INT) AS depth, n FROM c")
def field_paths(spark, sf_dir):
    return inspection.walk(rich_samples(spark, sf_dir)).groupBy("episode_id", "topic", "path", "depth").agg(F.count("*").alias("n"))


@query("ins3_scalar_kinds", _RICH + " SELECT episode_id, topic, path, kind, array_to_string(dtypes, ',') AS dtypes FROM c")
def scalar_kinds(spark, sf_dir):
    return texts(inspection.candidates(inspection.walk(rich_samples(spark, sf_dir))), "dtypes").select("episode_id", "topic", "path", "kind", "dtypes")


def _listed(rows):
    k = F.get_json_object("payload", "$.k").cast("int")
    return rows.withColumn("payload", F.to_json(F.struct(F.array_repeat(F.lit(1), k % 3).alias("list"))))


@query("ins4_shape_merge", " SELECT topic, 'list' AS path, CASE WHEN min(k % 3) = max(k % 3) THEN min(k % 3) ELSE -1 END AS dim FROM msg GROUP BY 1 HAVING count(k) > 0")
def shape_merge(spark, sf_dir):
    """Every message; an empty list has dim 0, which merges to -1 with others."""
    return _merged_dims(messages(spark, sf_dir))


def _merged_dims(rows):
    """Dims of all messages: of each episode, then of all."""
    found = inspection.candidates(inspection.walk(_listed(rows))).where("path = 'list'").select("topic", "path", F.get("shape", F.lit(0)).cast("long").alias("dim"))
    return found.groupBy("topic", "path").agg(F.when(F.min("dim") == F.max("dim"), F.min("dim")).otherwise(F.lit(-1)).alias("dim"))


@query("ins4_nested_shapes", _RICH + " SELECT episode_id, topic, path, array_to_string(shape, ',') AS shape, variable_length FROM c WHERE shape IS NOT NULL")
def nested_shapes(spark, sf_dir):
    out = inspection.candidates(inspection.walk(rich_samples(spark, sf_dir))).where("shape is not null")
    return texts(out, "shape").select("episode_id", "topic", "path", "shape", "variable_length")


@query("ins6_field_candidates", _RICH + f" SELECT episode_id, topic, path, kind, n AS observed, nulls_ > 0 AS nullable, {_TEXT}, variable_length, image_like, least(n, 3) AS n_examples, confidence, warning FROM c")
def field_candidates(spark, sf_dir):
    out = texts(inspection.candidates(inspection.walk(rich_samples(spark, sf_dir))), "dtypes", "shape")
    return out.select("episode_id", "topic", "path", "kind", "observed", "nullable", "dtypes", "shape", "variable_length", "image_like", F.size("examples").cast("long").alias("n_examples"), "confidence", F.array_join("warnings", ",").alias("warning"))


@query("ins7_topic_report", _RICH + """ SELECT s.episode_id, s.topic, count(*) AS samples, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, CAST(any_value(fields) AS INT) AS n_fields, any_value(warned) AS warned,
    CASE s.topic WHEN '/click' THEN 'image' WHEN '/view' THEN 'height,pose' WHEN '/purchase' THEN 'axes,buttons,grid' WHEN '/signup' THEN 'maybe,mixed' ELSE 'deep,note' END AS preview_keys
    FROM s JOIN (SELECT episode_id, topic, count(*) AS fields, coalesce(string_agg(DISTINCT warning, ',') FILTER (warning <> ''), '') AS warned FROM c GROUP BY 1, 2) USING (episode_id, topic) GROUP BY 1, 2""")
def topic_report(spark, sf_dir):
    keys = F.array_join(F.from_json(F.get_json_object("preview", "$.keys"), "array<string>"), ",")
    return inspection.topic_report(rich_samples(spark, sf_dir)).select("episode_id", "topic", "samples", "first_ns", "last_ns", F.size("fields").cast("int").alias("n_fields"), F.array_join("warnings", ",").alias("warned"), keys.alias("preview_keys"))


@query("drf1_trigger_choice", _RICH + " SELECT episode_id, topic FROM trig")
def trigger_choice(spark, sf_dir):
    return inspection.trigger_choice(rich_samples(spark, sf_dir))


@query("drf2_top_candidates", _RICH + " SELECT episode_id, topic, path, CAST(rank AS INT) AS rank FROM top WHERE rank <= 3")
def top_candidates(spark, sf_dir):
    out = inspection.candidates(inspection.walk(rich_samples(spark, sf_dir)))
    return inspection.top_candidates(out, 3).select("episode_id", "topic", "path", "rank")


@query("drf3_feature_proposals", _RICH + """ SELECT episode_id, topic, name, path, dtype, coalesce(array_to_string(shape, ','), '-') AS shape, CASE WHEN dtype IN ('bytes', 'json') THEN 'default' ELSE 'zeros' END AS missing,
    concat_ws(',', CASE WHEN shape[1] >= 0 THEN 'length:' || shape[1] END, CASE WHEN dtype NOT IN ('bytes', 'json') THEN 'cast:' || dtype END) AS transforms FROM prop""")
def feature_proposals(spark, sf_dir):
    out = inspection.proposals(rich_samples(spark, sf_dir), 2)
    return texts(out, "shape", "transforms").select("episode_id", "topic", "name", "path", "dtype", "shape", "missing", "transforms")


@query("drf4_draft_table", _RICH + """ SELECT p.episode_id, p.topic, name, dtype, CASE WHEN p.topic = trig.topic THEN 'trigger' ELSE 'join' END AS role, p.topic = trig.topic AS required FROM prop AS p JOIN trig ON p.episode_id = trig.episode_id""")
def draft_table(spark, sf_dir):
    return inspection.drafts(rich_samples(spark, sf_dir), 2).select("episode_id", "topic", "name", "dtype", "role", "required")


#: A request: three topics, of which one joins that is not among them, and a label that only logs with buttons have.
_REQUEST = inspection.DraftRequest(topics=("/view", "/purchase", "/none"), joins=("/signup", "/view"), label="buttons")


@query("drf4_draft_request", _RICH + """ , have AS (SELECT episode_id, bool_or(topic = '/view') AS v, bool_or(topic = '/purchase') AS p, bool_or(topic = '/signup') AS u FROM g GROUP BY 1),
    pace AS (SELECT episode_id, arg_min(topic, (-images, -fields, -n, CASE topic WHEN '/view' THEN 1 ELSE 2 END)) AS trigger FROM (SELECT episode_id, topic, n, count_if(image_like) AS images, count(*) AS fields FROM c WHERE topic IN ('/view', '/purchase') GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT h.episode_id, coalesce(trigger, '-') AS trigger, CASE WHEN trigger IS NULL THEN '' ELSE concat_ws(',', CASE WHEN u THEN '/signup' END, CASE WHEN v AND trigger <> '/view' THEN '/view' END) END AS joins,
        CASE WHEN trigger IS NULL THEN '' ELSE concat_ws(',', CASE WHEN v THEN '/view' END, CASE WHEN p THEN '/purchase' END, CASE WHEN u THEN '/signup' END) END AS selected,
        CASE WHEN trigger IS NULL THEN 0 ELSE 2 * (v::INT + p::INT + u::INT) END AS n_features, CASE WHEN p THEN '/purchase buttons' ELSE '-' END AS label, CASE WHEN trigger IS NOT NULL AND NOT p THEN 'buttons' ELSE '' END AS unresolved, (NOT coalesce(p, FALSE))::INT AS n_warnings
    FROM have h LEFT JOIN pace USING (episode_id)""")
def draft_request(spark, sf_dir):
    found = inspection.draft_report(rich_samples(spark, sf_dir), _REQUEST)
    text = lambda c: F.array_join(c, ",").alias(c)
    label = F.coalesce(F.concat_ws(" ", F.col("label.topic"), F.col("label.path")), F.lit("-"))
    return found.select("episode_id", F.coalesce("trigger", F.lit("-")).alias("trigger"), text("joins"), text("selected"), F.size("features").alias("n_features"), F.when(F.col("label").isNull(), "-").otherwise(label).alias("label"), text("unresolved"), F.size("warnings").alias("n_warnings"))
