"""Inspection of payloads and drafting of conversions: samples, field paths, candidates, proposals, each for every log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.mapping import numbered

EPISODE = "episode_id"
#: Words of paths and topics that carry images, last names of image contents, keys that tell an image struct.
IMAGE_PATHS = "image|rgb|bgr"
IMAGE_TOPICS = "image|camera|rgb|bgr"
IMAGE_TAILS = ("data", "pixels", "frame")
IMAGE_STRUCTS = (("width", "height", "encoding"), ("width", "height", "data"))
#: Last names of what describes an image, and types of features that have a zero.
IMAGE_METADATA = ("width", "height", "encoding", "format", "step", "stride", "channels")
ZEROED = ("int64", "float32", "float64", "bool")
#: What comes first among the fields of a topic, by kind, and what metadata of an image adds.
PRIORITIES = {"bytes": 3, "sequence": 4, "scalar": 5}
OTHER_PRIORITY, METADATA_PENALTY = 6, 10
SUMMARY_ITEMS = 8


def first_samples(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` messages of each topic of each episode (a top-n Spark prunes before the shuffle)."""
    at = F.row_number().over(W.partitionBy(EPISODE, "topic").orderBy("ts_ns", "seq"))
    return messages.withColumn("_n", at).where(F.col("_n") <= n).drop("_n")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    """What a value is: null, bool, int, float, bytes (an envelope), str, sequence or struct.

    A number of up to 18 digits is only read as a decimal if it is written with a fraction (``1.0``), so that is a float.
    """
    return _let(
        F.schema_of_variant(v),
        lambda schema: F.when(v.isNull() | (schema == "VOID"), "null")
        .when(schema.startswith("OBJECT"), F.when(F.coalesce(F.try_variant_get(v, "$.__bytes__", "boolean"), F.lit(False)), "bytes").otherwise("struct"))
        .when(schema.startswith("ARRAY"), "sequence")
        .when(schema == "BOOLEAN", "bool")
        .when(schema.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\((19|[23]\d),0\))$"), "int")
        .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .otherwise("str"),
    )


_OPEN = "array<struct<list:boolean,n:int,first:array<int>,differs:boolean>>"


def _shape(v: Column, items: int) -> Column:
    """Lengths of nested lists at any depth: where the first ``items`` differ inside, -1; null for what is no list.

    One fold over the brackets of the JSON text, with the lists and structs that are open (the innermost first): what a list
    holds so far, the shape of its first inner list, and whether another differs.
    """
    text = F.regexp_replace(F.to_json(v), r"\\.", "?")
    bare = F.regexp_replace(text, r'"[^"]*"|[^\[\]{},:"]+', "0")
    tokens = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]|0"), F.lit(0))
    frame = lambda is_list, n, first, differs: F.array(F.struct(is_list.alias("list"), n.alias("n"), first.alias("first"), differs.alias("differs")))
    behind = lambda frames: F.slice(frames, 2, F.greatest(F.size(frames), F.lit(1)))
    none, no = F.lit(None).cast("array<int>"), F.lit(False)

    def step(state: Column, token: Column) -> Column:
        frames = state["open"]
        top, rest = F.get(frames, F.lit(0)), behind(frames)
        up = F.get(rest, F.lit(0))
        counted = F.when(F.size(frames) > 0, F.concat(frame(top["list"], top["n"] + 1, top["first"], top["differs"]), rest)).otherwise(frames)
        inner = F.when(top["differs"], F.transform(top["first"], lambda _: F.lit(-1))).otherwise(F.coalesce(top["first"], F.array().cast("array<int>")))
        own = F.concat(F.array(top["n"]), inner)
        told = frame(up["list"], up["n"], F.coalesce(up["first"], own), up["differs"] | F.coalesce(up["first"] != own, no))
        closed = F.when((F.size(rest) > 0) & up["list"] & (up["n"] <= items), F.concat(told, behind(rest))).otherwise(rest)
        opened = F.concat(frame(token == "[", F.lit(0), none, no), counted)
        after = F.when(token.isin("[", "{"), opened).when(token == "0", counted).when(token == "]", closed).otherwise(rest)
        done = F.when((token == "]") & (F.size(rest) == 0), own).otherwise(state["done"])
        return F.struct(after.cast(_OPEN).alias("open"), done.alias("done"))

    start = F.struct(F.array().cast(_OPEN).alias("open"), none.alias("done"))
    return F.when(_list(v).isNotNull(), F.aggregate(tokens, start, step, lambda state: state["done"]))


def _summary(kind: Column, v: Column, keys: Column, values: Column) -> Column:
    """An example as text: scalars as they are, structs by their first keys, lists by their length and first items."""
    cut = lambda x: F.when(F.size(x) > SUMMARY_ITEMS, F.lit(True)).alias("truncated")
    return (
        F.when(kind == "struct", F.to_json(F.struct(F.lit("dict").alias("kind"), F.slice(keys, 1, SUMMARY_ITEMS).alias("keys"), cut(keys))))
        .when(kind == "sequence", F.to_json(F.struct(F.lit("list").alias("kind"), F.size(values).alias("length"), F.slice(values, 1, SUMMARY_ITEMS).alias("preview"), cut(values))))
        .when(kind == "bytes", F.to_json(v))
        .when(kind != "null", F.try_variant_get(v, "$", "string"))
    )


def is_image(topic: Column, path: Column, kind: Column, keys: Column) -> Column:
    """Whether a value looks like an image: by its path, by its last name in an image topic, as bytes, or by its keys."""
    tail = F.lower(F.substring_index(path, ".", -1))
    of_topic, of_tail = F.lower(topic).rlike(IMAGE_TOPICS), tail.isin(*IMAGE_TAILS)
    names = F.transform(keys, F.lower)
    described = reduce(lambda a, b: a | b, [F.size(F.array_intersect(names, F.array(*map(F.lit, own)))) == len(own) for own in IMAGE_STRUCTS])
    by_bytes = (kind == "bytes") & (of_tail | (tail == "image") | of_topic)
    return F.lower(path).rlike(IMAGE_PATHS) | (of_tail & of_topic) | by_bytes | F.coalesce((kind == "struct") & of_tail & described, F.lit(False))


def _children(x: Column, items: int) -> Column:
    """Paths and values inside a struct, and the structs and lists among the first items of a list."""
    below = lambda key: F.concat_ws(".", F.when(x["path"] != "", x["path"]), key).alias("path")
    fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: F.struct(below(e["key"]), e["value"].alias("v")))
    listed = F.transform(F.slice(_list(x["v"]), 1, items), lambda item, i: F.struct(below(i.cast("string")), item.alias("v")))
    inner = F.filter(listed, lambda e: _kind(e["v"]).isin("struct", "sequence"))
    kind = _kind(x["v"])
    return F.when(kind == "struct", fields).when(kind == "sequence", inner).otherwise(F.slice(fields, 1, 0))


def _observed(samples: DataFrame, max_depth: int, items: int) -> DataFrame:
    """The rows of ``walk``, and one of each sample without a path, whose example is the whole payload.

    The values of a payload are listed level by level in one row and given out once, so a sample is read and parsed once.
    """
    key = [EPISODE, "topic", "ts_ns", "seq"]
    frame = samples.select(*key, F.array(F.struct(F.lit("").alias("path"), F.try_parse_json("payload").alias("v"))).alias("l0"))
    for depth in range(max_depth):
        inside = F.transform(f"l{depth}", lambda x: F.coalesce(_children(x, items), F.slice(F.array(x), 1, 0)))
        frame = frame.withColumn(f"l{depth + 1}", F.flatten(inside))
    placed = lambda d, path: lambda x: F.struct(F.lit(d).alias("depth"), path(x).alias("path"), x["v"].alias("v"))
    whole = F.transform("l0", placed(-1, lambda x: F.lit(None).cast("string")))
    every = F.concat(whole, *[F.transform(f"l{d}", placed(d, lambda x: F.when(x["path"] == "", F.lit("__root__")).otherwise(x["path"]))) for d in range(max_depth + 1)])
    level = frame.select(*key, F.explode(every).alias("e")).select(*key, "e.depth", "e.path", "e.v")

    kind, entered, path = F.col("kind"), F.col("depth") < max_depth, F.col("path")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    named = level.withColumn("kind", _kind(F.col("v"))).withColumns({"fields": F.when(kind == "struct", fields), "values": F.when(kind == "sequence", _list(F.col("v")))})
    named = named.withColumns({"keys": F.map_keys("fields"), "first": F.slice("values", 1, items)}).withColumn("kinds", F.transform("first", _kind))
    compound = kind.isin("struct", "sequence")
    scalar = ~compound & (kind != "null")
    inner = F.filter("kinds", lambda k: ~k.isin("null", "struct", "sequence"))
    return named.where((F.col("depth") != 0) | scalar).select(
        *key,
        "path",
        "depth",
        F.when(scalar, "scalar").otherwise(kind).alias("mode"),
        F.when(scalar, F.array(kind)).when((kind == "sequence") & entered, inner).otherwise(F.array().cast("array<string>")).alias("scalars"),
        F.when(kind == "null", 1).when((kind == "sequence") & entered, F.size(F.filter("kinds", lambda k: k == "null"))).otherwise(0).alias("nulls"),
        F.when((kind == "sequence") & path.isNotNull(), _shape(F.col("v"), items)).alias("shape"),
        _summary(kind, F.col("v"), F.col("keys"), F.col("values")).alias("example"),
        (compound & ~entered).alias("deep"),
        F.coalesce((kind != "null") & is_image(F.col("topic"), path, kind, F.col("keys")), F.lit(False)).alias("image"),
    )


def walk(samples: DataFrame, max_depth: int = 4, items: int = 4) -> DataFrame:
    """One row for every value of every payload.

    ``episode_id, topic, ts_ns, seq, path, depth, mode`` (null, scalar, sequence or struct), ``scalars`` (kinds of a scalar, or of
    a list's first ``items``), ``nulls`` (it, or its first items), ``shape, example, deep`` (not entered for its depth) and
    ``image``.  Lists and structs among a list's first items are entered as ``path.0``, ...; a payload that is itself a scalar
    has the path ``__root__``.
    """
    return _observed(samples, max_depth, items).where(F.col("path").isNotNull())


def _words(*words: str) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _merged_shape(shapes: Column) -> Column:
    """The lengths that all shapes have at a level, -1 where they differ; null without shapes."""
    places = F.sequence(F.lit(0), F.array_max(F.transform(shapes, F.size)) - 1)

    def dim(i: Column) -> Column:
        return _let(F.array_distinct(F.filter(F.transform(shapes, lambda s: F.get(s, i)), lambda d: d.isNotNull())), lambda dims: F.when(F.size(dims) == 1, F.get(dims, F.lit(0))).otherwise(F.lit(-1)))

    return F.when(F.size(shapes) > 0, F.transform(places, dim))


def candidates(walked: DataFrame) -> DataFrame:
    """One row per episode, topic and path that can be a feature.

    ``kind`` (image, sequence, bytes, scalar, struct or unknown), ``observed, nullable, dtypes`` (the likeliest first), ``shape,
    variable_length, image_like, examples`` (the first three), ``confidence`` and ``warnings``.  What is gathered of a path is
    bounded by the samples of its topic.
    """
    return _fields(walked).drop("times", "began")


def _fields(walked: DataFrame) -> DataFrame:
    """``candidates``, with the times and the first place of samples where the path is null."""
    at, whole = F.struct("ts_ns", "seq", "example"), F.col("path").isNull()
    seen = walked.groupBy(EPISODE, "topic", "path").agg(
        F.count("*").alias("observed"),
        F.sum("nulls").alias("nulls"),
        F.array_sort(F.collect_set(F.when(F.col("mode") != "null", F.col("mode")))).alias("modes"),
        F.array_distinct(F.flatten(F.collect_list("scalars"))).alias("scalars"),
        F.collect_set("shape").alias("shapes"),
        F.transform(F.slice(F.array_sort(F.collect_list(at)), 1, 3), lambda x: x["example"]).alias("examples"),
        F.max("deep").alias("deep"),
        F.max("image").alias("image_like"),
        F.array_sort(F.collect_list(F.when(whole, F.col("ts_ns")))).alias("times"),
        F.array_min(F.collect_list(F.when(whole, F.struct("ts_ns", "seq")))).alias("began"),
    )
    scalars, modes, image = F.col("scalars"), F.col("modes"), F.col("image_like")
    only = lambda *kinds: F.size(F.array_except(scalars, _words(*kinds))) == 0
    dtypes = (
        F.when(image, _words("bytes"))
        .when(F.size(scalars) == 0, _words("json"))
        .when(only("bool"), _words("bool"))
        .when(only("int"), _words("int64"))
        .when(only("int", "float"), _words("float32", "float64"))
        .when(only("bytes"), _words("bytes"))
        .when(only("str"), _words("bytes", "json"))
        .otherwise(_words("json"))
    )
    has = lambda mode: F.array_contains(modes, mode)
    kind = F.when(image & (has("scalar") | has("sequence")), "image").when(has("sequence"), "sequence").when(has("scalar"), F.when(only("bytes", "str"), "bytes").otherwise("scalar")).when(has("struct"), "struct").otherwise("unknown")
    seen = seen.withColumns({"shape": _merged_shape(F.col("shapes")), "dtypes": dtypes, "kind": kind})
    variable = F.coalesce(F.array_contains("shape", -1), F.lit(False))
    several = F.size("modes") + F.greatest(F.lit(1), F.size("scalars")) - 1
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.25), 1 - 0.15 * F.greatest(F.lit(0), several)))
    warned = F.array_compact(F.array(F.when(F.col("deep"), "max depth reached"), F.when(F.size("shapes") > 1, "observed shape varies across samples")))
    return seen.select(
        EPISODE,
        "topic",
        "path",
        "kind",
        "observed",
        (F.col("nulls") > 0).alias("nullable"),
        "dtypes",
        "shape",
        variable.alias("variable_length"),
        "image_like",
        "examples",
        F.round(F.when(F.col("shape").isNotNull() & ~variable, F.least(F.lit(1.0), sure + 0.1)).otherwise(sure), 4).alias("confidence"),
        warned.alias("warnings"),
        "times",
        "began",
    )


def _found(samples: DataFrame) -> DataFrame:
    """Candidates of all topics, and one row of each topic (without a path) with its samples, times and first payload."""
    return _fields(_observed(samples, 4, 4))


def topic_report(samples: DataFrame) -> DataFrame:
    """Samples, times, first payload, candidate fields and warnings of each topic of each episode."""
    whole = F.col("path").isNull()
    of_topic = lambda value: F.first(F.when(whole, value), ignorenulls=True)
    named = F.array_sort(F.collect_list(F.when(~whole, F.struct("path", "dtypes"))))
    warned = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(~whole, F.col("warnings"))))))
    rows = _found(samples).groupBy(EPISODE, "topic").agg(of_topic(F.col("observed")).alias("samples"), of_topic(F.col("times")).alias("times"), of_topic(F.get("examples", F.lit(0))).alias("preview"), named.alias("named"), warned.alias("warned"))
    some = F.size("named") > 0
    return rows.select(EPISODE, "topic", "samples", F.array_min("times").alias("first_ns"), F.array_max("times").alias("last_ns"), "times", "preview", F.when(some, F.map_from_entries("named")).alias("fields"), F.when(some, F.col("warned")).alias("warnings"))


def _order(of: Callable[[str], Column]) -> Column:
    """What sorts the fields of a topic: contents of images, buttons, axes, bytes, lists, scalars, others; then the deepest,
    surest, those with the fewest examples, and by path."""
    path, kind = of("path"), of("kind")
    tail = F.lower(F.substring_index(path, ".", -1))
    base = F.when(tail.isin(*IMAGE_TAILS) & kind.isin("bytes", "scalar", "sequence", "image"), 0).when(path.endswith("buttons"), 1).when(path.endswith("axes"), 2)
    for name, priority in PRIORITIES.items():
        base = base.when(kind == name, priority)
    metadata = F.when(of("image_like") & tail.isin(*IMAGE_METADATA), METADATA_PENALTY).otherwise(0)
    return F.struct((base.otherwise(OTHER_PRIORITY) + metadata).alias("priority"), (-F.size(F.split(path, r"\."))).alias("levels"), (-of("confidence")).alias("doubt"), F.size(of("examples")).alias("seen"), path.alias("by"))


def top_candidates(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best fields of each topic, ``rank`` from 1, in the order of ``_order``."""
    order = W.partitionBy(EPISODE, "topic").orderBy(_order(F.col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class DraftRequest:
    """What a draft is asked for: topics (none: all), those that join (none: all but the trigger), the trigger (None: chosen), how many
    features of a topic, and the name of the feature that is the label."""

    topics: tuple[str, ...] = ()
    joins: tuple[str, ...] = ()
    trigger: str | None = None
    features_per_topic: int = 2
    label: str | None = None


def _logs(samples: DataFrame) -> DataFrame:
    """``episode_id, topics``: the topics of each log by their first samples, each with its candidates, best first.

    A sample is read once; all but the last grouping, by log, keep the partitioning of the samples.
    """
    whole = F.col("path").isNull()
    columns = ["path", "kind", "dtypes", "shape", "image_like"]
    own = F.array_sort(F.collect_list(F.when(~whole, F.struct(_order(F.col).alias("order"), *columns))))
    topics = _found(samples).groupBy(EPISODE, "topic").agg(F.first("began", ignorenulls=True).alias("began"), F.first(F.when(whole, F.col("observed")), ignorenulls=True).alias("samples"), own.alias("fields"))
    return topics.groupBy(EPISODE).agg(F.array_sort(F.collect_list(F.struct("began", "topic", "samples", "fields"))).alias("topics"))


def _chosen(samples: DataFrame, request: DraftRequest) -> DataFrame:
    """The logs with ``trigger``, ``joins`` and ``selected`` (all topics of the draft, in order); logs that lack the asked trigger, or
    have none of the topics, have a null trigger.

    The trigger sets the pace: most image-like fields, then most fields, then most samples, then the first.
    """
    have = F.transform("topics", lambda t: t["topic"])
    asked = lambda names: F.array_distinct(F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains("have", x)))
    out = _logs(samples).withColumn("have", have)
    out = out.withColumn("selected", asked(request.topics) if request.topics else F.col("have"))
    pace = lambda t: F.struct((-F.size(F.filter(t["fields"], lambda f: f["image_like"]))).alias("images"), (-F.size(t["fields"])).alias("fields"), (-t["samples"]).alias("samples"), F.array_position("selected", t["topic"]).alias("place"), t["topic"].alias("topic"))
    own = F.array_min(F.transform(F.filter("topics", lambda t: F.array_contains("selected", t["topic"])), pace))["topic"]
    trigger = own if request.trigger is None else F.when(F.array_contains("have", request.trigger) & (F.size("selected") > 0), F.lit(request.trigger))
    out = out.withColumn("trigger", trigger)
    out = out.withColumn("selected", F.when(F.array_contains("selected", F.col("trigger")), F.col("selected")).otherwise(F.concat(F.array("trigger"), "selected")))
    out = out.withColumn("joins", F.filter(asked(request.joins) if request.joins else F.col("selected"), lambda x: x != F.col("trigger")))
    return out.withColumn("selected", F.array_distinct(F.concat("selected", "joins"))).drop("have")


def trigger_choice(samples: DataFrame) -> DataFrame:
    """``episode_id, topic``: the topic that sets the pace of each log."""
    return _chosen(samples, DraftRequest()).select(EPISODE, F.col("trigger").alias("topic"))


def _feature_name(path: Column, image: Column, topic: Column) -> Column:
    tail = F.lower(F.substring_index(path, ".", -1))
    name = F.when(image & tail.isin(*IMAGE_TAILS), "image").when(path.endswith("buttons"), "buttons").when(path.endswith("axes"), "axes").otherwise(F.coalesce(path, topic))
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(plain == "", "feature").otherwise(plain)


def _proposal(topic: Column, field: Column) -> Column:
    """Feature name, type, shape, transforms and what to do when it is missing; no field stands for the whole topic, as JSON."""
    path = F.when(field["path"] != "__root__", field["path"])
    text, dtypes = F.coalesce(path, F.lit("")), F.coalesce(field["dtypes"], _words("json"))
    first, shape = F.get(dtypes, F.lit(0)), field["shape"]
    dtype = F.when(field["image_like"], "bytes").when(text.endswith("axes") & F.array_contains(dtypes, "float32"), "float32").when(text.endswith("buttons") & F.array_contains(dtypes, "int64"), "int64").when((first == "bytes") & (F.size(dtypes) > 1), "json").otherwise(first)
    zeroed = dtype.isin(*ZEROED)
    exact = F.when((field["kind"] == "sequence") & (F.get(shape, F.lit(0)) >= 0), F.concat(F.lit("length:"), F.get(shape, F.lit(0)).cast("string")))
    made = F.array_compact(F.array(exact, F.when(zeroed, F.concat(F.lit("cast:"), dtype))))
    name = _feature_name(path, F.coalesce(field["image_like"], F.lit(False)), topic)
    return F.struct(topic.alias("topic"), name.alias("name"), path.alias("path"), dtype.alias("dtype"), F.when(field["kind"].isin("sequence", "image"), shape).alias("shape"), made.alias("transforms"), F.when(zeroed, F.lit("zeros")).otherwise(F.lit("default")).alias("missing"))


def draft_report(samples: DataFrame, request: DraftRequest = DraftRequest()) -> DataFrame:
    """One row for each log: ``trigger, joins, selected``, ``features``, ``label`` (name, topic and path), ``warnings`` and ``unresolved``.

    Unresolved are topics without a candidate (proposed as a whole, as JSON) and an asked label that no feature is named; a log without
    the asked trigger or topics has no features and a warning.
    """
    logs = _chosen(samples, request)
    of_topic = lambda name: F.get(F.filter("topics", lambda t: t["topic"] == name), F.lit(0))
    logs = logs.withColumn("ordered", F.when(F.col("trigger").isNotNull(), F.transform("selected", of_topic)).otherwise(F.slice("topics", 1, 0)))
    best = lambda t: F.when(F.size(t["fields"]) > 0, F.slice(t["fields"], 1, request.features_per_topic)).otherwise(F.array(F.get(t["fields"], F.lit(0))))
    each = F.flatten(F.transform("ordered", lambda t: F.transform(best(t), lambda f: _proposal(t["topic"], f))))
    logs = logs.withColumn("features", numbered(each))
    bare = F.transform(F.filter("ordered", lambda t: F.size(t["fields"]) == 0), lambda t: t["topic"])
    found = F.get(F.filter("features", lambda f: f["name"] == F.lit(request.label)), F.lit(0))
    named, drafted = F.lit(request.label is not None), F.col("trigger").isNotNull()
    lacks = named & drafted & found.isNull()
    warnings = F.array_compact(F.array(F.when(~drafted, F.lit("no topic to draft" if request.trigger is None else f"trigger topic not found: {request.trigger}")), F.when(lacks, F.lit(f"requested label feature '{request.label}' was not found in drafted features"))))
    label = F.when(found.isNotNull(), F.struct(found["name"].alias("name"), found["topic"].alias("topic"), found["path"].alias("path")))
    unresolved = F.concat(bare, F.array_compact(F.array(F.when(lacks, F.lit(request.label)))))
    shown = lambda c: F.when(drafted, F.col(c)).otherwise(F.slice(c, 1, 0)).alias(c)
    return logs.select(EPISODE, "trigger", shown("joins"), shown("selected"), "features", label.alias("label"), warnings.alias("warnings"), unresolved.alias("unresolved"))


def drafts(samples: DataFrame, k: int, request: DraftRequest | None = None) -> DataFrame:
    """The proposed conversion of every log: its topics' features, and whether each topic triggers (and is required) or joins.

    ``topic, name`` (unique in its log), ``path, dtype, shape, transforms, missing`` for the ``k`` best candidates of each topic.
    """
    rows = draft_report(samples, replace(request or DraftRequest(), features_per_topic=k)).select(EPISODE, "trigger", F.inline("features"))
    return rows.withColumn("role", F.when(F.col("topic") == F.col("trigger"), "trigger").otherwise("join")).withColumn("required", F.col("role") == "trigger").drop("trigger")


def proposals(samples: DataFrame, k: int) -> DataFrame:
    """The features of ``drafts`` alone."""
    return drafts(samples, k).drop("role", "required")
