"""Catalog queries over assets, tags, jobs, runs, outputs and revisions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order in which statuses are shown, what follows from the ends of file names, and media types of formats.
STATUSES = {"asset": ("pending", "indexing", "indexed", "failed"), "job": ("queued", "running", "succeeded", "failed"), "run": ("queued", "running", "succeeded", "failed"), "output": ("ready", "missing", "invalid")}
NAMES = ((".manifest.json", "json", "manifest"), (".report.md", "md", "report"))
DATASETS = ("parquet", "tfrecord")
MEDIA = {"parquet": "application/x-parquet", "tfrecord": "application/octet-stream", "json": "application/json", "jsonl": "application/x-ndjson"}


def tag_name(tag: Column) -> Column:
    """A tag with white space collapsed and letters lowered."""
    return F.lower(F.trim(F.regexp_replace(tag, r"\s+", " ")))


def with_all_tags(asset_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Assets that have every one of the tags."""
    wanted = sorted({" ".join(t.split()).lower() for t in tags})
    hits = asset_tags.withColumn("_tag", tag_name(F.col("tag"))).where(F.col("_tag").isin(wanted))
    return hits.groupBy("asset_id").agg(F.count_distinct("_tag").alias("n")).where(F.col("n") == len(wanted)).select("asset_id")


def search(rows: DataFrame, text: str | None, columns: list[str], **equal) -> DataFrame:
    """Rows with a text in any of the columns (case ignored) and equal values elsewhere."""
    if text and text.strip():
        rows = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower()))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows


def in_range(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows whose value lies in the closed range; null fails as soon as a bound is given."""
    if low is not None:
        rows = rows.where(F.col(column) >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col(column) <= F.lit(high))
    return rows


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def assets_with_tags(assets: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """Every asset with its sorted tags, also without any."""
    tags = asset_tags.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("tag", "tag_id"))).alias("tags"))
    return assets.join(tags, "asset_id", "left").withColumn("tags", F.coalesce(F.transform("tags", lambda t: t["tag"]), F.array().cast("array<string>")))


def tag_usage(tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """Assets of each tag, zero kept."""
    return tags.join(asset_tags.groupBy("tag_id").agg(F.count("*").alias("n")), "tag_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def newest_per_asset(rows: DataFrame, n: int, time: str, key: str) -> DataFrame:
    """The newest ``n`` jobs or runs of every asset they name in ``asset_ids``."""
    each = rows.withColumn("asset_id", F.explode("asset_ids"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("asset_id").orderBy(F.col(time).desc(), F.col(key).desc()))).where(F.col("rank") <= n)


def output_assets(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Outputs with ``asset_ids``: their own asset, else their run's assets, else none."""
    joined = outputs.join(runs.select("run_id", F.col("asset_ids").alias("_run")), "run_id", "left")
    own = F.when(F.col("asset_id").isNotNull(), F.array("asset_id"))
    return joined.withColumn("asset_ids", F.coalesce(own, F.col("_run"), F.array().cast("array<bigint>"))).drop("_run")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows over old ones of the same key, keeping the old id and creation; old rows without a new one stay."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    changed = new.join(kept, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return changed.select(*old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def mark_missing(outputs: DataFrame, listing: DataFrame, run_id: int) -> DataFrame:
    """Outputs of a run that its current listing lacks: status missing, size 0."""
    seen = listing.select("output_path").distinct().withColumn("_seen", F.lit(True))
    gone = (F.col("run_id") == run_id) & F.col("_seen").isNull()
    rows = outputs.join(seen, "output_path", "left")
    return rows.withColumns({"status": F.when(gone, "missing").otherwise(F.col("status")), "size": F.when(gone, 0).otherwise(F.col("size")).cast("long")}).drop("_seen")


def file_class(name: Column) -> Column:
    """``struct(format, role, media_type)`` of an output by its file name: datasets, manifests and reports by their ends, all else sidecars.

    A format without a media type of its own has the one that Python's table gives its suffix, or none.
    """
    last = F.lower(F.substring_index(name, "/", -1))
    suffix = F.regexp_extract(last, r"^.+\.([^.]+)$", 1)
    kind, role = F.when(suffix == "", "unknown").otherwise(suffix), F.when(suffix.isin(*DATASETS), "dataset").otherwise("sidecar")
    for end, own, says in NAMES:
        kind, role = F.when(last.endswith(end), own).otherwise(kind), F.when(last.endswith(end), says).otherwise(role)
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    common = F.create_map(*[F.lit(x) for end, media in sorted(mimetypes.types_map.items()) for x in (end[1:], media)])
    return F.struct(kind.alias("format"), role.alias("role"), F.coalesce(F.element_at(known, kind), F.element_at(common, suffix)).alias("media_type"))


def preset(outputs: DataFrame, name: str) -> DataFrame:
    """Outputs of a preset: ``ready_datasets``, or ``json_sidecars`` (JSON formats, manifests and sidecars)."""
    if name == "ready_datasets":
        return outputs.where((F.col("role") == "dataset") & (F.col("status") == "ready"))
    if name == "json_sidecars":
        return outputs.where(F.col("format").isin("json", "jsonl") | F.col("role").isin("manifest", "sidecar"))
    raise ValueError(f"unknown preset {name!r}")


def shown_status(status: Column) -> Column:
    """Statuses as they are shown: what is pending counts as queued."""
    return F.when(status == "pending", "queued").otherwise(status)


def latest_revision(revisions: DataFrame, key: str, number: str, identity: str) -> DataFrame:
    """The latest revision of each document and the number its next one gets."""
    return revisions.groupBy(key).agg(F.max_by(identity, F.struct(number, identity)).alias("latest"), (F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def revision_kinds(revisions: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Each revision as create (the first), migration (its text tells of one) or update."""
    first = F.row_number().over(W.partitionBy(key).orderBy(number)) == 1
    return revisions.withColumn("kind", F.when(first, "create").when(F.lower(text).contains("migrat"), "migration").otherwise("update"))


def migration_notes(revisions: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Distinct texts of each document's revisions that tell of a migration, in the order they first came."""
    told = revisions.where(F.lower(text).contains("migrat")).groupBy(key, F.col(text).alias("_note")).agg(F.min(number).alias("_at"))
    return told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_note"))), lambda x: x["_note"]).alias("notes"))


def blockers(assets: DataFrame, jobs: DataFrame, runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: what stands in the way: assets pending and failed, jobs and runs failed, outputs missing and invalid. One count of each table by ``status``."""
    wanted = {"assets": ("pending", "failed"), "jobs": ("failed",), "conversions": ("failed",), "outputs": ("missing", "invalid")}
    parts = [rows.select(F.lit(name).alias("of"), "status").where(F.col("status").isin(*wanted[name])) for name, rows in zip(wanted, (assets, jobs, runs, outputs), strict=True)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.agg(*[F.count_if((F.col("of") == name) & (F.col("status") == status)).alias(f"{status}_{name}") for name, statuses in wanted.items() for status in statuses])


def search_assets(assets: DataFrame, metadata: DataFrame, text: str | None = None, kind: str | None = None, status: str | None = None, duration: tuple = (None, None), start: tuple = (None, None)) -> DataFrame:
    """Assets by a text in name, type or path, by type and status, and by the closed ranges of their metadata's duration and start.

    Assets without metadata stay unless a range is asked for.
    """
    rows = search(assets, text, ["name", "kind", "path"], **{k: v for k, v in (("kind", kind), ("status", status)) if v is not None})
    rows = rows.join(metadata.select("asset_id", "duration", "started"), "asset_id", "left")
    return in_range(in_range(rows, "duration", *duration), "started", *start)


def inventory_summary(rows: DataFrame, time: str, size: str, now: str) -> DataFrame:
    """One row: count, bytes, and how many were registered in the last day, week and month."""
    at = F.lit(now).cast("timestamp_ntz")
    ago = lambda days: F.count_if(F.col(time).cast("timestamp_ntz") >= at - F.expr(f"INTERVAL {days} DAYS"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), ago(1).alias("last_1d"), ago(7).alias("last_7d"), ago(30).alias("last_30d"))


def status_counts(rows: DataFrame, status: str, domain: tuple[str, ...]) -> DataFrame:
    """``place, status, n`` for every status of the domain, zero-filled, in its order."""
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    fixed = rows.sparkSession.range(len(domain)).select(F.col("id").cast("int").alias("place"), F.element_at(F.array(*[F.lit(d) for d in domain]), F.col("id").cast("int") + 1).alias("status"))
    return fixed.join(counts, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value, most frequent first, then by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def recent_failures(jobs: DataFrame, since: str) -> DataFrame:
    """One row: active jobs, and jobs failed since a time (by completion, else update, else creation)."""
    at = F.coalesce("completed_at", "updated_at", "created_at").cast("timestamp_ntz")
    return jobs.agg(F.count_if(F.col("status").isin("queued", "running", "pending")).alias("active"), F.count_if((F.col("status") == "failed") & (at >= F.lit(since).cast("timestamp_ntz"))).alias("failed_recently"))


def daily_trend(series: dict[str, DataFrame], start: str, days: int) -> DataFrame:
    """``day`` and one count for each series over consecutive UTC days, zero-filled; series have a ``day`` column."""
    if not 1 <= days <= 90:
        raise ValueError("a trend has 1 to 90 days")
    spark = next(iter(series.values())).sparkSession
    end = F.date_add(F.lit(start).cast("date"), days)
    marked = [rows.select("day", F.lit(name).alias("of")).where((F.col("day") >= F.lit(start)) & (F.col("day") < end)) for name, rows in series.items()]
    both = marked[0]
    for more in marked[1:]:
        both = both.unionByName(more)
    counts = both.groupBy("day").agg(*[F.count_if(F.col("of") == name).alias(name) for name in series])
    every = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    return every.join(counts, "day", "left").select("day", *[F.coalesce(name, F.lit(0)).alias(name) for name in series])
