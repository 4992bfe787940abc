"""Queries of the catalog operators and sinks over the given tables, and their oracles.

Customers play assets, nations tags, orders jobs and runs, pages outputs, conversations revision histories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import align, catalog, layout, mapping, profile, validate
from logweave.plans import conversion
from logweave.plans.feature_queries import _FEA, built, wanted
from logweave.plans.log_queries import _COUNTS, _SPLIT, DAY, MSG
from logweave.plans.session import shared_folder, table
from logweave.sources import files, manifest, sinks
from logweave.sources.messages import messages, typed

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


def assets(spark, sf_dir) -> DataFrame:
    """Customers as assets."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("size"), F.col("c_nationkey").alias("nation"))


def asset_tags(spark, sf_dir) -> DataFrame:
    """Tags of assets: their nation, their market segment, and their nation's region."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("n_name", "r_name").alias("tags"))
    rows = assets(spark, sf_dir).join(places, F.col("nation") == F.col("n_nationkey"))
    return rows.select("asset_id", F.explode(F.concat("tags", F.array("kind"))).alias("tag")).withColumn("tag_id", F.xxhash64("tag"))


_TAGS = """WITH tagged AS (SELECT c_custkey AS asset_id, unnest([n_name, r_name, c_mktsegment]) AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_DAY = "CAST(CAST(o_orderdate AS TIMESTAMP) AS DATE)"


def jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs: failed, pending or succeeded, each with the customer as asset."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("succeeded")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day"), F.array("o_custkey").alias("asset_ids"), F.col("o_totalprice").alias("price"))


_JOB = """WITH job AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'succeeded' END AS status, o_orderpriority AS kind, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(CAST(o_orderdate AS TIMESTAMP) AS DATE) AS day, o_custkey AS asset_id, o_totalprice AS price FROM orders)"""


@query("cat1_assets_with_all_tags", _TAGS + " SELECT asset_id FROM tagged WHERE lower(tag) IN ('asia', 'building') GROUP BY 1 HAVING count(DISTINCT lower(tag)) = 2")
def all_tags(spark, sf_dir):
    return catalog.with_all_tags(asset_tags(spark, sf_dir), [" asia", "BUILDING "])


@query("cat2_text_and_range", "SELECT c_custkey AS asset_id, c_name AS name, c_acctbal AS size FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '1') AND c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 100 AND 8000")
def text_and_range(spark, sf_dir):
    found = catalog.search(assets(spark, sf_dir), " 1 ", ["name", "kind"], kind="BUILDING")
    return catalog.in_range(found, "size", 100, 8000).select("asset_id", "name", "size")


@query("cat3_asset_filters_sorted", "SELECT c_custkey AS asset_id, c_acctbal AS size, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal >= 5000")
def asset_filters(spark, sf_dir):
    rows = catalog.in_range(assets(spark, sf_dir), "size", 5000).select("asset_id", "size").orderBy(F.col("size").desc(), "asset_id")
    # Places by counts of larger sizes per bucket, so that no single task ranks all rows.
    bucket = F.floor(F.col("size") / 100)
    from pyspark.sql import Window as W

    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    above = counts.select("b", F.coalesce(F.sum("n").over(W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.row_number().over(W.partitionBy("b").orderBy(F.col("size").desc(), "asset_id"))
    return rows.withColumn("b", bucket).withColumn("at", inside).join(above, "b").select("asset_id", "size", (F.col("above") + F.col("at")).alias("place"))


@query("cat4_assets_with_tags", _TAGS + " SELECT c_custkey AS asset_id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM customer LEFT JOIN tagged ON asset_id = c_custkey GROUP BY 1")
def assets_tags(spark, sf_dir):
    return catalog.assets_with_tags(assets(spark, sf_dir), asset_tags(spark, sf_dir)).select("asset_id", F.array_join("tags", ",").alias("tags"))


@query("cat5_tag_usage", "SELECT n_name AS tag, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def tag_usage(spark, sf_dir):
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("tag"))
    return catalog.tag_usage(tags, assets(spark, sf_dir).where("size > 9000").select("asset_id", F.col("nation").alias("tag_id"))).select("tag", "n")


@query("cat6_related_jobs", _JOB + " SELECT asset_id, job_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, job_id DESC) AS rank FROM job) WHERE rank <= 10")
def related_jobs(spark, sf_dir):
    return catalog.newest_per_asset(jobs(spark, sf_dir), 10, "created_at", "job_id").select("asset_id", "job_id", F.col("rank").cast("long").alias("rank"))


@query("cat7_output_page", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog') ORDER BY page_id DESC LIMIT 20 OFFSET 5")
def output_page(spark, sf_dir):
    return catalog.page(catalog.search(table(spark, sf_dir, "pages"), "BLOG", ["url"]), [F.col("page_id").desc()], 5, 20).select("page_id", "url")


@query("cat2_asset_search", """WITH m AS (SELECT o_custkey AS asset_id, count(*) AS duration, min(CAST(o_orderdate AS TIMESTAMP)) AS started FROM orders GROUP BY 1),
    a AS (SELECT c_custkey AS asset_id, c_name AS name, c_mktsegment AS kind, 'logs/' || c_nationkey AS path, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'indexed' END AS status FROM customer)
    SELECT 'text' AS filter, asset_id, coalesce(duration, -1) AS duration FROM a LEFT JOIN m USING (asset_id) WHERE contains(lower(concat_ws(' ', name, kind, path)), 'logs/1') AND status = 'indexed'
    UNION ALL SELECT 'range', asset_id, duration FROM a JOIN m USING (asset_id) WHERE kind = 'BUILDING' AND duration BETWEEN 2 AND 12 AND started >= TIMESTAMP '1992-03-01 00:00:00'""")
def asset_search(spark, sf_dir):
    metadata = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("asset_id")).agg(F.count("*").alias("duration"), F.min(F.col("o_orderdate").cast("timestamp_ntz")).alias("started"))
    rows = assets(spark, sf_dir).select("asset_id", "name", "kind", F.concat(F.lit("logs/"), "nation").alias("path"), F.when(F.col("size") < 0, "failed").otherwise("indexed").alias("status"))
    by_text = catalog.search_assets(rows, metadata, text=" LOGS/1", status="indexed")
    by_range = catalog.search_assets(rows, metadata, kind="BUILDING", duration=(2, 12), start=(F.expr("TIMESTAMP_NTZ'1992-03-01 00:00:00'"), None))
    return by_text.select(F.lit("text").alias("filter"), "asset_id", F.coalesce("duration", F.lit(-1)).alias("duration")).unionByName(by_range.select(F.lit("range").alias("filter"), "asset_id", "duration"))


@query("cat8_output_assets", "SELECT o_orderkey AS run_id, page_id, CASE WHEN page_id % 3 = 0 THEN '' || page_id WHEN o_custkey IS NOT NULL THEN '' || o_custkey ELSE '' END AS assets FROM pages LEFT JOIN orders ON o_orderkey = page_id")
def output_assets(spark, sf_dir):
    outputs = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("run_id"), F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("asset_id"))
    runs = jobs(spark, sf_dir).select(F.col("job_id").alias("run_id"), "asset_ids", F.col("job_id").alias("known"))
    rows = catalog.output_assets(outputs, runs).join(runs.select("run_id", "known"), "run_id", "left")
    return rows.select(F.col("known").alias("run_id"), "page_id", F.array_join(F.transform("asset_ids", lambda x: x.cast("string")), ",").alias("assets"))


@query("cat9_output_upsert", """SELECT url AS output_path, page_id AS id, 'new' AS state FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 UNION ALL
    SELECT url, -page_id, 'new' FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT url, -page_id, 'old' FROM pages WHERE page_id % 3 = 0 AND page_id % 2 <> 0""")
def output_upsert(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.concat_ws("|", "url", F.col("page_id").cast("string"))
    old = pages.where("page_id % 3 = 0").select(path.alias("output_path"), (-F.col("page_id")).alias("id"), F.lit("old").alias("state"))
    new = pages.where("page_id % 2 = 0").select(path.alias("output_path"), F.col("page_id").alias("id"), F.lit("new").alias("state"))
    return catalog.upsert(old, new, "output_path", ["id"]).withColumn("output_path", F.regexp_replace("output_path", r"\|\d+$", ""))


@query("cat10_mark_missing", "SELECT page_id, CASE WHEN page_id % 4 = 1 AND page_id % 8 = 5 THEN 'missing' ELSE 'ready' END AS status, CASE WHEN page_id % 4 = 1 AND page_id % 8 = 5 THEN 0 ELSE length(url) END AS size FROM pages")
def mark_missing(spark, sf_dir):
    outputs = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("output_path"), (F.col("page_id") % 4).alias("run_id"), F.lit("ready").alias("status"), F.length("url").cast("long").alias("size"))
    return catalog.mark_missing(outputs, outputs.where("page_id % 8 <> 5").select("output_path"), 1).select("page_id", "status", "size")


_ENDS = (".parquet", ".TFRecord", ".manifest.json", ".report.md", ".jsonl", ".json", ".html", ".md", "", ".odd")
_OUT = f"""WITH o AS (SELECT page_id, CAST(page_id AS VARCHAR) || ['{"', '".join(_ENDS)}'][1 + page_id % {len(_ENDS)}] AS name, CASE WHEN page_id % 4 = 1 THEN 'missing' WHEN page_id % 7 = 2 THEN 'invalid' ELSE 'ready' END AS status,
    ['parquet', 'tfrecord', 'json', 'md', 'jsonl', 'json', 'html', 'md', 'unknown', 'odd'][1 + page_id % 10] AS format, ['dataset', 'dataset', 'manifest', 'report'][1 + page_id % 10] AS named,
    ['application/x-parquet', 'application/octet-stream', 'application/json', 'text/markdown', 'application/x-ndjson', 'application/json', 'text/html', 'text/markdown', '-', '-'][1 + page_id % 10] AS media_type FROM pages),
    out AS (SELECT *, coalesce(named, 'sidecar') AS role FROM o)"""


def outputs(spark, sf_dir) -> DataFrame:
    """Pages as outputs with names of all kinds: ready, missing or invalid."""
    name = F.concat(F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, _ENDS)), (1 + F.col("page_id") % len(_ENDS)).cast("int")))
    status = F.when(F.col("page_id") % 4 == 1, "missing").when(F.col("page_id") % 7 == 2, "invalid").otherwise("ready")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), status.alias("status"), catalog.file_class(F.concat(F.lit("a.b/"), name)).alias("c")).select("page_id", "name", "status", "c.*")


@query("cat11_file_classes", _OUT + " SELECT page_id, name, format, role, media_type FROM out")
def file_classes(spark, sf_dir):
    return outputs(spark, sf_dir).select("page_id", "name", "format", "role", F.coalesce("media_type", F.lit("-")).alias("media_type"))


@query("cat12_output_presets", _OUT + " SELECT 'ready_datasets' AS preset, page_id FROM out WHERE role = 'dataset' AND status = 'ready' UNION ALL SELECT 'json_sidecars', page_id FROM out WHERE format IN ('json', 'jsonl') OR role IN ('manifest', 'sidecar')")
def output_presets(spark, sf_dir):
    parts = [catalog.preset(outputs(spark, sf_dir), name).select(F.lit(name).alias("preset"), "page_id") for name in ("ready_datasets", "json_sidecars")]
    return parts[0].unionByName(parts[1])


@query("cat13_job_filters", _JOB + " SELECT job_id, 'queued' AS status FROM job WHERE status = 'pending' AND kind = '1-URGENT'")
def job_filters(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("status", catalog.shown_status(F.col("status")))
    return catalog.search(rows, None, [], status="queued", kind="1-URGENT").select("job_id", "status")


@query("cat14_run_contracts", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'bytes_v2' WHEN o_orderkey % 5 = 0 THEN 'bytes_v2' ELSE 'legacy_list_v1' END AS contract, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS legacy FROM orders")
def run_contracts(spark, sf_dir):
    new, old = F.when(F.col("o_orderkey") % 3 == 0, "bytes_v2"), F.when(F.col("o_orderkey") % 5 == 0, "bytes_v2")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.struct(F.struct(new.alias("payload")).alias("output"), old.alias("payload")).alias("spec"))
    contract = F.coalesce("spec.output.payload", "spec.payload", F.lit("legacy_list_v1"))
    return rows.select("run_id", contract.alias("contract"), F.array_contains(F.array(contract), "legacy_list_v1").alias("legacy"))


def revisions(spark, sf_dir) -> DataFrame:
    """Turns of conversations as revisions."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "text", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("revision_id"))


@query("cat15_latest_revision", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(conv_id AS VARCHAR) || '/' || max(turn) AS latest, max(turn) + 1 AS next_number FROM conversations GROUP BY conv_id")
def latest_revision(spark, sf_dir):
    return catalog.latest_revision(revisions(spark, sf_dir), "conv_id", "turn", "revision_id")


@query("cat16_revision_history", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn FROM conversations WHERE turn >= 1 AND contains(lower(text), 'the')")
def revision_history(spark, sf_dir):
    rows = catalog.in_range(catalog.search(revisions(spark, sf_dir), "the", ["text"]), "turn", 1)
    return rows.select("conv_id", "turn").orderBy("conv_id", F.col("turn").desc())


@query("cat17_revision_kinds", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'create' WHEN contains(lower(text), 'migrat') THEN 'migration' ELSE 'update' END AS kind FROM conversations) GROUP BY 1""")
def revision_kinds(spark, sf_dir):
    return catalog.revision_kinds(revisions(spark, sf_dir), "conv_id", "turn", "text").groupBy("kind").agg(F.count("*").alias("n"))


@query("cat17_migration_notes", """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Migrated from ' || (turn // 4) ELSE text END AS note FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, string_agg(note, '|' ORDER BY began, note) AS notes FROM (SELECT conv_id, note, min(turn) AS began FROM r WHERE contains(lower(note), 'migrat') GROUP BY 1, 2) GROUP BY 1""")
def migration_notes(spark, sf_dir):
    note = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Migrated from "), F.expr("turn div 4").cast("string"))).otherwise(F.col("text"))
    return catalog.migration_notes(revisions(spark, sf_dir).withColumn("note", note), "conv_id", "turn", "note").select("conv_id", F.array_join("notes", "|").alias("notes"))


_NOW = "1998-01-01 00:00:00"


@query("cat18_dashboard_inventory", f"""SELECT count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count_if(CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '{_NOW}' - INTERVAL 1 DAY) AS last_1d,
    count_if(CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS last_7d, count_if(CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY) AS last_30d FROM orders""")
def dashboard_inventory(spark, sf_dir):
    return catalog.inventory_summary(jobs(spark, sf_dir).withColumn("bytes", F.floor("price")), "created_at", "bytes", _NOW)


@query("cat19_status_counts", _JOB + """ SELECT CAST(place AS INT) AS place, d.status, count(job_id) AS n FROM (VALUES (0, 'queued'), (1, 'running'), (2, 'succeeded'), (3, 'failed')) AS d(place, status)
    LEFT JOIN (SELECT job_id, CASE status WHEN 'pending' THEN 'queued' ELSE status END AS status FROM job) j ON j.status = d.status GROUP BY 1, 2""")
def status_counts(spark, sf_dir):
    return catalog.status_counts(jobs(spark, sf_dir).withColumn("status", catalog.shown_status(F.col("status"))), "status", catalog.STATUSES["job"])


@query("cat19_output_counts", _OUT + " SELECT CAST(place AS INT) AS place, d.status, count(page_id) AS n FROM (VALUES (0, 'ready'), (1, 'missing'), (2, 'invalid')) AS d(place, status) LEFT JOIN out ON out.status = d.status GROUP BY 1, 2")
def output_counts(spark, sf_dir):
    return catalog.status_counts(outputs(spark, sf_dir), "status", catalog.STATUSES["output"])


@query("cat20_value_counts", _JOB + " SELECT kind, count(*) AS n FROM job GROUP BY 1")
def value_counts(spark, sf_dir):
    return catalog.value_counts(jobs(spark, sf_dir), "kind")


@query("cat21_recent_failures", _JOB + f" SELECT count_if(status = 'pending') AS active, count_if(status = 'failed' AND created_at >= TIMESTAMP '{_NOW}' - INTERVAL 700 DAY) AS failed_recently FROM job")
def recent_failures(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"completed_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.col("created_at")})
    return catalog.recent_failures(rows, "1996-02-01 00:00:00")


@query("cat22_freshness", "SELECT 'events' AS source, strftime(max(CAST(ts AS TIMESTAMP)), '%Y-%m-%d') AS latest FROM events UNION ALL SELECT 'orders', strftime(max(CAST(o_orderdate AS TIMESTAMP)), '%Y-%m-%d') FROM orders UNION ALL SELECT 'lineitem', strftime(max(CAST(l_shipdate AS TIMESTAMP)), '%Y-%m-%d') FROM lineitem")
def freshness(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.date_format(F.max(F.col(c).cast("timestamp_ntz")), "yyyy-MM-dd").alias("latest")).select(F.lit(t).alias("source"), "latest") for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("cat23_daily_trend", _JOB + """, days AS (SELECT CAST(DATE '1997-01-01' + CAST(i AS INT) AS DATE) AS day FROM range(30) t(i))
    SELECT CAST(d.day AS VARCHAR) AS day, count(job_id) AS created, count(job_id) FILTER (status = 'failed') AS failed, count(job_id) FILTER (status = 'succeeded') AS succeeded FROM days d LEFT JOIN job j ON j.day = d.day GROUP BY 1""")
def daily_trend(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    series = {"created": rows, "failed": rows.where("status = 'failed'"), "succeeded": rows.where("status = 'succeeded'")}
    return catalog.daily_trend(series, "1997-01-01", 30).withColumn("day", F.col("day").cast("string"))


@query("cat24_blockers", _JOB + ", " + _OUT.removeprefix("WITH ") + """ SELECT (SELECT count_if(c_acctbal >= 0 AND c_acctbal < 1000) FROM customer) AS pending_assets, (SELECT count_if(c_acctbal < 0) FROM customer) AS failed_assets, (SELECT count_if(status = 'failed') FROM job) AS failed_jobs,
    (SELECT count_if(status = 'failed' AND job_id % 2 = 0) FROM job) AS failed_conversions, (SELECT count_if(status = 'missing') FROM out) AS missing_outputs, (SELECT count_if(status = 'invalid') FROM out) AS invalid_outputs""")
def blockers(spark, sf_dir):
    status = F.when(F.col("size") < 0, "failed").when(F.col("size") < 1000, "pending").otherwise("indexed")
    every = jobs(spark, sf_dir)
    return catalog.blockers(assets(spark, sf_dir).withColumn("status", status), every, every.where("job_id % 2 = 0"), outputs(spark, sf_dir))


@query("cat25_reindex_selection", _JOB + " SELECT job_id FROM job WHERE status IN ('pending', 'failed')")
def reindex_selection(spark, sf_dir):
    return jobs(spark, sf_dir).where(F.col("status").isin("pending", "failed")).select("job_id")


#: Rows as they are written: those with a view, in three splits and two shards, and what is dropped.
_MANIFEST = _FEA + _COUNTS.replace("FROM msg GROUP BY 1)", "FROM fea WHERE view_value__present = 1 GROUP BY 1)").replace(", c AS (", ", counted AS (").replace("FROM c)", "FROM counted)") + """, placed AS (SELECT fea.*, n0, n1, k.n AS whole, row_number() OVER (PARTITION BY fea.episode_id ORDER BY ts_ns, seq) AS rn FROM fea JOIN k USING (episode_id) WHERE view_value__present = 1),
    sp AS (SELECT *, CASE WHEN rn <= n0 THEN 'train' WHEN rn <= n0 + n1 THEN 'val' ELSE 'test' END AS split FROM placed), sh AS (SELECT *, ntile(2) OVER (PARTITION BY episode_id, split ORDER BY ts_ns, seq) - 1 AS shard FROM sp),
    man AS (SELECT episode_id, split, shard, count(*) AS rows_written, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, any_value(whole) AS whole, any_value(n0) AS n0, any_value(n1) AS n1 FROM sh GROUP BY 1, 2, 3),
    ep AS (SELECT episode_id, count_if(click_bin__present = 0 AND view_value__present = 1) AS no_click, count_if(view_value__present = 0) AS dropped FROM fea GROUP BY 1),
    src AS (SELECT episode_id, count(*) AS message_count, min(ts_ns) AS start_ns, bool_or(topic = '/view') AS viewed FROM msg GROUP BY 1)"""


def manifest_rows_of(spark, sf_dir):
    """The features of each episode, written under names by split and shard, and the manifests of those files."""
    rows = built(spark, sf_dir)
    rows = rows.withColumn("click_bin", F.array_position("click_bin", 1))
    kept = rows.where("view_value__present = 1").select("episode_id", "ts_ns", "seq", "price", "view_value", F.when(F.col("click_bin__present") == 1, F.col("click_bin")).alias("click_bin"))
    placed = layout.time_split_shards(kept, _SPLIT, 2)
    path = _folder(spark, "named")
    names = sinks.write_named(placed, path, 2, order=("ts_ns", "seq"))
    heads = messages(spark, sf_dir)
    logs = heads.select("episode_id").distinct().select("episode_id", F.lit("/logs").alias("path"), F.concat(F.lit("/logs/"), "episode_id", F.lit(".mcap")).alias("file_path"), F.lit("ROS2").alias("ros_version"), F.lit("mcap").alias("storage_format"), F.lit(0).cast("bigint").alias("file_size_bytes"))
    wanted = {"price": ["/purchase"], "view_value": ["/absent", "/view"]}
    resolved = mapping.resolve(mapping.mapping_table(spark, wanted), profile.topic_directory(heads))
    dropped = rows.groupBy("episode_id").agg(F.count_if(F.col("view_value__present") == 0).alias("dropped_rows"))
    lacks = validate.missing_topics(rows, {"/view": ("view_value__present", 1)}, 10)
    found = manifest.manifests(manifest.written_files(spark, path, ["price", "view_value", "click_bin"]), names, manifest.source_rows(logs, profile.temporal_bounds(heads)), manifest.Conversion(mapping=wanted, spec={"row_strategy": "trigger"}), resolved, dropped, lacks)
    return path, found


@query("snk6_manifests", f"WITH {MSG}" + _MANIFEST + """ SELECT man.episode_id, split, CAST(shard AS INT) AS shard, man.episode_id || '-' || split || '-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '-of-00002.parquet' AS output_filename, rows_written, first_ns, last_ns, message_count, start_ns, '/logs/' || man.episode_id || '.mcap' AS source_file, dropped AS dropped_rows,
    whole - n0 - n1 AS test_rows, n0 AS train_rows, no_click, no_click / whole AS no_click_rate, CASE WHEN viewed THEN '/view' ELSE '-' END AS view_topic, 3 AS n_fields, TRUE AS has_bytes FROM man JOIN ep USING (episode_id) JOIN src USING (episode_id)""")
def manifest_rows(spark, sf_dir):
    _, found = manifest_rows_of(spark, sf_dir)
    of_split = lambda name: F.coalesce(F.col("conversion.split_counts")[name], F.lit(0)).alias(f"{name}_rows")
    return found.select(
        "episode_id", F.col("dataset.split_name").alias("split"), F.col("dataset.shard_index").alias("shard"), "dataset.output_filename", "dataset.rows_written", "temporal.first_ns", "temporal.last_ns", "temporal.message_count", "temporal.start_ns", F.col("source.file_path").alias("source_file"), "conversion.dropped_rows",
        of_split("test"), of_split("train"), F.col("conversion.missing_feature_counts")["click_bin"].alias("no_click"), F.col("conversion.missing_feature_rates")["click_bin"].alias("no_click_rate"), F.coalesce(F.col("conversion.mapping_resolved")["view_value"], F.lit("-")).alias("view_topic"), F.size("dataset.field_names").alias("n_fields"), (F.col("dataset.file_size_bytes") > 0).alias("has_bytes"),
    )


@query("snk1_named_files", f"WITH {MSG}" + _MANIFEST + " SELECT DISTINCT episode_id || '-' || split || '-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '-of-00002' || ending AS name FROM sh, (VALUES ('.parquet'), ('.manifest.json')) AS e(ending)")
def named_files(spark, sf_dir):
    """The listing of the output folder: the data files and their manifests."""
    path, found = manifest_rows_of(spark, sf_dir)
    manifest.write_manifests(found, path)
    listed = files.inventory(spark, [path], suffixes=(".parquet", ".json"))
    return listed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


@query("snk7_readiness", f"WITH {MSG}" + _MANIFEST + """, done AS (SELECT episode_id, sum(rows_written) AS rows FROM man GROUP BY 1) SELECT e.episode_id, done.episode_id IS NOT NULL AS has_manifest, coalesce(rows, 0) > 0 AS has_rows, done.episode_id IS NOT NULL AS has_required_fields, CAST(coalesce(rows, 0) AS BIGINT) AS rows
    FROM (SELECT DISTINCT episode_id FROM msg) e LEFT JOIN done USING (episode_id)""")
def readiness(spark, sf_dir):
    _, found = manifest_rows_of(spark, sf_dir)
    return sinks.readiness(messages(spark, sf_dir), manifest.summary(found), ["price"]).select("episode_id", "has_manifest", "has_rows", "has_required_fields", "rows")


@query("conv1_dataset", f"WITH {MSG}" + _MANIFEST + " SELECT episode_id || '-' || split || '-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '-of-00002.parquet' AS file_name, ts_ns, round(price, 4) AS price, round(view_value, 4) AS view_value FROM sh")
def whole_conversion(spark, sf_dir):
    """All logs converted in one call, read back from the files: triggers with a view, features, splits, shards."""
    joins = (align.Join("/view", "view", staleness_ns=7 * DAY, required=True), align.Join("/click", "click", staleness_ns=DAY))
    topics = {"price": ["/purchase"], "view_value": ["/view"], "click_bin": ["/click"]}
    spec = conversion.Spec(conversion.Triggered("/purchase", joins), tuple(wanted()), topics, split=_SPLIT, shards=2, label="click_bin")
    path = _folder(spark, "converted")
    conversion.convert(typed(spark, sf_dir), spec, path)
    rows = manifest.few_tasks(spark.read.option("pathGlobFilter", "*.parquet").parquet(path))
    return rows.select(F.col("_metadata.file_name").alias("file_name"), "ts_ns", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("price", "view_value")])


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snk1_parquet_dataset", f"WITH {MSG} SELECT episode_id, ts_ns, CAST(k AS VARCHAR) AS k, topic FROM msg")
def parquet_dataset(spark, sf_dir):
    rows = layout.no_split(typed(spark, sf_dir)).select("episode_id", "split", "ts_ns", "topic", "payload.k")
    path = _folder(spark, "dataset")
    sinks.write_dataset(sinks.wide_rows(rows, ["topic", "k"], "episode_id", "split"), path, "zstd", ("split",))
    return sinks.read_dataset(spark, path, ["episode_id", "ts_ns", "k", "topic"])


@query("src12_column_subset", f"WITH {MSG} SELECT ts_ns, topic FROM msg WHERE topic = '/view'")
def column_subset(spark, sf_dir):
    rows = layout.no_split(typed(spark, sf_dir)).select("episode_id", "split", "ts_ns", "topic", "payload.k")
    path = _folder(spark, "dataset")
    sinks.write_dataset(sinks.wide_rows(rows, ["topic", "k"], "episode_id", "split"), path, "zstd", ("split",))
    return sinks.read_dataset(spark, path, ["ts_ns", "topic"]).where("topic = '/view'")


@query("src7_log_families", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ROS1' ELSE 'ROS2' END AS version, CASE WHEN page_id % 2 = 0 THEN 'bag' ELSE 'mcap' END AS format FROM pages")
def log_families(spark, sf_dir):
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".BAG").otherwise(".mcap"))
    return table(spark, sf_dir, "pages").select("page_id", files.log_family(name).alias("f")).select("page_id", "f.version", "f.format")


@query("src8_compression", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'zstd' WHEN 1 THEN 'lz4' WHEN 2 THEN 'bz2' WHEN 3 THEN 'unknown' ELSE 'none' END AS compression FROM pages")
def compressions(spark, sf_dir):
    start = F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("28B52FFD"))).when(F.col("page_id") % 5 == 1, F.unhex(F.lit("04224D18"))).when(F.col("page_id") % 5 == 2, F.unhex(F.lit("425A68"))).when(F.col("page_id") % 5 == 4, F.unhex(F.lit("00")))
    return table(spark, sf_dir, "pages").select("page_id", files.compression(F.concat(start, F.col("html").cast("binary"))).alias("compression"))
