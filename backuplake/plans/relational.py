"""Sources, sinks, projections, filters, orderings and scalar functions over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake import schemas
from backuplake.functions import features, text
from backuplake.operators import filters, path_index, projections, sorting, windows
from backuplake.plans.registry import query
from backuplake.session import shared_path
from backuplake.sources import bindings as b
from backuplake.sources import readers, sinks, tree

# --- sources -----------------------------------------------------------------------------------


def _typed_messages(spark, d):
    """Event messages with the payload union: completed, failed or started by event type."""
    e = b.events(spark, d)
    backup = F.concat(F.lit("b"), F.col("event_id").cast("string"))
    kind = F.col("backup_type")
    message = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("device_id").cast("string").alias("device_id"),
        F.col("tenant_id").cast("string").alias("tenant_id"),
        F.when(kind.isin("view", "signup"), F.struct(backup.alias("backup_id"), F.lit("FULL").alias("backup_type"))).alias(
            "started"
        ),
        F.when(
            kind.isin("click", "purchase"),
            F.struct(
                backup.alias("backup_id"),
                F.col("size").alias("final_size_bytes"),
                F.col("duration").alias("duration_seconds"),
            ),
        ).alias("completed"),
        F.when(
            kind == "error", F.struct(backup.alias("backup_id"), F.lit("E1").alias("error_code"))
        ).alias("failed"),
    )
    return e.select(F.to_json(message).alias("value"))


@query(
    "src_01_stream_source",
    "SELECT backup_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM ev GROUP BY ALL",
    "ev",
)
def src_01(spark, d):
    """The streaming source read to its end, counted per type."""
    from backuplake.streaming.run import run_to_end

    out = run_to_end(b.event_columns(b.stream(spark, d, "events")), "src01")
    return out.groupBy("backup_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))


_KIND_SQL = """SELECT CAST(event_id AS VARCHAR) AS event_id, "timestamp", CAST(device_id AS VARCHAR) AS device_id,
    CASE WHEN backup_type IN ('view', 'signup') THEN 'started' WHEN backup_type = 'error' THEN 'failed'
         ELSE 'completed' END AS event_kind, 'b' || event_id AS backup_id,
    CASE WHEN backup_type IN ('click', 'purchase') THEN size END AS final_size_bytes,
    CASE WHEN backup_type IN ('click', 'purchase') THEN duration END AS duration_seconds,
    CASE WHEN backup_type = 'error' THEN 'E1' END AS error_code FROM ev"""


@query(
    "src_02_typed_events",
    f"SELECT event_kind, count(*) AS n, CAST(sum(final_size_bytes) AS BIGINT) AS final_size_bytes FROM ({_KIND_SQL}) GROUP BY ALL",
    "ev",
)
def src_02(spark, d):
    flat = projections.flatten_events(readers.typed_events(_typed_messages(spark, d)))
    return flat.groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("final_size_bytes").alias("final_size_bytes"))


@query(
    "src_03_training_set",
    """SELECT count(*) AS n, CAST(sum(CAST(file_count AS BIGINT)) AS BIGINT) AS files, round(min(backup_duration), 6) AS shortest,
       round(max(backup_duration), 6) AS longest FROM training""",
    "training",
)
def src_03(spark, d):
    path = shared_path(spark, "training")
    rows = b.backup_training(spark, d).withColumns(
        {"file_count": F.col("file_count").cast("int"), "total_size": F.col("total_size").cast("bigint")}
    )
    sinks.write_documents(rows.select(*schemas.column_names(schemas.BACKUP_TRAINING)), path)
    read = readers.training_set(spark, path, schemas.BACKUP_TRAINING)
    return read.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("file_count").alias("files"),
        F.round(F.min("backup_duration"), 6).alias("shortest"),
        F.round(F.max("backup_duration"), 6).alias("longest"),
    )


@query(
    "src_04_table_scans",
    """SELECT 'jobs' AS source, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM jobs
       UNION ALL SELECT 'snapshots', count(*), CAST(sum(size) AS BIGINT) FROM snapshots""",
    "jobs snapshots",
)
def src_04(spark, d):
    parts = []
    for name, df in [("jobs", b.jobs(spark, d)), ("snapshots", b.snapshots(spark, d))]:
        path = shared_path(spark, name)
        df.write.parquet(path)
        parts.append(
            readers.table(spark, path).agg(
                F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "src_05_directory_listing",
    """SELECT '/' || source || '/' || lang AS parent_path, TRUE AS listed FROM documents GROUP BY ALL""",
)
def src_05(spark, d):
    """Folders of a file tree. Documents are written out by source and language, then listed
    without opening them."""
    root = shared_path(spark, "tree")
    b.read(spark, d, "documents").select("source", "lang", "doc_id", "text").write.partitionBy("source", "lang").parquet(root)
    listed = readers.directory_listing(spark, root).filter(F.col("name").endswith(".parquet"))
    folder = F.regexp_replace(F.regexp_extract("path", r"(/source=[^/]*/lang=[^/]*)/[^/]*$", 1), "source=|lang=", "")
    return listed.groupBy(folder.alias("parent_path")).agg((F.sum("size") > 0).alias("listed"))


@query(
    "src_05_directory_tree",
    """WITH f AS (SELECT '/source=' || coalesce(source, 'none') AS up, '/lang=' || coalesce(lang, 'none') AS down,
                         octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents)
       SELECT up || down AS path, TRUE AS is_directory, CAST(sum(n) AS BIGINT) AS bytes, TRUE AS owner_reads FROM f GROUP BY ALL
       UNION ALL SELECT DISTINCT up, TRUE, 0, TRUE FROM f
       UNION ALL SELECT '/_SUCCESS', FALSE, 0, TRUE""",
)
def src_05t(spark, d):
    """Folders with the bytes of their files, and empty files, from a scan of a tree of text files."""
    root = shared_path(spark, "tree")
    labels = [F.coalesce(c, F.lit("none")).alias(c) for c in ("source", "lang")]
    b.read(spark, d, "documents").select(*labels, "text").write.partitionBy("source", "lang").text(root)
    found = tree.directory_tree(spark, root).filter(~F.col("name").startswith("."))
    held = found.filter("NOT is_directory").groupBy(F.col("parent_path").alias("path")).agg(F.sum("size").alias("bytes"))
    kept = found.filter("is_directory OR size = 0").join(held, "path", "left")
    return kept.select(
        F.regexp_extract("path", r"/tree-[0-9a-f]{32}(/.*)$", 1).alias("path"),
        "is_directory",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.col("permissions").startswith("r").alias("owner_reads"),
    )


@query(
    "src_06_key_registry",
    """SELECT device_id AS "deviceId", count(*) AS n, max(created_ms) AS newest FROM (
       SELECT CAST(device_id AS VARCHAR) AS device_id, created_ms FROM keys) GROUP BY ALL""",
    "keys",
)
def src_06(spark, d):
    path = shared_path(spark, "keys")
    rows = b.keys(spark, d).select(
        F.col("key_id").alias("keyId"),
        F.col("device_id").cast("string").alias("deviceId"),
        "algorithm",
        F.col("key_derivation").alias("keyDerivation"),
        F.lit(16384).alias("iterations"),
        F.col("created_ms").alias("createdAt"),
        F.col("is_active").alias("isActive"),
        F.lit("secret").alias("encryptedKey"),
    )
    sinks.write_keys(rows, path)
    read = readers.key_registry(spark, path)
    return read.groupBy("deviceId").agg(F.count(F.lit(1)).alias("n"), F.max("createdAt").alias("newest"))


# --- sinks -------------------------------------------------------------------------------------


@query(
    "snk_01_batch_sink",
    "SELECT tenant_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY ALL",
    "ev",
)
def snk_01(spark, d):
    """Each batch written twice, as after a failure: nothing doubles."""
    path = shared_path(spark, "batches")
    write = sinks.batch_writer(path)
    for tenant_half, batch_id in [(F.col("tenant_id") < 5, 0), (F.col("tenant_id") >= 5, 1)]:
        part = b.events(spark, d).filter(tenant_half)
        write(part, batch_id)
        write(part, batch_id)
    return spark.read.parquet(path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(
    "snk_02_prediction_log",
    """SELECT event_id, device_id, "timestamp" FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 10000""",
    "ev",
)
def snk_02(spark, d):
    path, target = shared_path(spark, "log"), shared_path(spark, "compact")
    sinks.append_predictions(b.events(spark, d).select("event_id", "device_id", "timestamp"), path, 0)
    sinks.compact_predictions(spark, path, target, ["timestamp", "event_id"])
    return spark.read.parquet(target)


@query(
    "snk_03_expiring_updates",
    """SELECT event_id, device_id, "timestamp", "timestamp" + INTERVAL 1 HOUR AS expires_at FROM ev
       WHERE "timestamp" + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00'""",
    "ev",
)
def snk_03(spark, d):
    log = sinks.with_expiry(b.events(spark, d).select("event_id", "device_id", "timestamp"))
    return sinks.live_updates(log, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query(
    "snk_04_manifest_write",
    "SELECT CAST(job_id % 16 AS BIGINT) AS backup_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM snapshots GROUP BY ALL",
    "snapshots",
)
def snk_04(spark, d):
    path = shared_path(spark, "manifest")
    rows = b.snapshots(spark, d).select((F.col("job_id") % 16).alias("backup_id"), "path", "size", "checksum")
    sinks.write_manifest(rows, path)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("backup_id").cast("bigint").alias("backup_id"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    )


@query(
    "snk_05_alert_sink",
    """SELECT event_id, size, 'anomaly' AS alert_kind FROM ev WHERE size > 20000""",
    "ev",
)
def snk_05(spark, d):
    path = shared_path(spark, "alerts")
    sinks.alert_writer(path, "anomaly")(b.events(spark, d).filter("size > 20000").select("event_id", "size"), 0)
    return spark.read.parquet(path).drop("batch_id")


# --- projections -------------------------------------------------------------------------------


@query(
    "prj_01_parse_events",
    """SELECT "timestamp", CAST(tenant_id AS VARCHAR) AS tenant_id, backup_type, CAST(size AS DOUBLE) AS size,
       CASE WHEN backup_type <> 'error' THEN CAST(duration AS DOUBLE) END AS duration, duration * 2 AS file_count FROM ev""",
    "ev",
)
def prj_01(spark, d):
    return projections.parse_events(b.raw_events(spark, d))


@query("prj_02_flatten_events", _KIND_SQL, "ev")
def prj_02(spark, d):
    flat = projections.flatten_events(readers.typed_events(_typed_messages(spark, d)))
    return flat.select(
        "event_id", "timestamp", "device_id", "event_kind", "backup_id", "final_size_bytes", "duration_seconds", "error_code"
    )


@query(
    "prj_03_responses",
    """SELECT job_id, device_id, status, progress, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
       estimated_duration FROM jobs""",
    "jobs",
)
def prj_03(spark, d):
    return projections.job_response(b.jobs(spark, d))


@query(
    "prj_03_key_info",
    """SELECT key_id, device_id, algorithm, key_derivation, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
       is_active FROM keys""",
    "keys",
)
def prj_03k(spark, d):
    return projections.key_info(b.keys(spark, d))


@query(
    "prj_04_anomaly_detail",
    """SELECT job_id, size AS backup_size, CAST(size AS DOUBLE) / stored_size AS compression_ratio, duration,
       CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END::BIGINT AS error_count FROM jobs""",
    "jobs",
)
def prj_04(spark, d):
    rows = b.jobs(spark, d).withColumns(
        {
            "ratio": F.col("size").cast("double") / F.col("stored_size"),
            "errors": F.when(F.col("status") == "FAILED", 1).cast("bigint"),
        }
    )
    return projections.anomaly_detail(rows, "size", "ratio", "duration", "errors").select("job_id", "details.*")


_UPDATE_VIEW = """upd AS (SELECT device_id, count(*) AS n FROM jobs WHERE status = 'RUNNING' GROUP BY 1)"""


@query(
    "prj_05_partial_update",
    f"""WITH {_UPDATE_VIEW} SELECT d.device_id, coalesce(u.n, d.tenant_id) AS tenant_id, d.is_online,
        CASE WHEN u.device_id IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE d.last_sync END AS last_sync
        FROM devices d LEFT JOIN upd u USING (device_id)""",
    "devices jobs",
)
def prj_05(spark, d):
    running = b.jobs(spark, d).filter("status = 'RUNNING'").groupBy("device_id").agg(F.count(F.lit(1)).alias("tenant_id"))
    return projections.apply_updates(
        b.devices(spark, d), running, "device_id", {"last_sync": F.lit("2024-06-01").cast("timestamp_ntz")}
    )


@query(
    "prj_06_soft_delete",
    """SELECT v.path, v.device_id, v.version, v.chunk_id, v.is_deleted OR c.chunk_id IS NOT NULL AS is_deleted
       FROM versions v LEFT JOIN (SELECT chunk_id FROM chunk_index WHERE size > 40) c USING (chunk_id)""",
    "versions chunk_index",
)
def prj_06(spark, d):
    doomed = b.chunk_index(spark, d).filter("size > 40")
    return projections.soft_delete(
        b.versions(spark, d).select("path", "device_id", "version", "chunk_id", "is_deleted"), doomed, ["chunk_id"]
    )


# --- filters -----------------------------------------------------------------------------------


@query("flt_01_point_lookup", "SELECT job_id, device_id, status FROM jobs WHERE job_id = 42", "jobs")
def flt_01(spark, d):
    return filters.by_key(b.jobs(spark, d), "job_id", 42).select("job_id", "device_id", "status")


@query(
    "flt_02_live_of_device",
    "SELECT path, version, chunk_id, size FROM versions WHERE device_id = 7 AND NOT is_deleted",
    "versions",
)
def flt_02(spark, d):
    return filters.live_of(b.versions(spark, d), "device_id", 7).select("path", "version", "chunk_id", "size")


@query(
    "flt_03_active_jobs",
    "SELECT job_id, device_id, status FROM jobs WHERE status IN ('RUNNING', 'QUEUED', 'PAUSED')",
    "jobs",
)
def flt_03(spark, d):
    return filters.with_status(b.jobs(spark, d), ["RUNNING", "QUEUED", "PAUSED"]).select("job_id", "device_id", "status")


@query(
    "flt_03_active_jobs_of_device",
    "SELECT job_id, status FROM jobs WHERE status IN ('RUNNING', 'PENDING') AND device_id = 7",
    "jobs",
)
def flt_03d(spark, d):
    return filters.with_status(b.jobs(spark, d), ["RUNNING", "PENDING"], ("device_id", 7)).select("job_id", "status")


@query(
    "flt_04_time_range",
    "SELECT job_id, created_at FROM jobs WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'",
    "jobs",
)
def flt_04(spark, d):
    at = [F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1997-01-01")]
    return filters.in_range(b.jobs(spark, d), "created_at", *at).select("job_id", "created_at")


@query(
    "flt_05_since",
    """SELECT snapshot_id AS id, 'snapshot' AS kind FROM snapshots WHERE created_at >= TIMESTAMP '2001-01-01'
       UNION ALL SELECT CAST(event_id AS VARCHAR), 'change' FROM ev WHERE "timestamp" > TIMESTAMP '2024-01-20'""",
    "snapshots ev",
)
def flt_05(spark, d):
    kept = filters.since(b.snapshots(spark, d), "created_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    changes = filters.since(b.events(spark, d), "timestamp", F.lit("2024-01-20").cast("timestamp_ntz"), strict=True)
    return kept.select(F.col("snapshot_id").alias("id"), F.lit("snapshot").alias("kind")).unionByName(
        changes.select(F.col("event_id").cast("string").alias("id"), F.lit("change").alias("kind"))
    )


@query(
    "flt_06_path_like",
    "SELECT snapshot_id, path FROM snapshots WHERE device_id = 3 AND path LIKE '/set1%/Box_/%.pdf'",
    "snapshots",
)
def flt_06(spark, d):
    return filters.path_like(b.snapshots(spark, d), "/set1%/Box_/%.pdf", "device_id", 3).select("snapshot_id", "path")


@query(
    "flt_07_search_files",
    """SELECT snapshot_id, path, name FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM snapshots)
       WHERE (lower(name) LIKE '%box3%' OR lower(path) LIKE '%box3%') AND (name LIKE '%.jpg' OR name LIKE '%.txt')""",
    "snapshots",
)
def flt_07(spark, d):
    named = b.snapshots(spark, d).withColumn("name", text.base_name(F.col("path")))
    return filters.search_files(named, "BOX3", [".jpg", ".TXT"]).select("snapshot_id", "path", "name")


@query(
    "flt_07_path_index",
    """WITH p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM snapshots)
       SELECT 'text' AS kind, path FROM p WHERE lower(path) LIKE '%box3%' AND (lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.txt')
       UNION ALL SELECT 'name', path FROM p WHERE lower(name) LIKE '%f12%'
       UNION ALL SELECT 'short', path FROM p WHERE lower(path) LIKE '%x6%'
       UNION ALL SELECT 'pattern', path FROM p WHERE path LIKE '/set1%/Box_/%9.pdf'""",
    "snapshots",
)
def flt_07_index(spark, d):
    """Four searches through one trigram index, one of them too short for it."""
    index = path_index.build(b.snapshots(spark, d))
    found = {
        "text": path_index.search(index, "BOX3", [".jpg", ".TXT"]),
        "name": path_index.search(index, "F12", name_only=True),
        "short": path_index.search(index, "x6"),
        "pattern": path_index.like(index, "/set1%/Box_/%9.pdf"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "path") for kind, df in found.items()])


@query(
    "flt_08_file_class",
    """SELECT snapshot_id, path FROM snapshots WHERE path LIKE '%.jpg' OR path LIKE '%.pdf' OR path LIKE '%.txt'""",
    "snapshots",
)
def flt_08(spark, d):
    return filters.of_class(b.snapshots(spark, d), ["IMAGE", "DOCUMENT"]).select("snapshot_id", "path")


@query(
    "flt_09_backup_candidates",
    """SELECT snapshot_id, path, size FROM snapshots WHERE path NOT LIKE '%.tmp' AND path NOT LIKE '%.log' AND size <= 5000000""",
    "snapshots",
)
def flt_09(spark, d):
    return filters.backup_candidates(b.snapshots(spark, d), max_bytes=5_000_000).select("snapshot_id", "path", "size")


@query(
    "flt_10_dirty_blocks",
    """SELECT device_id, block_number, max(ts) AS last_modified FROM writes GROUP BY ALL
       HAVING max(ts) > TIMESTAMP '2000-01-01'""",
    "writes",
)
def flt_10(spark, d):
    state = b.block_writes(spark, d).groupBy("device_id", "block_number").agg(
        F.max("ts").alias("last_modified"), F.lit(True).alias("is_dirty")
    )
    return filters.dirty_blocks(state, F.lit("2000-01-01").cast("timestamp_ntz")).drop("is_dirty")


@query("flt_11_online_devices", "SELECT device_id, tenant_id FROM devices WHERE is_online", "devices")
def flt_11(spark, d):
    return filters.flagged(b.devices(spark, d), "is_online").select("device_id", "tenant_id")


@query(
    "flt_12_score_threshold",
    "SELECT tenant_id, hour_ts, quality_score FROM scores WHERE quality_score > 0.7",
    "ev scores",
)
def flt_12(spark, d):
    return filters.above(b.hourly_scores(spark, d), "quality_score", 0.7).select("tenant_id", "hour_ts", "quality_score")


@query(
    "flt_12_optimal_hours",
    """SELECT tenant_id, CAST(hour("timestamp") AS BIGINT) AS "hour",
       CAST(count(*) FILTER (backup_type <> 'error') AS DOUBLE) / count(*) AS score
       FROM ev GROUP BY ALL HAVING CAST(count(*) FILTER (backup_type <> 'error') AS DOUBLE) / count(*) > 0.8""",
    "ev",
)
def flt_12h(spark, d):
    """Hour arrays hold one score per hour of the day: 24 entries."""
    ok = F.count_if(F.col("backup_type") != "error").cast("double")
    per_hour = b.events(spark, d).groupBy("tenant_id", F.hour("timestamp").alias("h")).agg((ok / F.count(F.lit(1))).alias("s"))
    hours = [F.max(F.when(F.col("h") == h, F.col("s"))) for h in range(24)]
    return filters.optimal_hours(per_hour.groupBy("tenant_id").agg(F.array(*hours).alias("scores")), "scores", 0.8)


@query(
    "flt_13_browse_directory",
    "SELECT DISTINCT path FROM snapshots WHERE path LIKE '/set4/Box4/%'",
    "snapshots",
)
def flt_13(spark, d):
    return filters.children(b.snapshots(spark, d), "/set4/Box4").select("path").distinct()


# --- orderings ---------------------------------------------------------------------------------


@query(
    "srt_01_newest_first",
    "SELECT job_id, device_id, created_at FROM jobs WHERE device_id = 7",
    "jobs",
)
def srt_01(spark, d):
    return sorting.newest_first(filters.by_key(b.jobs(spark, d), "device_id", 7), "created_at", "job_id").select(
        "job_id", "device_id", "created_at"
    )


@query(
    "srt_02_page",
    """WITH p AS (SELECT job_id, created_at FROM jobs WHERE status = 'RUNNING')
       SELECT job_id, created_at, (SELECT count(*) FROM p) AS total_rows,
       CAST(ceil((SELECT count(*) FROM p) / 20.0) AS BIGINT) AS total_pages
       FROM p ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40""",
    "jobs",
)
def srt_02(spark, d):
    running = filters.with_status(b.jobs(spark, d), ["RUNNING"]).select("job_id", "created_at")
    return sorting.page(running, 2, 20, "created_at", "job_id")


@query(
    "srt_03_schedule_rank",
    """SELECT job_id, coalesce(priority, 1) * 10 - least(10.0::DOUBLE, size / 1000000.0::DOUBLE) AS optimization_score FROM jobs""",
    "jobs",
)
def srt_03(spark, d):
    rows = b.jobs(spark, d).withColumn("estimated_size", F.col("size"))
    return sorting.rank_schedule(rows, "job_id").select("job_id", "optimization_score")


@query(
    "srt_04_newest_changes",
    """SELECT event_id, "timestamp" FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000""",
    "ev",
)
def srt_04(spark, d):
    return sinks.newest(b.events(spark, d).select("event_id", "timestamp"), ["timestamp", "event_id"], 1000)


@query(
    "srt_04_newest_per_device",
    """SELECT device_id, event_id, "timestamp" FROM ev
       QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY "timestamp" DESC, event_id DESC) <= 20""",
    "ev",
)
def srt_04k(spark, d):
    rows = b.events(spark, d).select("device_id", "event_id", "timestamp")
    return sorting.newest_per_key(rows, ["device_id"], ["timestamp", "event_id"], 20)


_HEALTH = ["cpu_usage", "memory_usage", "disk_io", "network_io", "backup_speed"]


@query(
    "srt_05_top_metrics",
    """WITH z AS (SELECT event_id, [{'s': abs(cpu_usage - 50), 'p': 0, 'n': 'cpu_usage'},
          {'s': abs(memory_usage - 50), 'p': 1, 'n': 'memory_usage'}, {'s': abs(disk_io - 50), 'p': 2, 'n': 'disk_io'},
          {'s': abs(network_io - 50), 'p': 3, 'n': 'network_io'}, {'s': abs(backup_speed - 50), 'p': 4, 'n': 'backup_speed'}] AS a
        FROM health) SELECT event_id, list_sort(a)[4].n || ',' || list_sort(a)[5].n AS affected FROM z""",
    "ev health",
)
def srt_05(spark, d):
    distance = {m: F.col(m) - 50 for m in _HEALTH}
    return b.health_metrics(spark, d).select("event_id", F.array_join(sorting.top_metrics(distance), ",").alias("affected"))


@query(
    "srt_06_best_window",
    """SELECT tenant_id, hour_ts, quality_score FROM scores
       QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY quality_score DESC, hour_ts) = 1""",
    "ev scores",
)
def srt_06(spark, d):
    rows = b.hourly_scores(spark, d).select("tenant_id", "hour_ts", "quality_score")
    return sorting.best_by(rows, ["tenant_id"], "quality_score", F.col("hour_ts"))


@query(
    "srt_07_log_tail",
    """SELECT event_id, "timestamp" FROM ev WHERE backup_type = 'error' ORDER BY "timestamp" DESC, event_id DESC LIMIT 100""",
    "ev",
)
def srt_07(spark, d):
    tail = sorting.log_tail(b.events(spark, d).withColumnRenamed("backup_type", "level"), "error", 100, "timestamp", "event_id")
    return tail.select("event_id", "timestamp")


# --- functions ---------------------------------------------------------------------------------


@query(
    "fn_01_format_bytes",
    """SELECT job_id, CASE WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE)
         WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0::DOUBLE, 1))
         WHEN size < 1073741824 THEN printf('%.1f MB', round(size / 1048576.0::DOUBLE, 1))
         ELSE printf('%.1f GB', round(size / 1073741824.0::DOUBLE, 1)) END AS size_text FROM jobs""",
    "jobs",
)
def fn_01(spark, d):
    return b.jobs(spark, d).select("job_id", text.format_bytes(F.col("size")).alias("size_text"))


@query(
    "fn_02_format_age",
    """SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago'
         WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE (m // 10080) || 'w ago' END AS age,
         CASE WHEN a < 60000 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago'
         ELSE (m // 1440) || 'd ago' END AS age_short
       FROM (SELECT event_id, a, a // 60000 AS m FROM (
         SELECT event_id, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms("timestamp") AS a FROM ev))""",
    "ev",
)
def fn_02(spark, d):
    when, now = F.unix_millis(F.col("timestamp").cast("timestamp")), F.unix_millis(F.lit("2024-01-31").cast("timestamp"))
    return b.events(spark, d).select(
        "event_id", text.format_age(when, now).alias("age"), text.format_age_short(when, now).alias("age_short")
    )


@query(
    "fn_03_uptime_and_names",
    """SELECT job_id, CASE WHEN u >= 86400 THEN (u // 86400) || 'd ' || (u % 86400 // 3600) || 'h ' || (u % 3600 // 60) || 'm'
         WHEN u >= 3600 THEN (u // 3600) || 'h ' || (u % 3600 // 60) || 'm' ELSE (u // 60) || 'm' END AS uptime,
         CASE WHEN size >= 1000000 THEN printf('%.1fM', round(size / 1000000.0::DOUBLE, 1))
              WHEN size >= 1000 THEN printf('%.1fK', round(size / 1000.0::DOUBLE, 1)) ELSE CAST(size AS VARCHAR) END AS size_text,
         CASE status WHEN 'FAILED' THEN 'Job FAILED' WHEN 'RUNNING' THEN 'Job RUNNING' WHEN 'PAUSED' THEN 'Job PAUSED'
              ELSE 'Job COMPLETED' END AS label
       FROM (SELECT *, duration * 31 AS u FROM jobs)""",
    "jobs",
)
def fn_03(spark, d):
    return b.jobs(spark, d).select(
        "job_id",
        text.format_uptime(F.col("duration") * 31).alias("uptime"),
        text.format_count(F.col("size")).alias("size_text"),
        text.title_service(F.concat(F.lit("job-"), F.col("status"))).alias("label"),
    )


@query(
    "fn_04_time_features",
    """SELECT event_id, hour(t) AS "hour", isodow(t) - 1 AS day_of_week, day(t) AS day_of_month, month(t) AS "month",
       quarter(t) AS quarter, CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend,
       CASE WHEN hour(t) BETWEEN 9 AND 17 THEN 1 ELSE 0 END::BIGINT AS is_business_hours
       FROM (SELECT event_id, "timestamp" AS t FROM ev)""",
    "ev",
)
def fn_04(spark, d):
    return b.events(spark, d).select("event_id", *[c.alias(n) for n, c in features.time_features(F.col("timestamp")).items()])


@query(
    "fn_05_cyclical_features",
    """SELECT event_id, round(sin(hour(t) * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour(t) * 2 * pi() / 24), 9) AS hour_cos,
       round(sin((isodow(t) - 1) * 2 * pi() / 7), 9) AS day_sin, round(cos((isodow(t) - 1) * 2 * pi() / 7), 9) AS day_cos
       FROM (SELECT event_id, "timestamp" AS t FROM ev)""",
    "ev",
)
def fn_05(spark, d):
    cols = features.cyclical_features(F.col("timestamp"))
    # Adding zero turns a rounded -0.0 into 0.0.
    return b.events(spark, d).select("event_id", *[(F.round(c, 9) + 0.0).alias(n) for n, c in cols.items()])


@query(
    "fn_06_schedule_score",
    """SELECT job_id, coalesce(priority, 1) * 10 - least(10.0::DOUBLE, coalesce(estimated_duration, 1000000) / 1000000.0::DOUBLE)
       AS score FROM jobs""",
    "jobs",
)
def fn_06(spark, d):
    return b.jobs(spark, d).select(
        "job_id", features.schedule_score(F.col("priority"), F.col("estimated_duration")).alias("score")
    )


@query(
    "fn_07_estimators",
    """SELECT job_id, greatest(0.7::DOUBLE, least(0.99::DOUBLE, 1.0::DOUBLE - duration / 3600.0::DOUBLE * 0.1::DOUBLE)) AS success_rate,
       greatest(30.0::DOUBLE, duration::DOUBLE) AS duration, least(80.0::DOUBLE, priority * 0.01::DOUBLE) AS cpu,
       least(90.0::DOUBLE, size / 1000000.0::DOUBLE) AS memory, least(100.0::DOUBLE, size / 100000.0::DOUBLE) AS network FROM jobs""",
    "jobs",
)
def fn_07(spark, d):
    needs = features.resource_needs(F.col("priority"), F.col("size"))
    return b.jobs(spark, d).select(
        "job_id",
        features.success_rate(F.col("duration")).alias("success_rate"),
        features.floor_duration(F.col("duration").cast("double")).alias("duration"),
        *[c.alias(n) for n, c in needs.items()],
    )


@query(
    "fn_08_recommendations",
    """SELECT job_id, array_to_string(list_filter([
         CASE WHEN duration > 1800 THEN 'Consider running backup during off-peak hours' END,
         CASE WHEN 1.0::DOUBLE - duration / 3600.0::DOUBLE * 0.1::DOUBLE < 0.9::DOUBLE
              THEN 'Check network stability before starting backup' END,
         CASE WHEN size > 10000000 THEN 'Enable compression to reduce transfer time' END], lambda x: x IS NOT NULL), '|') AS advice
       FROM jobs""",
    "jobs",
)
def fn_08(spark, d):
    rate = features.success_rate(F.col("duration"))
    return b.jobs(spark, d).select(
        "job_id", F.array_join(features.backup_advice(F.col("duration"), rate, F.col("size")), "|").alias("advice")
    )


@query(
    "fn_09_string_hash",
    """SELECT snapshot_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (
         SELECT snapshot_id, list_reduce([ascii(c)::BIGINT for c in string_split(path, '')],
           lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS u FROM snapshots)""",
    "snapshots",
)
def fn_09(spark, d):
    return b.snapshots(spark, d).select("snapshot_id", features.java_hash(F.col("path")).alias("h"))


@query(
    "fn_10_paths",
    """SELECT page_id, CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END AS parent,
       regexp_extract(p, '[^/]*$') AS name, lower(regexp_extract(p, '\\.([^./]*)$', 1)) AS ext,
       '/data/' || page_id AS tenant_root, CASE WHEN page_id % 2 = 0 THEN 'r' ELSE '-' END || 'w-' AS permissions
       FROM (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS p FROM pages)""",
)
def fn_10(spark, d):
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", ""))
    return b.read(spark, d, "pages").select(
        "page_id",
        text.parent_path(path).alias("parent"),
        text.base_name(path).alias("name"),
        text.extension(path).alias("ext"),
        text.tenant_root(F.col("page_id")).alias("tenant_root"),
        text.permission_text(F.col("page_id") % 2 == 0, F.lit(True), F.lit(False)).alias("permissions"),
    )


@query("fn_11_digests", "SELECT doc_id AS file_id, sha256(encode(text)) AS digest FROM documents")
def fn_11(spark, d):
    return b.files(spark, d).select("file_id", features.digest(F.col("data")).alias("digest"))


@query(
    "fn_12_saved_ratio",
    "SELECT job_id, CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE (size - stored_size) / size::DOUBLE END AS saved FROM jobs",
    "jobs",
)
def fn_12(spark, d):
    return b.jobs(spark, d).select("job_id", features.saved_ratio(F.col("size"), F.col("stored_size")).alias("saved"))


@query(
    "fn_13_feature_defaults",
    """SELECT job_id, size::DOUBLE AS total_size, coalesce(estimated_duration::DOUBLE, 70.0::DOUBLE) AS device_memory,
       100.0::DOUBLE AS network_speed FROM jobs""",
    "jobs",
)
def fn_13(spark, d):
    """Map access with defaults; memory falls back to 70 for the regressor, 60 for requests."""
    bag = F.create_map(
        F.lit("total_size"), F.col("size").cast("double"), F.lit("device_memory"), F.col("estimated_duration").cast("double")
    )
    cols = features.with_defaults(F.col("bag"), {"total_size": 1e6, "device_memory": 70.0, "network_speed": 100.0})
    return b.jobs(spark, d).withColumn("bag", bag).select("job_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "fn_14_score_maps",
    """SELECT event_id, round(1.0 / (1.0 + exp(-(size / 10000.0::DOUBLE))), 9) AS logistic,
       round(greatest(0.0::DOUBLE, (size / 10000.0::DOUBLE - 2 + 1) / 2), 9) AS normality_score FROM ev""",
    "ev",
)
def fn_14(spark, d):
    x = F.col("size") / 10000.0
    return b.events(spark, d).select(
        "event_id",
        F.round(features.logistic(x), 9).alias("logistic"),
        F.round(features.normality_score(x - 2), 9).alias("normality_score"),
    )
