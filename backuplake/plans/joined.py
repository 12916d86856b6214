"""Joins and aggregations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from backuplake.operators import aggregates as agg
from backuplake.operators import file_sets, filters, joins, merkle, sets, sketches
from backuplake.plans.registry import query
from backuplake.session import pin
from backuplake.sources import bindings as b


def _index(spark, d):
    """The chunk index of the stored files: one row per digest."""
    return (
        b.chunked_files(spark, d)
        .select(F.explode("chunks").alias("chunk_id"), "file_id", "lang")
        .groupBy("chunk_id")
        .agg(F.min("file_id").alias("first_file"), F.min("lang").alias("first_lang"))
    )


@query(
    "jn_01_file_chunks",
    """WITH idx AS (SELECT chunk_id, min(file_id) AS first_file FROM chunks GROUP BY 1 HAVING min(lang) <> 'de')
       SELECT path, pos, chunk_id, first_file FROM chunks JOIN idx USING (chunk_id)""",
    "pieces chunks",
)
def jn_01(spark, d):
    """The index here lacks the chunks of German files: those must drop out."""
    known = _index(spark, d).filter("first_lang <> 'de'").select("chunk_id", "first_file")
    return joins.file_chunks(b.chunked_files(spark, d), known).select("path", "pos", "chunk_id", "first_file")


@query(
    "jn_02_orphan_chunks",
    """SELECT chunk_id, size FROM chunk_index WHERE chunk_id NOT IN (
       SELECT chunk_id FROM versions WHERE NOT is_deleted)""",
    "chunk_index versions",
)
def jn_02(spark, d):
    live = b.versions(spark, d).filter(~F.col("is_deleted"))
    return joins.orphan_chunks(b.chunk_index(spark, d), live).select("chunk_id", "size")


_USAGE = """use AS (SELECT tenant_id, resource, CAST(sum(amount) AS BIGINT) AS used FROM requests
    WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL),
    quo AS (SELECT DISTINCT tenant_id, 'STORAGE' AS resource, 900000 + tenant_id * 10000 AS quota_limit FROM ev WHERE tenant_id > 2)"""


@query(
    "jn_03_quota_check",
    f"""WITH {_USAGE} SELECT r.request_id, r.tenant_id, r.resource, coalesce(used, 0) AS used,
        coalesce(quota_limit, 1000000) AS quota_limit, coalesce(used, 0) + amount <= coalesce(quota_limit, 1000000) AS admitted
        FROM requests r LEFT JOIN use USING (tenant_id, resource) LEFT JOIN quo USING (tenant_id, resource)
        WHERE ts >= TIMESTAMP '2024-01-10'""",
    "ev requests",
)
def jn_03(spark, d):
    requests = b.quota_requests(spark, d)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    usage = requests.filter(F.col("ts") < cut).groupBy("tenant_id", "resource").agg(F.sum("amount").alias("used"))
    quotas = (
        b.events(spark, d)
        .filter("tenant_id > 2")
        .select("tenant_id", F.lit("STORAGE").alias("resource"))
        .distinct()
        .withColumn("quota_limit", 900_000 + F.col("tenant_id") * 10_000)
    )
    out = joins.quota_check(requests.filter(F.col("ts") >= cut), usage, quotas, default_limit=1_000_000)
    return out.select("request_id", "tenant_id", "resource", "used", "quota_limit", "admitted")


@query(
    "jn_04_duplicate_flags",
    """SELECT file_id, pos, chunk_id, chunk_id IN (SELECT chunk_id FROM chunks WHERE lang = 'en') AS is_duplicate FROM chunks""",
    "pieces chunks",
)
def jn_04(spark, d):
    """The English files are stored; all files arrive."""
    rows = b.chunked_files(spark, d).select("file_id", "lang", F.posexplode("chunks").alias("pos", "chunk_id"))
    stored = rows.filter("lang = 'en'")
    return joins.duplicate_flags(rows.drop("lang"), stored, "chunk_id")


@query(
    "jn_05_restore_plan",
    "SELECT file_id AS restore_id, file_id AS backup_id, path, pos, chunk_id FROM chunks",
    "pieces chunks",
)
def jn_05(spark, d):
    """One request per file."""
    manifest = b.chunked_files(spark, d).select(F.col("file_id").alias("backup_id"), "path", "chunks")
    requests = manifest.select(F.col("backup_id").alias("restore_id"), "backup_id", F.array("path").alias("files"))
    plan = joins.restore_plan(requests, manifest, _index(spark, d).select("chunk_id"))
    return plan.select("restore_id", "backup_id", "path", "pos", "chunk_id")


# The newest row per device and path, however old, unless that is a deletion.
_STATE = """(SELECT * FROM (SELECT device_id, path, arg_max({{'c': checksum, 'd': is_deleted}}, (created_at, snapshot_id)) AS s
      FROM snapshots WHERE {} GROUP BY ALL) WHERE NOT s.d)"""
_DIFF = f"""SELECT coalesce(a.device_id, n.device_id) AS device_id, coalesce(a.path, n.path) AS path,
    a.s.c AS old_checksum, n.s.c AS new_checksum,
    CASE WHEN a.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN a.s.c = n.s.c THEN 'unchanged'
         ELSE 'modified' END AS change
    FROM {_STATE.format("created_at < TIMESTAMP '1999-01-01'")} a
    FULL JOIN {_STATE.format("true")} n ON a.device_id = n.device_id AND a.path = n.path"""


def _diff(spark, d):
    """The state at the start of 1999 against the state at the end of the table."""
    keys = ["device_id", "path"]
    rows = b.snapshots(spark, d)
    return joins.snapshot_diff(joins.state_as_of(rows, keys, "1999-01-01"), joins.state_as_of(rows, keys), keys)


@query("jn_06_snapshot_diff", _DIFF, "snapshots")
def jn_06(spark, d):
    return _diff(spark, d)


@query("jn_06_merkle_diff", _DIFF, "snapshots")
def jn_06_merkle(spark, d):
    """The same diff by digests of folders: equal subtrees are not joined."""
    keys, rows = ["device_id"], b.snapshots(spark, d)
    old, new = (merkle.digested(joins.state_as_of(rows, [*keys, "path"], at), keys) for at in ("1999-01-01", None))
    return merkle.compare(old, new).changes


@query(
    "jn_07_lineage",
    """WITH RECURSIVE up(snapshot_id, base_id, depth) AS (
         SELECT job_id, job_id, 0::BIGINT FROM jobs WHERE job_id % 8 = 0
         UNION ALL SELECT j.job_id, up.base_id, up.depth + 1 FROM jobs j JOIN up ON j.job_id - 1 = up.snapshot_id
         WHERE j.job_id % 8 <> 0)
       SELECT snapshot_id, base_id, depth FROM up""",
    "jobs",
)
def jn_07(spark, d):
    """Chains of seven incrementals on a full backup, in job order."""
    job = F.col("job_id")
    chain = b.jobs(spark, d).select(job.alias("snapshot_id"), F.when(job % 8 != 0, job - 1).alias("parent_id"))
    return joins.lineage(chain)


# Every key's first three distinct nodes, by comparing it with the whole ring.
_REPLICAS = """SELECT chunk_id, node_id, row_number() OVER (PARTITION BY chunk_id ORDER BY first_at) - 1 AS replica
    FROM (SELECT k.chunk_id, r.node_id, min(CASE WHEN r.ring_hash >= k.h THEN r.ring_hash ELSE r.ring_hash + 4294967296 END) AS first_at
          FROM (SELECT chunk_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (
                  SELECT chunk_id, list_reduce([ascii(c)::BIGINT for c in string_split('chunk-' || chunk_id, '')],
                    lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS u FROM chunk_index)) k, ring r
          GROUP BY k.chunk_id, r.node_id)
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY first_at) <= 3"""


def _placed(spark, d):
    ring = joins.ring_points(b.nodes(spark, d))
    keys = b.chunk_index(spark, d).select("chunk_id", F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("label"))
    return joins.replicas(keys, "label", ring, 3), ring


@query("jn_08_replicas", _REPLICAS, "nodes ring chunk_index")
def jn_08(spark, d):
    placed, _ring = _placed(spark, d)
    return placed.select("chunk_id", "node_id", "replica")


FAILOVER_SQL = """SELECT f.node_id, arg_min(r.node_id, CASE WHEN r.ring_hash > f.h THEN r.ring_hash ELSE r.ring_hash + 4294967296 END)
    AS next_node_id FROM (SELECT node_id, min(ring_hash) AS h FROM ring GROUP BY 1) f, ring r
    WHERE r.node_id <> f.node_id GROUP BY f.node_id"""


@query("jn_09_failover", FAILOVER_SQL, "nodes ring")
def jn_09(spark, d):
    return joins.failover_nodes(joins.ring_points(b.nodes(spark, d)))


@query(
    "jn_10_update_recipients",
    """SELECT event_id, device_id, (SELECT count(*) FROM devices WHERE is_online)
         - CASE WHEN device_id IN (SELECT device_id FROM devices WHERE is_online) THEN 1 ELSE 0 END AS recipients FROM ev""",
    "ev devices",
)
def jn_10(spark, d):
    peers = b.devices(spark, d).select("device_id", F.col("is_online").alias("is_open"))
    return joins.recipient_counts(b.events(spark, d).select("event_id", "device_id"), peers)


@query("jn_10_inbox", "SELECT event_id, device_id, 7::BIGINT AS peer_id FROM ev WHERE device_id <> 7", "ev")
def jn_10i(spark, d):
    return joins.inbox(b.events(spark, d).select("event_id", "device_id"), 7).withColumn("peer_id", F.col("peer_id").cast("bigint"))


@query(
    "jn_11_job_summary",
    """SELECT j.job_id, j.device_id, j.status, coalesce(n, 0) AS file_count, coalesce(s, 0) AS total_size,
       CAST(epoch(last) - epoch(j.created_at) AS BIGINT) AS duration_seconds
       FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS s, max(created_at) AS last
                              FROM snapshots GROUP BY 1) USING (job_id)""",
    "jobs snapshots",
)
def jn_11(spark, d):
    return joins.job_summary(b.jobs(spark, d), b.snapshots(spark, d))


_METRICS = """SELECT count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
    CAST(sum(size) FILTER (status = 'COMPLETED') AS BIGINT) AS bytes_backed_up,
    CAST(sum(size) FILTER (status = 'COMPLETED') AS DOUBLE) / CAST(sum(stored_size) FILTER (status = 'COMPLETED') AS BIGINT) AS compression_ratio,
    avg(duration) FILTER (status = 'COMPLETED') AS average_duration, count(*) FILTER (status = 'RUNNING') AS active,
    count(*) FILTER (status = 'QUEUED') AS queued, count(DISTINCT device_id) AS devices FROM jobs"""


@query(
    "jn_12_performance_report",
    f"""WITH m AS ({_METRICS}), n AS (SELECT CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(used) AS BIGINT) AS used FROM nodes)
        SELECT average_duration, compression_ratio, completed::DOUBLE / (completed + failed) * 100 AS success_rate,
        used::DOUBLE / capacity * 100 AS used_percent FROM m, n""",
    "jobs nodes",
)
def jn_12(spark, d):
    both = joins.beside(agg.backup_metrics(b.jobs(spark, d)), agg.storage_use(b.nodes(spark, d)))
    return both.select(
        "average_duration",
        "compression_ratio",
        agg.success_rate(F.col("completed"), F.col("failed")).alias("success_rate"),
        "used_percent",
    )


# --- aggregations ------------------------------------------------------------------------------

WINDOW_SQL = """SELECT s AS window_start, s + INTERVAL 5 MINUTE AS window_end, tenant_id, backup_type, count(*) AS backup_count,
    avg(size) AS avg_size, CAST(sum(size) AS BIGINT) AS total_size, avg(duration) AS avg_duration
    FROM (SELECT *, date_trunc('minute', "timestamp") - to_minutes(k) AS s FROM ev, generate_series(0, 4) g(k)) GROUP BY ALL"""


@query("agg_01_windowed_stats", WINDOW_SQL, "ev")
def agg_01(spark, d):
    return agg.windowed_stats(b.events(spark, d))


@query(
    "agg_02_bytes_per_device",
    """SELECT d.device_id, total_size FROM devices d LEFT JOIN
       (SELECT device_id, CAST(sum(size) AS BIGINT) AS total_size FROM snapshots GROUP BY 1) USING (device_id)""",
    "devices snapshots",
)
def agg_02(spark, d):
    return agg.bytes_per_device(b.snapshots(spark, d), b.devices(spark, d))


@query("agg_03_count_by_status", "SELECT status, device_id, count(*) AS job_count FROM jobs GROUP BY ALL", "jobs")
def agg_03(spark, d):
    return agg.count_by_status(b.jobs(spark, d))


@query(
    "agg_04_fleet_stats",
    """SELECT (SELECT count(*) FROM devices) AS total_devices, (SELECT count(*) FROM devices WHERE is_online) AS online_devices,
       (SELECT count(*) FROM versions WHERE NOT is_deleted) AS total_files,
       (SELECT CAST(sum(size) AS BIGINT) FROM versions WHERE NOT is_deleted) AS total_size,
       (SELECT count(*) FROM chunk_index) AS total_chunks, (SELECT count(*) FROM jobs WHERE status = 'RUNNING') AS active_jobs,
       (SELECT count(*) FROM jobs WHERE status = 'COMPLETED') AS completed_jobs,
       (SELECT count(*) FROM jobs WHERE status = 'FAILED') AS failed_jobs,
       greatest((SELECT max(last_sync) FROM devices), (SELECT max(backup_time) FROM versions WHERE NOT is_deleted)) AS last_activity""",
    "devices versions chunk_index jobs",
)
def agg_04(spark, d):
    return agg.fleet_stats(b.devices(spark, d), b.versions(spark, d), b.chunk_index(spark, d), b.jobs(spark, d))


@query("agg_05_backup_metrics", _METRICS, "jobs")
def agg_05(spark, d):
    return agg.backup_metrics(b.jobs(spark, d))


@query(
    "agg_06_success_rate",
    """SELECT device_id, CASE WHEN c + f > 0 THEN c::DOUBLE / (c + f) * 100 ELSE 0.0::DOUBLE END AS success_rate FROM (
       SELECT device_id, count(*) FILTER (status = 'COMPLETED') AS c, count(*) FILTER (status = 'FAILED') AS f FROM jobs GROUP BY 1)""",
    "jobs",
)
def agg_06(spark, d):
    done, failed = [F.count_if(F.col("status") == s) for s in ("COMPLETED", "FAILED")]
    return b.jobs(spark, d).groupBy("device_id").agg(agg.success_rate(done, failed).alias("success_rate"))


@query(
    "agg_07_storage_use",
    """SELECT site, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(used) AS BIGINT) AS used,
       CAST(sum(capacity) - sum(used) AS BIGINT) AS free, CAST(sum(used) AS DOUBLE) / CAST(sum(capacity) AS BIGINT) * 100 AS used_percent
       FROM nodes GROUP BY site""",
    "nodes",
)
def agg_07(spark, d):
    return agg.storage_use(b.nodes(spark, d), ["site"])


@query(
    "agg_08_key_metrics",
    """SELECT count(DISTINCT device_id) AS devices, count(*) AS keys, count(*) FILTER (is_active) AS active_keys FROM keys""",
    "keys",
)
def agg_08(spark, d):
    return agg.key_metrics(b.keys(spark, d))


@query(
    "agg_09_reference_counts",
    """SELECT chunk_id, CAST(sum(CASE WHEN is_deleted THEN -1 ELSE 1 END) AS BIGINT) AS ref_count, count(DISTINCT path) AS file_count
       FROM versions GROUP BY chunk_id""",
    "versions",
)
def agg_09(spark, d):
    changes = b.versions(spark, d).select(
        "chunk_id", F.col("path").alias("file"), F.when(F.col("is_deleted"), -1).otherwise(1).cast("bigint").alias("delta")
    )
    return agg.reference_counts(changes)


@query(
    "agg_09_file_sets",
    """WITH live AS (SELECT DISTINCT chunk_id, path FROM versions EXCEPT SELECT chunk_id, path FROM versions WHERE is_deleted)
       SELECT chunk_id, count(*) AS file_count, min(path) AS first_path, max(path) AS last_path FROM live GROUP BY 1""",
    "versions",
)
def agg_09_sets(spark, d):
    """The files that still hold a chunk, from sets of all references less those deleted."""
    rows = b.versions(spark, d).select("chunk_id", "path", "is_deleted").distinct()
    numbers = file_sets.numbered(rows, "path")
    references = pin(rows.join(numbers, "path").select("chunk_id", "file_no", "is_deleted"), "references")
    stored = pin(file_sets.build(references, "chunk_id"), "file-sets")
    gone = file_sets.build(references.filter("is_deleted"), "chunk_id")
    live = pin(file_sets.combine(stored, gone, "chunk_id", "difference"), "live-sets")
    named = file_sets.members(live, ["chunk_id"]).join(numbers, "file_no")
    ends = named.groupBy("chunk_id").agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    return file_sets.counts(live, "chunk_id").join(ends, "chunk_id")


DEDUP_SQL = """SELECT CAST(sum(n) AS BIGINT) AS total_chunks, count(*) AS unique_chunks, CAST(sum(n * size) AS BIGINT) AS logical_bytes,
    CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(n * size) AS DOUBLE) / CAST(sum(size) AS BIGINT) AS dedup_ratio,
    CAST(sum(n * size) - sum(size) AS BIGINT) AS saved_bytes,
    CAST(sum(n * size) - sum(size) AS DOUBLE) / CAST(sum(n * size) AS BIGINT) AS saved_share
    FROM (SELECT chunk_id, max(size) AS size, count(*) AS n FROM chunks GROUP BY 1)"""


@query("agg_10_dedup_stats", DEDUP_SQL, "pieces chunks")
def agg_10(spark, d):
    from backuplake.jobs import chunking

    rows = chunking.split_fixed(b.files(spark, d), b.CHUNK_BYTES, ["file_id"])
    return agg.dedup_stats(rows.select("digest", F.col("length").alias("size")))


@query(
    "agg_10_span_sketches",
    """WITH r AS (SELECT year("timestamp") AS "year", device_id % 5 AS devices, chunk_id, chunk_id % 1000 + 1 AS size FROM versions)
       SELECT CAST("year" AS BIGINT) AS "year", devices, count(*) AS "references", CAST(sum(size) AS BIGINT) AS bytes,
         count(DISTINCT chunk_id) AS distinct_chunks, CAST(sum(DISTINCT chunk_id * 1000 + size) - 1000 * sum(DISTINCT chunk_id) AS BIGINT) AS distinct_bytes
       FROM r GROUP BY ALL""",
    "versions",
)
def agg_10_spans(spark, d):
    """Distinct chunks per year and group of devices, merged from sketches per day and device; exact up to 4,096."""
    rows = b.versions(spark, d).select(
        F.to_date("timestamp").alias("day"), "device_id", F.col("chunk_id").alias("digest"), (F.col("chunk_id") % 1000 + 1).alias("size")
    )
    stored = pin(sketches.sketch(rows, ["day", "device_id"]), "sketches")
    spans = stored.withColumns({"year": F.year("day").cast("bigint"), "devices": F.col("device_id") % 5})
    keys = ["year", "devices"]
    return sketches.estimates(sketches.merge(spans, keys), keys).drop("relative_error")


@query(
    "agg_11_synthetic_ratios",
    """WITH c AS (SELECT chunk_id, size, stored FROM (SELECT chunk_id, size, size // 3 + 1 AS stored FROM versions WHERE NOT is_deleted)),
       u AS (SELECT chunk_id, max(size) AS one FROM c GROUP BY 1)
       SELECT (SELECT CAST(sum(size) AS BIGINT) FROM c) AS logical_bytes, (SELECT CAST(sum(one) AS BIGINT) FROM u) AS unique_bytes,
       (SELECT CAST(sum(size) AS DOUBLE) FROM c) / (SELECT CAST(sum(one) AS BIGINT) FROM u) AS dedup_ratio,
       (SELECT CAST(sum(size) AS DOUBLE) FROM c) / (SELECT CAST(sum(stored) AS BIGINT) FROM c) AS compression_ratio,
       (SELECT CAST(sum(size) AS BIGINT) FROM versions) AS input_bytes,
       (SELECT CAST(sum(size) AS BIGINT) FROM versions) - (SELECT CAST(sum(one) AS BIGINT) FROM u) AS space_saved""",
    "versions",
)
def agg_11(spark, d):
    rows = b.versions(spark, d)
    live = rows.filter(~F.col("is_deleted")).select(
        F.col("chunk_id").alias("digest"), "size", (F.floor(F.col("size") / 3) + 1).cast("bigint").alias("packed_size")
    )
    return agg.synthetic_ratios(live, rows)


@query(
    "agg_12_series_features",
    """SELECT device_id, avg(size) AS size_mean, round(stddev_samp(size), 6) AS size_std, min(size) AS size_min, max(size) AS size_max,
       avg(duration) AS duration_mean, round(stddev_samp(duration), 6) AS duration_std, round(skewness(duration), 6) AS duration_skew,
       round(kurtosis(duration), 6) AS duration_kurtosis FROM ev GROUP BY device_id""",
    "ev",
)
def agg_12(spark, d):
    out = agg.series_features(b.events(spark, d), ["device_id"], "size", "duration")
    return out.withColumns({c: F.round(c, 6) for c in ["size_std", "duration_std", "duration_skew", "duration_kurtosis"]})


@query(
    "agg_13_series_trend",
    """SELECT device_id, round(CASE WHEN count(*) > 1 THEN regr_slope(size::DOUBLE, i::DOUBLE) ELSE 0 END, 6) AS trend_slope,
       round(CASE WHEN count(*) > 1 THEN corr(size::DOUBLE, nxt::DOUBLE) FILTER (nxt IS NOT NULL) ELSE 0 END, 6) AS lag1_autocorrelation
       FROM (SELECT device_id, size, row_number() OVER w - 1 AS i, lead(size) OVER w AS nxt FROM ev
             WINDOW w AS (PARTITION BY device_id ORDER BY "timestamp", event_id)) GROUP BY device_id""",
    "ev",
)
def agg_13(spark, d):
    out = agg.series_trend(b.events(spark, d), ["device_id"], ["timestamp", "event_id"], "size")
    return out.withColumns({c: F.round(c, 6) for c in ["trend_slope", "lag1_autocorrelation"]})


@query(
    "agg_14_model_evaluation",
    """SELECT device_id, round(avg((duration - size / 100.0::DOUBLE) ** 2), 6) AS mse,
       round(CASE WHEN var_pop(duration) > 0 THEN 1 - avg((duration - size / 100.0::DOUBLE) ** 2) / var_pop(duration) END, 6) AS r2
       FROM ev GROUP BY device_id""",
    "ev",
)
def agg_14(spark, d):
    rows = b.events(spark, d).withColumn("guess", F.col("size") / 100.0)
    return agg.evaluate(rows, "duration", "guess", ["device_id"]).withColumns({c: F.round(c, 6) for c in ["mse", "r2"]})


@query(
    "agg_15_schedule_totals",
    """SELECT CAST(sum(coalesce(estimated_duration, 300)) AS BIGINT) AS time_before,
       round(CAST(sum(coalesce(estimated_duration, 300)) AS BIGINT) * 0.85::DOUBLE, 3) AS time_after, 0.15::DOUBLE AS time_reduction FROM jobs""",
    "jobs",
)
def agg_15(spark, d):
    return agg.schedule_totals(b.jobs(spark, d)).withColumns(
        {"time_after": F.round("time_after", 3), "time_reduction": F.round("time_reduction", 9)}
    )


@query(
    "agg_16_health",
    """SELECT site, bool_and(node_id % 50 <> 0) AND bool_and(used < 280000) AS healthy, count(*) AS services,
       count(*) FILTER (used >= 280000) AS failing FROM nodes GROUP BY site""",
    "nodes",
)
def agg_16(spark, d):
    rows = b.nodes(spark, d).withColumns({"is_up": F.col("node_id") % 50 != 0, "service_ok": F.col("used") < 280_000})
    return agg.health(rows, ["site"])


@query(
    "agg_17_model_usage",
    """SELECT count(*) AS total_predictions, count(*) FILTER (size > 20000) AS total_anomalies,
       count(DISTINCT backup_type) AS active_models FROM ev""",
    "ev",
)
def agg_17(spark, d):
    return agg.model_usage(
        b.events(spark, d).select(F.col("backup_type").alias("model"), (F.col("size") > 20_000).alias("is_anomaly"))
    )


@query(
    "agg_18_dashboard",
    """SELECT count(DISTINCT job_id) AS total_backups, CAST(sum(size) AS BIGINT) AS total_bytes, count(DISTINCT path) AS files_protected,
       max(created_at) AS last_backup FROM snapshots""",
    "snapshots",
)
def agg_18(spark, d):
    return agg.dashboard(b.snapshots(spark, d))


@query(
    "agg_19_job_progress",
    """SELECT job_id, processed_files, total_files, processed_bytes, total_bytes,
       CAST(floor(processed_bytes * 100.0::DOUBLE / total_bytes) AS BIGINT) AS progress,
       CASE WHEN secs <> 0 THEN processed_bytes::DOUBLE / secs END AS bytes_per_second,
       CASE WHEN secs <> 0 AND processed_bytes <> 0 THEN (total_bytes - processed_bytes)::DOUBLE / (processed_bytes::DOUBLE / secs) END AS eta_seconds
       FROM (SELECT job_id, count(*) FILTER (NOT is_deleted) AS processed_files, count(*) AS total_files,
         CAST(coalesce(sum(size) FILTER (NOT is_deleted), 0) AS BIGINT) AS processed_bytes, CAST(sum(size) AS BIGINT) AS total_bytes,
         CAST(epoch(max(created_at) FILTER (NOT is_deleted)) - epoch(min(created_at) FILTER (NOT is_deleted)) AS BIGINT) AS secs
         FROM snapshots GROUP BY job_id)""",
    "snapshots",
)
def agg_19(spark, d):
    rows = b.snapshots(spark, d).select(
        "job_id", "size", (~F.col("is_deleted")).alias("is_done"), F.col("created_at").alias("done_at")
    )
    return agg.job_progress(rows)


@query(
    "agg_20_job_statistics",
    """SELECT job_id, count(*) FILTER (backup_type = 'FULL' AND NOT is_deleted) AS files_processed,
       count(*) FILTER (backup_type <> 'FULL' AND NOT is_deleted) AS files_skipped, count(*) FILTER (is_deleted) AS files_errored,
       CAST(coalesce(sum(size) FILTER (backup_type = 'FULL' AND NOT is_deleted), 0) AS BIGINT) AS original_size,
       CAST(coalesce(sum(size // 3) FILTER (backup_type = 'FULL' AND NOT is_deleted), 0) AS BIGINT) AS stored_size,
       CAST(sum(size) FILTER (backup_type = 'FULL' AND NOT is_deleted) AS DOUBLE)
         / CAST(sum(size // 3) FILTER (backup_type = 'FULL' AND NOT is_deleted) AS BIGINT) AS compression_ratio,
       CAST(epoch(max(created_at)) - epoch(min(created_at)) AS BIGINT) AS duration_seconds FROM snapshots GROUP BY job_id""",
    "snapshots",
)
def agg_20(spark, d):
    outcome = F.when(F.col("is_deleted"), "error").when(F.col("backup_type") == "FULL", "processed").otherwise("skipped")
    rows = b.snapshots(spark, d).select(
        "job_id",
        outcome.alias("outcome"),
        "size",
        F.floor(F.col("size") / 3).cast("bigint").alias("stored_size"),
        F.col("created_at").alias("at"),
    )
    return agg.job_statistics(rows)


@query(
    "agg_21_directory_tree",
    """WITH p AS (SELECT '/set' || (l_partkey % 20) AS d1, '/Box' || (l_partkey % 7) AS d2 FROM lineitem)
       SELECT '/' AS directory, 0::BIGINT AS depth, 0::BIGINT AS file_count, count(DISTINCT d1) AS dir_count FROM p
       UNION ALL SELECT d1, 1, 0, count(DISTINCT d2) FROM p GROUP BY d1
       UNION ALL SELECT d1 || d2, 2, count(*), 0 FROM p GROUP BY d1, d2""",
)
def agg_21(spark, d):
    return agg.directory_tree(b.snapshots(spark, d))


@query(
    "agg_22_file_set_features",
    f"""WITH df AS ({_DIFF}), s AS (SELECT device_id, count(DISTINCT regexp_extract(path, '\\.([^.]*)$', 1))::DOUBLE / count(*) AS file_type_diversity,
          avg(size) AS average_file_size FROM snapshots GROUP BY 1),
        r AS (SELECT device_id, count(*) FILTER (change = 'modified')::DOUBLE / nullif(count(*) FILTER (change <> 'deleted'), 0) AS modified_files_ratio,
          count(*) FILTER (change = 'new')::DOUBLE / nullif(count(*) FILTER (change <> 'deleted'), 0) AS new_files_ratio FROM df GROUP BY 1)
        SELECT device_id, file_type_diversity, average_file_size, modified_files_ratio, new_files_ratio FROM s LEFT JOIN r USING (device_id)""",
    "snapshots",
)
def agg_22(spark, d):
    return agg.file_set_features(b.snapshots(spark, d), _diff(spark, d), ["device_id"])


@query(
    "agg_23_placement_outcome",
    f"""SELECT chunk_id, count(*) FILTER ((chunk_id + node_id) % 5 <> 0) AS uploaded,
        CASE WHEN count(*) FILTER ((chunk_id + node_id) % 5 <> 0) >= 3 THEN 'SUCCESS'
             WHEN count(*) FILTER ((chunk_id + node_id) % 5 <> 0) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS outcome
        FROM ({_REPLICAS}) GROUP BY chunk_id""",
    "nodes ring chunk_index",
)
def agg_23(spark, d):
    placed, _ring = _placed(spark, d)
    failed = (F.col("chunk_id") + F.col("node_id")) % 5 == 0
    return agg.placement_outcome(placed.withColumn("status", F.when(failed, "FAILED").otherwise("UPLOADED")))


@query(
    "set_03_referenced_chunks",
    "SELECT DISTINCT chunk_id FROM chunks WHERE lang <> 'fr'",
    "pieces chunks",
)
def set_03(spark, d):
    """French files are soft-deleted and refer to nothing."""
    rows = b.chunked_files(spark, d).withColumn("is_deleted", F.col("lang") == "fr")
    return sets.referenced_chunks(rows)


@query("flt_11_live_files", "SELECT path, device_id, version FROM versions WHERE NOT is_deleted", "versions")
def flt_11f(spark, d):
    rows = b.versions(spark, d).withColumn("is_live", ~F.col("is_deleted"))
    return filters.flagged(rows, "is_live").select("path", "device_id", "version")
