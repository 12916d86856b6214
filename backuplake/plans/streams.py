"""Streaming operators run to the end of the given tables and compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.ml import scoring
from backuplake.operators import windows
from backuplake.operators.windows import latest_by
from backuplake.plans.joined import WINDOW_SQL
from backuplake.plans.ordered_work import QUOTA_LIMIT, QUOTA_SQL
from backuplake.plans.registry import query
from backuplake.session import shared_path
from backuplake.sources import bindings as b
from backuplake.sources import committed, readers, sinks
from backuplake.streaming import events as se
from backuplake.streaming import digest_index, stateful
from backuplake.streaming.run import run_to_end


BATCH_BYTES = str(2 << 30)


def _stream(spark, d, name):
    """A given table as a stream, in batches a micro-batch can hold."""
    return b.stream(spark, d, name, maxBytesPerTrigger=BATCH_BYTES)


def _events(spark, d):
    return b.event_columns(_stream(spark, d, "events"))


@query(
    "str_01_watermark",
    """SELECT backup_type, count(*) AS n FROM ev GROUP BY ALL""",
    "ev",
)
def str_01(spark, d):
    """Nothing is late in one pass over the table: all rows stay."""
    return run_to_end(se.with_lateness(_events(spark, d)), "str01").groupBy("backup_type").agg(F.count(F.lit(1)).alias("n"))


_CLOSED = f"""SELECT * FROM ({WINDOW_SQL}) WHERE window_end <= (SELECT max("timestamp") FROM ev) - INTERVAL 10 MINUTE"""


@query("str_02_windowed_stats", _CLOSED, "ev")
def str_02(spark, d):
    """Windows the watermark has closed."""
    return run_to_end(se.windowed_stats(_events(spark, d)), "str02").drop("batch_id")


@query(
    "str_03_batch_sink",
    "SELECT tenant_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY ALL",
    "ev",
)
def str_03(spark, d):
    out = run_to_end(_events(spark, d), "str03")
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(
    "str_04_anomaly_alerts",
    """WITH m AS (SELECT tenant_id, avg(size) AS mu, stddev_pop(size) AS sd FROM ev GROUP BY 1)
       SELECT event_id, tenant_id, 'anomaly' AS alert_kind FROM ev JOIN m USING (tenant_id)
       WHERE 1.0 / (1.0 + exp(-(abs(size - mu) / sd))) > 0.95""",
    "ev",
)
def str_04(spark, d):
    model = scoring.tenant_model(b.events(spark, d), ["tenant_id"], ["size"])
    score = features.logistic(scoring.distance(["size"]))
    path = shared_path(spark, "alerts")
    run_to_end(
        se.anomaly_alerts(_events(spark, d), model, score).select("event_id", "tenant_id"),
        "str04",
        sink=sinks.alert_writer(path, "anomaly"),
    )
    return spark.read.schema("event_id bigint, tenant_id bigint, alert_kind string").parquet(f"{path}/batch_id=*")


def _messages(spark, d):
    """File and chunk updates; deletions are not passed on."""
    rows = _stream(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "chunk_update").when(F.col("l_returnflag") == "A", "file_update").otherwise("ack")
    return rows.select(
        kind.alias("type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("file_key"),
        F.col("l_partkey").alias("chunk_key"),
        F.col("l_suppkey").alias("node_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        b.cents("l_extendedprice").alias("size"),
    )


@query(
    "str_05_routed_upserts",
    """SELECT 'file' AS what, l_orderkey AS "key", arg_max(CAST(round(l_extendedprice * 100) AS BIGINT), (l_shipdate, l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)) AS size
       FROM lineitem WHERE l_returnflag = 'A' GROUP BY 2
       UNION ALL SELECT 'chunk', l_partkey, arg_max(CAST(round(l_extendedprice * 100) AS BIGINT), (l_shipdate, l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey))
       FROM lineitem WHERE l_returnflag = 'N' GROUP BY 2""",
)
def str_05(spark, d):
    files, chunks = shared_path(spark, "file-state"), shared_path(spark, "chunk-state")
    by = ["timestamp", "node_id", "id"]
    run_to_end(
        _messages(spark, d),
        "str05",
        sink=se.route(
            {
                "file_update": se.upsert_writer(files, ["file_key"], by),
                "chunk_update": se.upsert_writer(chunks, ["chunk_key"], by),
            }
        ),
    )
    a = se.current_state(spark, files, ["file_key"], by).select(F.lit("file").alias("what"), F.col("file_key").alias("key"), "size")
    c = se.current_state(spark, chunks, ["chunk_key"], by).select(F.lit("chunk").alias("what"), F.col("chunk_key").alias("key"), "size")
    return a.unionByName(c)


@query(
    "str_06_change_log",
    """SELECT event_id AS id, backup_type AS "type", CAST(device_id AS VARCHAR) AS "key", "timestamp", '{"size":' || size || '}' AS changes
       FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000""",
    "ev",
)
def str_06(spark, d):
    messages = _events(spark, d).withColumnsRenamed({"event_id": "id", "backup_type": "type"})
    log = se.change_log(messages, F.col("device_id").cast("string"), F.struct("size"))
    return sinks.newest(run_to_end(log, "str06"), ["timestamp", "id"], 1000)


@query(
    "str_07_debounced_changes",
    """WITH g AS (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER w <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev
          WINDOW w AS (PARTITION BY tenant_id ORDER BY "timestamp", event_id)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
       SELECT CAST(tenant_id AS VARCHAR) AS path, min("timestamp") AS first_change, max("timestamp") + INTERVAL 5 MINUTE AS settled_at, count(*) AS changes
       FROM s GROUP BY tenant_id, burst HAVING max("timestamp") + INTERVAL 5 MINUTE <= (SELECT max("timestamp") FROM ev) - INTERVAL 10 MINUTE""",
    "ev",
)
def str_07(spark, d):
    """A quiet period of five minutes suits the pace of these events."""
    changes = _events(spark, d).select(F.col("tenant_id").cast("string").alias("path"), "timestamp")
    return run_to_end(se.debounced(changes, quiet="5 minutes"), "str07")


@query(
    "str_08_liveness",
    """SELECT device_id, date_trunc('millisecond', max("timestamp")) AS last_heartbeat FROM ev GROUP BY 1
       HAVING epoch_ms(max("timestamp")) + 30000 < epoch_ms((SELECT max("timestamp") FROM ev)) - 10000""",
    "ev",
)
def str_08(spark, d):
    """Devices silent for thirty seconds of event time when the table ends."""
    return run_to_end(stateful.stale_devices(_events(spark, d).select("device_id", F.col("timestamp").alias("ts"))), "str08")


@query("str_09_quota_admission", QUOTA_SQL, "ev requests")
def str_09(spark, d):
    rows = _events(spark, d).select(
        F.col("event_id").alias("request_id"),
        "tenant_id",
        F.when(F.col("backup_type").isin("view", "click"), "BANDWIDTH").otherwise("STORAGE").alias("resource"),
        F.col("size").alias("amount"),
        F.col("timestamp").alias("ts"),
    )
    path = shared_path(spark, "admission")
    run_to_end(rows, "str09", sink=stateful.admission_writer(path, default_limit=QUOTA_LIMIT))
    return spark.read.parquet(f"{path}/admitted").select("request_id", "admitted", "used_after", "warned")


@query(
    "str_10_dirty_trigger",
    """SELECT device_id, unnest(generate_series(1, n // 1001)) AS trigger_no FROM (
       SELECT device_id, count(DISTINCT block_number) AS n FROM writes GROUP BY 1)""",
    "writes",
)
def str_10(spark, d):
    rows = _stream(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("device_id"),
        F.col("l_partkey").alias("block_number"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    return run_to_end(stateful.dirty_triggers(rows), "str10").select("device_id", "trigger_no")


@query(
    "str_10_dirty_trigger_blocks",
    """SELECT device_id, unnest(generate_series(1, n // 1001)) AS trigger_no FROM (
       SELECT device_id, count(DISTINCT block_number) AS n FROM writes GROUP BY 1)""",
    "writes",
)
def str_10_blocks(spark, d):
    """The same triggers, numbered in blocks: no device's writes are gathered in one task."""
    rows = _stream(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("device_id"),
        F.col("l_partkey").alias("block_number"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    path = shared_path(spark, "dirty")
    run_to_end(rows, "str10blocks", sink=stateful.dirty_trigger_writer(path))
    return spark.read.parquet(f"{path}/triggers").select("device_id", "trigger_no")


@query(
    "str_11_job_progress",
    """SELECT l_orderkey AS job_id, count(*) FILTER (l_returnflag <> 'R') AS processed_files, count(*) AS total_files,
       CAST(floor(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) * 100.0::DOUBLE
         / CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)) AS BIGINT) AS progress FROM lineitem GROUP BY 1""",
)
def str_11(spark, d):
    """The last report of every job."""
    rows = _stream(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), b.cents("l_extendedprice").alias("size"), (F.col("l_returnflag") != "R").alias("is_done")
    )
    path = shared_path(spark, "progress")
    run_to_end(se.job_progress(rows), "str11", mode="update", sink=sinks.batch_writer(path))
    return latest_by(spark.read.parquet(path), ["job_id"], ["batch_id"]).select(
        "job_id", "processed_files", "total_files", "progress"
    )


# Two jobs of three plan the files that are done; every third plans all, and so never ends.
_PLANNED = "(l_returnflag <> 'R' OR l_suppkey % 3 = 0)"


@query(
    "str_11_progress_until_done",
    f"""WITH j AS (SELECT l_suppkey AS job_id, count(*) FILTER (l_returnflag <> 'R') AS processed_files, count(*) AS total_files,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag <> 'R') AS done, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total
             FROM lineitem WHERE {_PLANNED} GROUP BY 1)
       SELECT job_id, processed_files, total_files, CASE WHEN processed_files = total_files THEN 100 ELSE least(99, CAST(done * 100 // total AS BIGINT)) END AS progress
       FROM j WHERE processed_files > 0""",
)
def str_11_done(spark, d):
    """The last report of every job, from a plan and a stream that names every finished file twice."""
    size = b.cents("l_extendedprice").alias("size")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("file_id")
    planned = b.read(spark, d, "lineitem").filter(_PLANNED).select(F.col("l_suppkey").alias("job_id"), size)
    plan = planned.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_bytes"))
    done = _stream(spark, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("job_id"), name, size)
    path = shared_path(spark, "progress")
    reports = stateful.progress_until_done(done.unionByName(done), plan)
    run_to_end(reports, "str11done", mode="update", sink=sinks.batch_writer(path))
    return latest_by(spark.read.parquet(path), ["job_id"], ["batch_id"]).select("job_id", "processed_files", "total_files", "progress")


@query(
    "snk_01_committed_batches",
    "SELECT tenant_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY ALL",
    "ev",
)
def snk_01_committed(spark, d):
    """A stream through the committing sink, and a batch tried twice beside it."""
    root, check = shared_path(spark, "committed"), shared_path(spark, "check")
    small = F.col("size") < 10_000
    cols = ["event_id", "tenant_id", "size"]
    committed.stream_to_end(_events(spark, d).filter(small).select(*cols), root, "small", check)
    large = b.events(spark, d).filter(~small).select(*cols)
    for _ in range(2):
        committed.append(large, root, "large", 0)
    rows = committed.read(spark, root, "event_id bigint, tenant_id bigint, size bigint")
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(
    "snk_05_committed_alerts",
    f"""SELECT event_id AS id, size AS amount, 'anomaly' AS alert_kind FROM ev WHERE size > 20000
        UNION ALL SELECT request_id, used_after, 'quota' FROM ({QUOTA_SQL}) WHERE warned""",
    "ev requests",
)
def snk_05_committed(spark, d):
    """Anomalies of a stream and quota warnings, the warnings tried twice."""
    root, check = shared_path(spark, "alerts"), shared_path(spark, "check")
    large = _events(spark, d).filter("size > 20000").select(F.col("event_id").alias("id"), F.col("size").alias("amount"))
    committed.stream_to_end(large, root, "anomaly", check)
    usage = windows.consume_quota(b.quota_requests(spark, d), default_limit=QUOTA_LIMIT)
    warned = usage.filter("warned").select(F.col("request_id").alias("id"), F.col("used_after").alias("amount"))
    for _ in range(2):
        committed.append(warned, root, "quota", 0)
    return committed.read(spark, root, "id bigint, amount bigint").select("id", "amount", F.col("log").alias("alert_kind"))


@query("str_12_chunk_dedup", "SELECT DISTINCT l_partkey AS digest FROM lineitem")
def str_12(spark, d):
    """The index after the last batch."""
    rows = _stream(spark, d, "lineitem").select(F.col("l_partkey").alias("digest"))
    path = shared_path(spark, "chunk-index")
    run_to_end(rows, "str12", sink=se.first_seen_writer(path))
    return spark.read.parquet(path).select("digest")


@query("str_12_digest_index", "SELECT DISTINCT l_partkey AS digest FROM lineitem")
def str_12_index(spark, d):
    """The new digests of all batches: those of lines shipped early, of a stream of all, and of the early ones again."""
    rows = b.read(spark, d, "lineitem").select(F.col("l_partkey").alias("digest"), "l_shipdate")
    early = rows.filter("l_shipdate < TIMESTAMP_NTZ'1995-01-01'")
    path = shared_path(spark, "digest-index")
    digest_index.add(early, 0, path)
    stream = _stream(spark, d, "lineitem").select(F.col("l_partkey").alias("digest"))
    run_to_end(stream, "str12index", sink=lambda batch, n: digest_index.add(batch, n + 1, path))
    last = spark.read.parquet(f"{path}/steps").agg(F.max("batch_id")).first()[0]
    digest_index.add(early, last + 1, path)
    return digest_index.new_digests(spark, path, "bigint").select("digest")
