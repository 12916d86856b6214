"""Per-key ordering work and replica set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from backuplake.operators import replicated, sets, windows
from backuplake.plans.registry import query
from backuplake.session import pin
from backuplake.sources import bindings as b

_VERSION_COLUMNS = ["path", "device_id", "version", "chunk_id", "backup_time", "is_deleted"]


@query(
    "win_01_conflict_winner",
    """WITH r AS (SELECT *, CASE device_id WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS rank,
          count(*) FILTER (NOT is_deleted) OVER (PARTITION BY path) AS live FROM versions)
       SELECT path, device_id, backup_time, is_deleted FROM (
         SELECT *, row_number() OVER (PARTITION BY path ORDER BY is_deleted, rank, backup_time DESC, device_id) AS best,
                   row_number() OVER (PARTITION BY path ORDER BY backup_time DESC, device_id) AS own FROM r)
       WHERE CASE WHEN live > 1 THEN best = 1 ELSE own = 1 END""",
    "versions",
)
def win_01(spark, d):
    rows = b.versions(spark, d).select(*_VERSION_COLUMNS)
    return windows.resolve_conflicts(rows, [3, 1, 2]).select("path", "device_id", "backup_time", "is_deleted")


@query(
    "win_02_lww_register",
    """SELECT path, version, "timestamp", node_id FROM versions
       QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC, "timestamp" DESC, node_id DESC) = 1""",
    "versions",
)
def win_02(spark, d):
    return windows.lww_register(b.versions(spark, d).select("path", "version", "timestamp", "node_id"))


@query(
    "win_03_latest_state",
    """SELECT path, chunk_id, backup_time, device_id FROM (SELECT * FROM versions
         QUALIFY row_number() OVER (PARTITION BY path ORDER BY backup_time DESC, version DESC, chunk_id DESC, device_id DESC) = 1)
       WHERE NOT is_deleted""",
    "versions",
)
def win_03(spark, d):
    rows = b.versions(spark, d).select(*_VERSION_COLUMNS)
    base, later = rows.filter("backup_time < '1997-01-01'"), rows.filter("backup_time >= '1997-01-01'")
    state = windows.latest_state(base, later, ["path"], ["backup_time", "version", "chunk_id", "device_id"])
    return state.select("path", "chunk_id", "backup_time", "device_id")


@query(
    "win_04_optimal_windows",
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY hour_ts) AS i,
          lead(hour_ts) OVER (PARTITION BY tenant_id ORDER BY hour_ts) IS NULL AS last FROM scores),
       g AS (SELECT *, epoch(hour_ts) / 3600 - row_number() OVER (PARTITION BY tenant_id ORDER BY hour_ts) AS run FROM m WHERE quality_score > 0.7)
       SELECT tenant_id, min(hour_ts) AS start_time, max(hour_ts) AS end_time, count(*) AS duration_hours,
       round(avg(quality_score), 9) AS avg_quality FROM g GROUP BY tenant_id, run HAVING count(*) >= 2 AND NOT bool_or(last)""",
    "ev scores",
)
def win_04(spark, d):
    return windows.optimal_windows(b.hourly_scores(spark, d), ["tenant_id"]).withColumn(
        "avg_quality", F.round("avg_quality", 9)
    )


@query(
    "win_05_active_key",
    """SELECT device_id, coalesce(arg_min(key_id, (created_at, key_id)) FILTER (is_active), arg_max(key_id, (created_at, key_id))) AS key_id
       FROM keys GROUP BY device_id""",
    "keys",
)
def win_05(spark, d):
    return windows.active_key(b.keys(spark, d)).select("device_id", "key_id")


@query(
    "win_06_retention",
    """SELECT snapshot_id, version_rank FROM (SELECT *, row_number() OVER (PARTITION BY device_id, path
          ORDER BY created_at DESC, snapshot_id DESC) AS version_rank FROM snapshots)
       WHERE version_rank <= 10 AND created_at >= TIMESTAMP '2001-11-04' -
         CASE WHEN backup_type = 'FULL' THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END""",
    "snapshots",
)
def win_06(spark, d):
    as_of = F.lit("2001-11-04").cast("timestamp_ntz")
    return windows.retained(b.snapshots(spark, d), as_of).select("snapshot_id", "version_rank")


QUOTA_LIMIT = 400_000

# A fold per tenant and resource, one request per step.
QUOTA_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, resource ORDER BY ts, request_id) AS i FROM requests),
    f(request_id, tenant_id, resource, i, admitted, used_after) AS (
      SELECT request_id, tenant_id, resource, i, amount <= {QUOTA_LIMIT}, CASE WHEN amount <= {QUOTA_LIMIT} THEN amount ELSE 0 END
      FROM o WHERE i = 1
      UNION ALL SELECT o.request_id, o.tenant_id, o.resource, o.i, f.used_after + o.amount <= {QUOTA_LIMIT},
        CASE WHEN f.used_after + o.amount <= {QUOTA_LIMIT} THEN f.used_after + o.amount ELSE f.used_after END
      FROM f JOIN o ON o.tenant_id = f.tenant_id AND o.resource = f.resource AND o.i = f.i + 1)
    SELECT request_id, admitted, used_after, admitted AND used_after > {QUOTA_LIMIT} * 0.8 AS warned FROM f"""


@query("win_07_quota_consumption", QUOTA_SQL, "ev requests")
def win_07(spark, d):
    out = windows.consume_quota(b.quota_requests(spark, d), default_limit=QUOTA_LIMIT)
    return out.select("request_id", "admitted", "used_after", "warned")


@query(
    "win_08_dirty_trigger",
    """SELECT device_id, block_number, ts, n // 1001 AS trigger_no FROM (
         SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, block_number) AS n
         FROM (SELECT device_id, block_number, min(ts) AS ts FROM writes GROUP BY ALL)) WHERE n % 1001 = 0""",
    "writes",
)
def win_08(spark, d):
    return windows.dirty_triggers(b.block_writes(spark, d)).select("device_id", "block_number", "ts", "trigger_no")


@query(
    "win_09_latest_modification",
    "SELECT device_id, block_number AS inode, max(ts) AS modified_at, TRUE AS needs_backup FROM writes GROUP BY ALL",
    "writes",
)
def win_09(spark, d):
    changes = b.block_writes(spark, d).select(
        "device_id", F.col("block_number").alias("inode"), F.col("ts").alias("modified_at")
    )
    return windows.latest_modifications(changes)


@query(
    "win_10_stale_peers",
    """SELECT device_id, max("timestamp") AS last_heartbeat FROM ev GROUP BY 1
       HAVING max("timestamp") < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 30 SECOND""",
    "ev",
)
def win_10(spark, d):
    beats = b.events(spark, d).select("device_id", F.col("timestamp").alias("ts"))
    return windows.stale_peers(beats, F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))


@query(
    "set_01_merge_states",
    """SELECT path, version, "timestamp", node_id, chunk_id FROM versions
       QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC, "timestamp" DESC, node_id DESC, chunk_id DESC) = 1""",
    "versions",
)
def set_01(spark, d):
    """Two replicas by ship year, one given twice: repetition changes nothing."""
    rows = b.versions(spark, d).select("path", "version", "timestamp", "node_id", "chunk_id")
    early, late = rows.filter("timestamp < '1998-01-01'"), rows.filter("timestamp >= '1998-01-01'")
    return sets.merge_states([late, early, late], ["path"], ["version", "timestamp", "node_id", "chunk_id"])


@query(
    "set_02_drop_deleted",
    """WITH m AS (SELECT path, version, "timestamp", node_id FROM versions WHERE NOT is_deleted
         QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC, "timestamp" DESC, node_id DESC) = 1),
       t AS (SELECT path, max("timestamp") AS deleted_at FROM versions WHERE is_deleted GROUP BY 1)
       SELECT m.path, version, "timestamp", node_id FROM m LEFT JOIN t USING (path) WHERE deleted_at IS NULL OR deleted_at < "timestamp" """,
    "versions",
)
def set_02(spark, d):
    rows = b.versions(spark, d)
    state = windows.lww_register(rows.filter(~F.col("is_deleted")).select("path", "version", "timestamp", "node_id"))
    tombs = rows.filter("is_deleted").select("path", F.col("timestamp").alias("deleted_at"))
    return sets.drop_deleted(state, tombs, ["path"])


# Three replicas; each sees what the others did when a year begins. A removal takes the additions it has seen.
_OPERATIONS = """o AS (SELECT device_id % 3 AS actor, path AS element, is_deleted, year(created_at) AS y,
         row_number() OVER (PARTITION BY device_id % 3 ORDER BY created_at, snapshot_id, path, is_deleted) AS counter FROM snapshots),
       c AS (SELECT ys.y, a.actor, count(*) FILTER (o.y < ys.y) AS n FROM (SELECT DISTINCT y FROM o) ys, (SELECT DISTINCT actor FROM o) a
             JOIN o ON o.actor = a.actor GROUP BY ALL),
       r AS (SELECT o.element, c.actor, max(CASE WHEN c.actor = o.actor THEN o.counter - 1 ELSE c.n END) AS bound
             FROM o JOIN c ON c.y = o.y WHERE o.is_deleted GROUP BY ALL)"""


@query(
    "set_02_observed_remove",
    f"""WITH {_OPERATIONS}
       SELECT o.element, count(*) AS additions FROM o LEFT JOIN r ON r.element = o.element AND r.actor = o.actor
       WHERE NOT o.is_deleted AND (bound IS NULL OR counter > bound) GROUP BY o.element""",
    "snapshots",
)
def set_02_observed(spark, d):
    """Three replicas that each know their own operations and what the others did before the last year, merged."""
    actor, year = F.col("device_id") % 3, F.year("created_at")
    rows = b.snapshots(spark, d).select(actor.alias("actor"), F.col("path").alias("element"), "is_deleted", "created_at", "snapshot_id", year.alias("y"))
    numbered = pin(replicated.numbered(rows, ["created_at", "snapshot_id", "element", "is_deleted"]), "operations")
    per_year = numbered.groupBy("actor", "y").agg(F.count(F.lit(1)).alias("n"))
    # One row per actor and year from here on, then one per year.
    years = numbered.select("y").distinct().withColumnRenamed("y", "of")
    before = per_year.join(years, F.col("y") < F.col("of")).groupBy("of", "actor").agg(F.sum("n").alias("n"))
    synced = before.groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("actor", "n"))).alias("others"))
    joined = numbered.join(F.broadcast(synced), F.col("y") == F.col("of"), "left")
    others = F.map_filter(F.coalesce("others", F.create_map().cast("map<bigint,bigint>")), lambda k, _v: k != F.col("actor"))
    own = F.create_map(F.col("actor").cast("bigint"), F.col("counter") - 1)
    operations = pin(joined.select("actor", "counter", "element", F.col("is_deleted").alias("is_removal"), "y", F.map_concat(others, own).alias("seen")), "operations")
    last = operations.agg(F.max("y")).first()[0]
    states = []
    for replica in range(3):
        known = operations.filter((F.col("actor") == replica) | (F.col("y") < last))
        states.append(replicated.apply(operations, known.groupBy("actor").agg(F.max("counter").alias("counter"))))
    first = replicated.merge([states[2], states[0]])
    return replicated.elements(replicated.merge([first, states[1], states[0]]))
