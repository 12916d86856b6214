"""The table mappings of `sources.bindings` written again in SQL."""

_EXT = (
    "CASE l_linenumber WHEN 1 THEN 'jpg' WHEN 2 THEN 'mp4' WHEN 3 THEN 'mp3' WHEN 4 THEN 'pdf'"
    " WHEN 5 THEN 'txt' WHEN 6 THEN 'tmp' WHEN 7 THEN 'log' ELSE 'dat' END"
)

VIEWS = {
    "ev": """SELECT event_id, ts AS "timestamp", user_id AS device_id, user_id % 10 AS tenant_id,
        event_type AS backup_type, CAST(round(value * 100) AS BIGINT) AS size,
        CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS duration FROM events""",
    "jobs": """SELECT *, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN created_at + to_seconds(duration) END AS end_time
        FROM (SELECT o_orderkey AS job_id, o_custkey AS device_id,
            CASE WHEN o_orderkey % 20 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
                 WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'PAUSED' END AS status,
            CAST(round(o_totalprice * 100) AS BIGINT) AS size,
            CAST(floor(o_totalprice) AS BIGINT) % 7200 AS duration, o_orderdate AS created_at,
            CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS BIGINT) AS priority,
            CAST(round(o_totalprice * 100) AS BIGINT) // 3 AS stored_size,
            CASE WHEN o_orderkey % 20 <> 0 AND o_orderstatus = 'F' THEN 100 ELSE o_orderkey % 100 END AS progress,
            CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN CAST(floor(o_totalprice) AS BIGINT) % 7200 END
                AS estimated_duration
            FROM orders)""",
    "snapshots": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS snapshot_id,
        l_orderkey AS job_id, l_suppkey AS device_id,
        '/set' || (l_partkey % 20) || '/Box' || (l_partkey % 7) || '/f' || l_partkey || '.' || {_EXT} AS path,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS size, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS checksum,
        l_shipdate AS created_at, CASE WHEN l_linestatus = 'O' THEN 'INCREMENTAL' ELSE 'FULL' END AS backup_type,
        l_returnflag = 'R' AS is_deleted FROM lineitem""",
    "versions": f"""SELECT '/o' || l_orderkey || '/l' || l_linenumber || '.' || {_EXT} AS path, l_suppkey AS device_id,
        l_suppkey AS node_id, CAST(l_quantity AS BIGINT) AS version, l_shipdate AS "timestamp", l_shipdate AS backup_time,
        l_partkey AS chunk_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_returnflag = 'R' AS is_deleted
        FROM lineitem""",
    "chunk_index": """SELECT p_partkey AS chunk_id, CAST(p_size AS BIGINT) AS size,
        TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 3000 AS INTEGER)) AS created_at FROM part""",
    "nodes": """SELECT s_suppkey AS node_id, CAST(round(s_acctbal * 100) AS BIGINT) + 1000000 AS capacity,
        CAST(floor((CAST(round(s_acctbal * 100) AS BIGINT) + 1000000) / 4) AS BIGINT) AS used,
        CAST(s_nationkey AS BIGINT) AS site FROM supplier""",
    "devices": """SELECT c_custkey AS device_id, CAST(c_nationkey AS BIGINT) AS tenant_id, c_acctbal > 0 AS is_online,
        TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS last_sync FROM customer""",
    "keys": """SELECT 'k' || o_orderkey AS key_id, o_custkey AS device_id, 'AES_256_GCM' AS algorithm,
        'SCRYPT' AS key_derivation, o_orderdate AS created_at, epoch_ms(o_orderdate) AS created_ms,
        o_orderstatus = 'O' AS is_active FROM orders""",
    "pieces": """SELECT doc_id AS file_id, path, lang, pos, d[pos * 4096 + 1 : pos * 4096 + 4096] AS data
        FROM (SELECT *, unnest(generate_series(0, CAST(ceil(octet_length(d) / 4096.0) AS BIGINT) - 1)) AS pos
              FROM (SELECT doc_id, lang, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
                           encode(text) AS d FROM documents))""",
    "chunks": """SELECT file_id, path, lang, pos, sha256(data) AS chunk_id, octet_length(data) AS size FROM pieces""",
    "requests": """SELECT event_id AS request_id, tenant_id,
        CASE WHEN backup_type IN ('view', 'click') THEN 'BANDWIDTH' ELSE 'STORAGE' END AS resource,
        size AS amount, "timestamp" AS ts FROM ev""",
    "writes": """SELECT l_suppkey % 10 AS device_id, l_partkey AS block_number, l_shipdate AS ts FROM lineitem""",
    "commands": """SELECT device_id AS job_id, "timestamp" AS ts, event_id,
        CASE backup_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'pause' WHEN 'signup' THEN 'resume'
             WHEN 'purchase' THEN 'complete' ELSE 'cancel' END AS command FROM ev""",
    "scores": """SELECT tenant_id, date_trunc('hour', "timestamp") AS hour_ts,
        CAST(count(*) FILTER (backup_type <> 'error') AS DOUBLE) / count(*) AS quality_score, count(*) AS n,
        CAST(sum(size) AS BIGINT) AS size, CAST(sum(duration) AS BIGINT) AS duration FROM ev GROUP BY ALL""",
    "health": """SELECT event_id, device_id, tenant_id, "timestamp", least(100.0::DOUBLE, duration::DOUBLE) AS cpu_usage,
        least(100.0::DOUBLE, size / 100.0::DOUBLE) AS memory_usage, size / 50.0::DOUBLE AS disk_io,
        duration * size / 10000.0::DOUBLE AS network_io, 5000.0::DOUBLE / (size + 100) AS backup_speed FROM ev""",
    "training": """SELECT l_orderkey AS request_id, l_suppkey AS device_id, l_quantity * 20 AS file_count,
        l_extendedprice * 100 AS total_size, l_discount * 600 + 20 AS device_cpu, l_tax * 600 + 30 AS device_memory,
        CAST(l_linenumber * 100 AS DOUBLE) AS network_speed,
        greatest(30.0::DOUBLE, l_quantity * 20 * 0.1::DOUBLE + l_extendedprice * 100 / 1000000 * 60) AS backup_duration
        FROM lineitem""",
    # Ring position of a label: signed 32-bit 31*h + c.
    "ring": """SELECT h AS ring_hash, max(node_id) AS node_id FROM (
            SELECT node_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (
                SELECT node_id, list_reduce([ascii(c)::BIGINT for c in string_split(node_id || ':' || i, '')],
                    lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS u
                FROM nodes, range(3) r(i))) GROUP BY h""",
}
