"""Content jobs over the given tables. Where no SQL can redo the work, the query reports a
verdict per row that SQL can count."""

from __future__ import annotations

from pyspark.sql import functions as F

from backuplake.functions.features import digest
from backuplake.jobs import chunking, cleanup, codecs, crypto, dedup, erasure, long_files, placement, replay, restore
from backuplake.operators import joins
from backuplake.plans.joined import FAILOVER_SQL, _REPLICAS
from backuplake.plans.registry import query
from backuplake.sources import bindings as b


def _chunks(spark, d):
    return chunking.split_fixed(b.files(spark, d), b.CHUNK_BYTES, ["file_id", "lang"])


@query(
    "job_01_fixed_chunks",
    "SELECT file_id, pos, size AS length, chunk_id AS digest FROM chunks",
    "pieces chunks",
)
def job_01(spark, d):
    return _chunks(spark, d).select("file_id", "pos", "length", "digest")


@query("job_02_reassembly", "SELECT doc_id AS file_id, sha256(encode(text)) AS digest FROM documents")
def job_02(spark, d):
    return chunking.reassemble(_chunks(spark, d), ["file_id"]).select("file_id", digest(F.col("data")).alias("digest"))


@query(
    "job_03_content_chunks",
    """SELECT doc_id AS file_id, octet_length(encode(text)) AS bytes, sha256(encode(text)) AS digest, TRUE AS sizes_ok FROM documents""",
)
def job_03(spark, d):
    """Content-defined chunks joined again give the file; only a file's last chunk may be short."""
    low, high = 512, 8192
    rows = chunking.split_by_content(b.files(spark, d), low, 10, high, ["file_id"])
    last = F.max(F.struct("pos", "length"))["length"]
    whole = chunking.reassemble(
        rows,
        ["file_id"],
        bytes=F.sum("length"),
        longest=F.max("length"),
        short=F.count_if(F.col("length") < low) - F.when(last < low, 1).otherwise(0),
    )
    fits = (F.col("longest") <= high) & (F.col("short") == 0)
    return whole.select("file_id", "bytes", digest(F.col("data")).alias("digest"), fits.alias("sizes_ok"))


@query(
    "job_03_range_chunks",
    """SELECT doc_id AS file_id, octet_length(encode(text)) AS bytes, sha256(encode(text)) AS digest, TRUE AS sizes_ok FROM documents WHERE text <> ''""",
)
def job_03_ranges(spark, d):
    """The same chunks, found in byte ranges shorter than a chunk may be."""
    low, bits, high = 512, 10, 8192
    ranges = long_files.ranges_of(b.files(spark, d).select("file_id", "data"), ["file_id"], bits, 4096)
    rows = long_files.split_ranges(ranges, ["file_id"], low, bits, high)
    whole = chunking.reassemble(
        rows.withColumnRenamed("start", "pos"),
        ["file_id"],
        bytes=F.sum("length"),
        longest=F.max("length"),
        short=F.count_if(F.col("length") < low) - F.when(F.max(F.struct("pos", "length"))["length"] < low, 1).otherwise(0),
    )
    fits = (F.col("longest") <= high) & (F.col("short") == 0)
    return whole.select("file_id", "bytes", digest(F.col("data")).alias("digest"), fits.alias("sizes_ok"))


@query(
    "job_04_dedup",
    """SELECT digest, f[1] AS first_file_id, f[2] AS first_pos, ref_count, length, (ref_count - 1) * length AS saved_bytes FROM (
         SELECT chunk_id AS digest, min([file_id, pos]) AS f, count(*) AS ref_count, max(size) AS length FROM chunks GROUP BY 1)""",
    "pieces chunks",
)
def job_04(spark, d):
    return dedup.dedup_index(_chunks(spark, d), ["file_id", "pos"])


@query(
    "job_05_codecs",
    """SELECT codec, file_id, pos, size AS length, TRUE AS restored FROM chunks,
       (SELECT unnest(['zstd', 'lz4', 'brotli', 'gzip', 'xz']) AS codec)""",
    "pieces chunks",
)
def job_05(spark, d):
    """Every chunk through every codec and back, in one pass over the chunks."""
    names = F.array(*[F.lit(c) for c in codecs.LEVELS])
    rows = _chunks(spark, d).select("file_id", "pos", "length", "data", F.explode(names).alias("codec"))
    packed = rows.withColumn("packed", codecs.compressed(F.col("data"), F.col("codec")))
    back = codecs.decompressed(F.col("packed"), F.col("length"), F.col("codec"))
    return packed.select("codec", "file_id", "pos", "length", (back == F.col("data")).alias("restored"))


@query(
    "job_06_best_codec",
    "SELECT file_id, pos, size AS length, TRUE AS known_codec, TRUE AS not_above_zstd FROM chunks",
    "pieces chunks",
)
def job_06(spark, d):
    best = codecs.best_codec(_chunks(spark, d)).withColumn("zstd", codecs.compressed(F.col("data"), "zstd"))
    return best.select(
        "file_id",
        "pos",
        "length",
        F.col("codec").isin(codecs.CANDIDATES).alias("known_codec"),
        (F.octet_length("packed") <= F.octet_length("zstd")).alias("not_above_zstd"),
    )


@query(
    "job_07_codec_report",
    """SELECT lang, codec, CAST(level AS BIGINT) AS level, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS original_bytes, count(*) AS restored
       FROM chunks, (VALUES ('zstd', 1), ('zstd', 3), ('zstd', 6), ('zstd', 9), ('zstd', 12), ('lz4', 9), ('brotli', 6), ('xz', 6)) g(codec, level)
       GROUP BY ALL""",
    "pieces chunks",
)
def job_07(spark, d):
    grid = [("zstd", level) for level in (1, 3, 6, 9, 12)] + [("lz4", None), ("brotli", None), ("xz", None)]
    report = codecs.codec_report(_chunks(spark, d), "lang", grid)
    return report.drop("packed_bytes", "micros")


SHARDS = (4, 2)


def _shards(spark, d):
    pieces = _chunks(spark, d).select(F.concat_ws("-", "file_id", "pos").alias("chunk_id"), "data")
    return erasure.encode_chunks(pieces, *SHARDS)


@query(
    "job_08_erasure_encode",
    """SELECT file_id || '-' || pos AS chunk_id, i AS "index", (size + 3) // 4 AS shard_length,
       CASE WHEN i < 4 THEN 'DATA' ELSE 'PARITY' END AS shard_type, size AS original_length,
       CASE WHEN i < 4 THEN sha256(CAST(data[i * ((size + 3) // 4) + 1 : (i + 1) * ((size + 3) // 4)]
           || unhex(repeat('00', CAST(greatest(0, least((size + 3) // 4, (i + 1) * ((size + 3) // 4) - size)) AS INTEGER))) AS BLOB)) END AS data_checksum
       FROM (SELECT *, octet_length(data) AS size FROM pieces), range(6) g(i)""",
    "pieces",
)
def job_08(spark, d):
    """Data shards are checked byte by byte; parity shards by the reconstruction query."""
    return _shards(spark, d).select(
        "chunk_id",
        "index",
        F.octet_length("data").cast("bigint").alias("shard_length"),
        "shard_type",
        "original_length",
        F.when(F.col("index") < SHARDS[0], F.col("checksum")).alias("data_checksum"),
    )


@query(
    "job_09_erasure_rebuild",
    """SELECT file_id || '-' || pos AS chunk_id, CASE WHEN length(file_id || '-' || pos) = 6 THEN 'INSUFFICIENT_SHARDS' ELSE 'OK' END AS status,
       CASE WHEN length(file_id || '-' || pos) = 6 THEN 3 ELSE 4 END::BIGINT AS intact_shards,
       CASE WHEN length(file_id || '-' || pos) <> 6 THEN chunk_id END AS digest FROM chunks""",
    "pieces chunks",
)
def job_09(spark, d):
    """Shards 0 and 3 of every chunk are damaged or lost; chunks whose id has six characters lose a third."""
    shards = _shards(spark, d)
    third = (F.length("chunk_id") == 6) & (F.col("index") == 5)
    left = shards.filter((F.col("index") != 3) & ~third).withColumn(
        "data", F.when(F.col("index") == 0, F.concat(F.lit(b"x"), "data")).otherwise(F.col("data"))
    )
    out = erasure.reconstruct_chunks(left, *SHARDS)
    return out.select("chunk_id", "status", "intact_shards", F.when(F.col("data").isNotNull(), digest(F.col("data"))).alias("digest"))


@query(
    "job_10_distribution",
    f"""WITH p AS ({_REPLICAS}), nxt AS ({FAILOVER_SQL}), t AS (
         SELECT p.chunk_id, (p.chunk_id + p.node_id) % 5 = 0 AS f1, (p.chunk_id + n.next_node_id) % 5 = 0 AS f2 FROM p JOIN nxt n USING (node_id))
       SELECT chunk_id, count(*) FILTER (NOT f1 OR NOT f2) AS uploaded,
         CASE WHEN count(*) FILTER (NOT f1 OR NOT f2) >= 3 THEN 'SUCCESS' WHEN count(*) FILTER (NOT f1 OR NOT f2) > 0 THEN 'PARTIAL'
              ELSE 'FAILED' END AS outcome FROM t GROUP BY chunk_id""",
    "nodes ring chunk_index",
)
def job_10(spark, d):
    """Uploads fail where chunk and node number add up to a multiple of five."""
    ring = joins.ring_points(b.nodes(spark, d))
    chunks = b.chunk_index(spark, d).select("chunk_id", F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("label"))
    first = joins.replicas(chunks, "label", ring).select("chunk_id", "node_id")
    second = first.join(joins.failover_nodes(ring), "node_id").select("chunk_id", F.col("next_node_id").alias("node_id"))
    failures = first.unionByName(second).filter((F.col("chunk_id") + F.col("node_id")) % 5 == 0)
    return placement.distribute(chunks, "label", ring, failures)


@query(
    "job_11_encryption",
    """WITH k AS (SELECT device_id, coalesce(arg_min(key_id, (created_at, key_id)) FILTER (is_active), arg_max(key_id, (created_at, key_id))) AS key_id
         FROM keys GROUP BY 1)
       SELECT snapshot_id, device_id, key_id, CASE WHEN key_id IS NULL THEN 'NO_KEY' ELSE 'OK' END AS status,
       CASE WHEN key_id IS NOT NULL THEN path END AS opened FROM snapshots s LEFT JOIN k USING (device_id)""",
    "keys snapshots",
)
def job_11(spark, d):
    """Snapshot paths sealed with the device's key and opened again."""
    keys = b.keys(spark, d).withColumn("secret", F.unhex(F.sha2(F.concat(F.lit("secret-"), "key_id"), 256)))
    rows = b.snapshots(spark, d).select("snapshot_id", "device_id", F.encode("path", "UTF-8").alias("data"))
    iv = F.substring(F.unhex(F.sha2("snapshot_id", 256)), 1, 12)
    sealed = crypto.encrypt(rows, keys, iv)
    opened = crypto.decrypt(sealed.drop("status"), keys)
    return opened.select("snapshot_id", "device_id", "key_id", "status", F.decode("data", "UTF-8").alias("opened"))


@query(
    "job_12_key_rotation",
    """WITH n AS (SELECT 'n' || device_id AS key_id, device_id, TIMESTAMP '2024-01-01' AS created_at FROM devices WHERE is_online),
       u AS (SELECT key_id, device_id, created_at FROM keys UNION ALL SELECT * FROM n)
       SELECT key_id, device_id, key_id = first_value(key_id) OVER (PARTITION BY device_id ORDER BY created_at DESC, key_id DESC) AS is_active FROM u""",
    "keys devices",
)
def job_12(spark, d):
    new = b.devices(spark, d).filter("is_online").select(
        F.concat(F.lit("n"), F.col("device_id").cast("string")).alias("key_id"),
        "device_id",
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit(True).alias("is_active"),
    )
    registry = b.keys(spark, d).select("key_id", "device_id", "created_at", "is_active")
    return crypto.rotate_keys(registry, new).select("key_id", "device_id", "is_active")


_AS_OF = "2001-12-01"


@query(
    "job_13_cleanup",
    f"""WITH c AS (SELECT TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AS cut),
       kept AS (SELECT v.* FROM versions v, c WHERE NOT (is_deleted AND backup_time < cut)),
       o AS (SELECT i.* FROM chunk_index i, c WHERE created_at < cut AND chunk_id NOT IN (
             SELECT chunk_id FROM kept WHERE NOT is_deleted))
       SELECT 'files' AS what, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM versions) - (SELECT count(*) FROM kept) AS removed
       UNION ALL SELECT 'jobs', count(*) FILTER (NOT x), count(*) FILTER (x) FROM (
         SELECT coalesce(status IN ('COMPLETED', 'FAILED') AND coalesce(end_time, created_at) < cut, FALSE) AS x FROM jobs, c)
       UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunk_index) - (SELECT count(*) FROM o), (SELECT count(*) FROM o)""",
    "versions chunk_index jobs",
)
def job_13(spark, d):
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    files = cleanup.expired_files(b.versions(spark, d), as_of)
    jobs = cleanup.finished_jobs(b.jobs(spark, d).withColumnRenamed("created_at", "start_time"), as_of)
    chunks = cleanup.orphaned_chunks(b.chunk_index(spark, d), files[0], as_of)
    out = None
    for what, (kept, gone) in {"files": files, "jobs": jobs, "chunks": chunks}.items():
        counts = kept.select(F.lit(1).alias("k"), F.lit(0).alias("r")).unionByName(gone.select(F.lit(0).alias("k"), F.lit(1).alias("r")))
        row = counts.agg(F.lit(what).alias("what"), F.sum("k").alias("kept"), F.sum("r").alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "job_14_compaction",
    """SELECT chunk_id, size FROM chunk_index WHERE chunk_id IN (SELECT chunk_id FROM versions GROUP BY 1
       HAVING sum(CASE WHEN is_deleted THEN -2 ELSE 1 END) > 0)""",
    "chunk_index versions",
)
def job_14(spark, d):
    refs = b.versions(spark, d).select("chunk_id", F.when(F.col("is_deleted"), -2).otherwise(1).alias("delta"))
    return dedup.compact(b.chunk_index(spark, d), refs)[0].select("chunk_id", "size")


_SYNTH_ORDER = ["backup_time", "version", "chunk_id", "device_id"]


@query(
    "job_15_synthetic_full",
    """WITH m AS (SELECT * FROM (SELECT * FROM versions QUALIFY row_number() OVER (
            PARTITION BY path ORDER BY backup_time DESC, version DESC, chunk_id DESC, device_id DESC) = 1) WHERE NOT is_deleted),
       c AS (SELECT m.chunk_id, i.size, i.size // 3 + 1 AS packed FROM m JOIN chunk_index i USING (chunk_id)),
       u AS (SELECT chunk_id, max(size) AS one FROM c GROUP BY 1)
       SELECT (SELECT CAST(sum(size) AS BIGINT) FROM c) AS logical_bytes, (SELECT CAST(sum(one) AS BIGINT) FROM u) AS unique_bytes,
       (SELECT CAST(sum(size) AS DOUBLE) FROM c) / (SELECT CAST(sum(one) AS BIGINT) FROM u) AS dedup_ratio,
       (SELECT CAST(sum(size) AS DOUBLE) FROM c) / (SELECT CAST(sum(packed) AS BIGINT) FROM c) AS compression_ratio,
       (SELECT CAST(sum(size) AS BIGINT) FROM versions) AS input_bytes,
       (SELECT CAST(sum(size) AS BIGINT) FROM versions) - (SELECT CAST(sum(one) AS BIGINT) FROM u) AS space_saved,
       (SELECT count(*) FROM m) AS files""",
    "versions chunk_index",
)
def job_15(spark, d):
    rows = b.versions(spark, d).select(
        "path", "device_id", "version", "chunk_id", "size", "backup_time", "is_deleted", F.array("chunk_id").alias("chunks")
    )
    index = b.chunk_index(spark, d).select(
        "chunk_id", F.col("size").alias("chunk_size"), (F.floor(F.col("size") / 3) + 1).cast("bigint").alias("packed_size")
    )
    early, late = rows.filter("backup_time < '1997-01-01'"), rows.filter("backup_time >= '1997-01-01'")
    manifest, ratios = restore.synthetic_full(early.drop("chunk_id"), late.drop("chunk_id"), index, ["backup_time", "version", "chunks", "device_id"])
    return joins.beside(ratios, manifest.agg(F.count(F.lit(1)).alias("files")))


@query(
    "job_16_restore",
    """SELECT doc_id AS backup_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
       CASE WHEN lang = 'fr' THEN 'SKIPPED_EXISTS' ELSE 'RESTORED' END AS status FROM documents""",
)
def job_16(spark, d):
    """All files restored; the French ones are at the target already."""
    files = b.files(spark, d).select(F.col("file_id").alias("backup_id"), "path", "lang", digest(F.col("data")).alias("checksum"))
    manifest = files.join(b.chunked_files(spark, d).select("path", "chunks"), "path")
    store = dedup.chunk_store(_chunks(spark, d)).select(F.col("digest").alias("chunk_id"), "data")
    requests = files.select(F.col("backup_id").alias("restore_id"), "backup_id", F.array("path").alias("files"))
    out = restore.restore(requests, manifest, store, files.filter("lang = 'fr'"))
    return out.select("backup_id", "path", "status")


@query(
    "job_16_restore_times",
    """WITH v AS (SELECT device_id, path, created_at AS ts, max({'id': snapshot_id, 'c': checksum, 'd': is_deleted}) AS s FROM snapshots GROUP BY ALL),
       q AS (SELECT DISTINCT device_id, path, created_at + to_days(CAST(job_id % 400 - 100 AS INTEGER)) AS "at" FROM snapshots)
       SELECT q.device_id, q.path, q."at", CASE WHEN NOT v.s.d THEN v.s.c END AS checksum,
         CASE WHEN v.s IS NULL THEN 'NOT_YET' WHEN v.s.d THEN 'DELETED' ELSE 'RESTORABLE' END AS status
       FROM q ASOF LEFT JOIN v ON v.device_id = q.device_id AND v.path = q.path AND q."at" >= v.ts""",
    "snapshots",
)
def job_16_times(spark, d):
    """Every file of every device at times around its own snapshots, each request with a time of its own."""
    rows = b.snapshots(spark, d)
    at = F.col("created_at") + F.make_interval(days=(F.col("job_id") % 400 - 100).cast("int"))
    requests = rows.select("device_id", "path", at.alias("at")).distinct()
    out = restore.versions_at(requests, rows.withColumnRenamed("created_at", "ts"), ["device_id", "path"])
    return out.select("device_id", "path", "at", "checksum", "status")


@query(
    "job_17_state_replay",
    """SELECT job_id, list_reduce(list(command ORDER BY ts, event_id), lambda s, c: CASE
         WHEN c = 'cancel' THEN 'CANCELLED' WHEN c = 'start' AND s = 'QUEUED' THEN 'RUNNING' WHEN c = 'pause' AND s = 'RUNNING' THEN 'PAUSED'
         WHEN c = 'resume' AND s = 'PAUSED' THEN 'RUNNING' WHEN c = 'complete' AND s = 'RUNNING' THEN 'COMPLETED' ELSE s END, 'QUEUED') AS status,
       count(*) AS commands FROM commands GROUP BY job_id""",
    "ev commands",
)
def job_17(spark, d):
    return replay.replay(b.commands(spark, d), "job_id", ["ts", "event_id"])


@query(
    "job_18_integrity_audit",
    "SELECT file_id, pos, lang = 'es' AS is_corrupt FROM chunks",
    "pieces chunks",
)
def job_18(spark, d):
    """Chunks of Spanish files have a byte too many."""
    bad = F.when(F.col("lang") == "es", F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    return restore.audit(_chunks(spark, d).withColumn("data", bad), "digest").select("file_id", "pos", "is_corrupt")
