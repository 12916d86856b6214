"""Content jobs: round trips and edge rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from backuplake.jobs import chunking, cleanup, codecs, crypto, dedup, erasure, placement, restore
from backuplake.operators import joins

RNG = random.Random(5)
BLOBS = [b"", b"a", bytes(range(256)) * 4, b"text " * 500, RNG.randbytes(1023), RNG.randbytes(1024), RNG.randbytes(1025), b"\0" * 2048]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(BLOBS)], "path string, data binary")


def test_fixed_chunks(files, rows):
    parts = chunking.split_fixed(files, 1024)
    lengths = {}
    for path, pos, length in rows(parts, "path", "pos", "length"):
        lengths.setdefault(int(path), []).append(length)
    assert lengths.get(0) is None and lengths[5] == [1024] and lengths[6] == [1024, 1]
    back = {r.path: bytes(r.data) for r in chunking.reassemble(parts).collect()}
    assert back == {str(i): x for i, x in enumerate(BLOBS) if x}


def test_content_chunks_move_only_near_an_edit(spark):
    base = RNG.randbytes(60_000)
    edited = base[:30_000] + b"inserted" + base[30_000:]
    df = spark.createDataFrame([("a", bytearray(base)), ("b", bytearray(edited)), ("e", bytearray(b""))], "path string, data binary")
    parts = chunking.split_by_content(df, low=256, bits=9, high=4096)
    rows_of = {}
    for r in parts.orderBy("path", "pos").collect():
        rows_of.setdefault(r.path, []).append(bytes(r.data))
    assert b"".join(rows_of["a"]) == base and b"".join(rows_of["b"]) == edited and "e" not in rows_of
    assert all(256 <= len(c) <= 4096 for c in rows_of["a"][:-1])
    assert len(set(rows_of["a"]) - set(rows_of["b"])) <= 4


def test_cut_points_follow_the_plain_rule():
    weights = [int(w) for w in chunking.gear_table()]
    data = RNG.randbytes(5000)
    low, bits, high = 64, 6, 400
    mask, out, start, h = (1 << bits) - 1, [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + weights[byte]) & ((1 << 64) - 1)
        size = i + 1 - start
        if (size >= low and h & mask == 0) or size >= high:
            out.append(i + 1)
            start = i + 1
    if start < len(data):
        out.append(len(data))
    assert chunking.cut_points(data, low, bits, high) == out


def test_first_seen_and_savings(spark):
    data = [(i, "zero" if i % 3 == 0 else f"d{i % 10}", 10) for i in range(60)]
    df = spark.createDataFrame(data, "pos long, digest string, length long")
    got = {r.digest: r for r in dedup.dedup_index(df, ["pos"]).collect()}
    assert got["zero"].ref_count == 20 and got["zero"].first_pos == 0 and got["zero"].saved_bytes == 190
    assert sum(r.ref_count for r in got.values()) == 60


def test_compaction_partitions_the_store(spark, rows):
    store = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    refs = spark.createDataFrame([("a", 1), ("b", 1), ("b", -1)], "chunk_id string, delta int")
    kept, gone = dedup.compact(store, refs)
    assert rows(kept) == [("a",)] and rows(gone) == [("b",), ("c",)]


@pytest.mark.parametrize("codec", ["zstd", "LZ4", "brotli", "gzip", "xz"])
def test_codec_round_trip(files, codec):
    packed = files.withColumn("packed", codecs.compressed(F.col("data"), codec))
    back = packed.withColumn("back", codecs.decompressed(F.col("packed"), F.octet_length("data"), codec)).collect()
    assert all(bytes(r.back) == bytes(r.data) for r in back)
    repeated = next(r for r in back if bytes(r.data).startswith(b"text"))
    assert len(repeated.packed) < len(repeated.data)


def test_unknown_codec_is_an_error():
    with pytest.raises(ValueError):
        codecs.codec_name("rar")


def test_best_codec_takes_the_smallest_and_the_first_on_ties(files):
    for r in codecs.best_codec(files).collect():
        sizes = [len(codecs.pack(bytes(r.data), c)) for c in codecs.CANDIDATES]
        want = codecs.CANDIDATES[sizes.index(min(sizes))] if r.data else "zstd"
        assert r.codec == want
        assert r.saved == (0.0 if not r.data else (len(r.data) - min(sizes)) / len(r.data))


@pytest.mark.parametrize("k, m", [(1, 1), (3, 2), (4, 2), (10, 4)])
def test_any_k_shards_restore(k, m):
    for blob in (b"x", b"hello world" * 7, bytes(range(256))):
        shards = erasure.encode(blob, k, m)
        assert b"".join(shards[:k])[: len(blob)] == blob
        for used in itertools.islice(itertools.combinations(range(k + m), k), 60):
            assert erasure.decode({i: shards[i] for i in used}, k, m, len(blob)) == blob
    assert erasure.decode({0: b"x"}, 2, 1, 1) is None


def test_parity_of_a_known_code():
    """Every square choice of rows of the coding matrix can be inverted."""
    matrix = erasure.coding_matrix(4, 2)
    assert (matrix[:4] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]).all()


def test_shard_table(spark, files):
    chunks = files.withColumnRenamed("path", "chunk_id")
    shards = erasure.encode_chunks(chunks, 4, 2)
    assert shards.count() == 6 * len(BLOBS)
    # One shard corrupted, one lost, every shard listed twice.
    left = shards.filter("index <> 1").withColumn(
        "data", F.when(F.col("index") == 2, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    )
    back = {r.chunk_id: r for r in erasure.reconstruct_chunks(left.unionByName(left), 4, 2).collect()}
    for i, blob in enumerate(BLOBS):
        assert back[str(i)].status == "OK" and bytes(back[str(i)].data) == blob and back[str(i)].intact_shards == 4
    fewer = erasure.reconstruct_chunks(left.filter("index <> 5"), 4, 2).collect()
    assert {r.status for r in fewer} == {"INSUFFICIENT_SHARDS"} and len(fewer) == len(BLOBS)
    assert all(r.data is None for r in fewer)


def test_distribution_outcomes(spark, rows):
    ring = joins.ring_points(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node_id string"))
    chunks = spark.createDataFrame([(i, f"k{i}") for i in range(20)], "chunk_id long, label string")
    none = spark.createDataFrame([], "chunk_id long, node_id string")
    assert {r.outcome for r in placement.distribute(chunks, "label", ring, none).collect()} == {"SUCCESS"}
    every = chunks.select("chunk_id", F.explode(F.array(*[F.lit(n) for n in "abcd"])).alias("node_id"))
    assert {r.outcome for r in placement.distribute(chunks, "label", ring, every).collect()} == {"FAILED"}
    lost = every.filter("node_id = 'a'")
    spots = placement.locations(chunks, "label", ring, lost)
    assert spots.filter("status = 'FAILED' OR node_id = 'a'").count() == 0
    alone = joins.ring_points(spark.createDataFrame([("a",)], "node_id string"))
    assert {r.outcome for r in placement.distribute(chunks, "label", alone, none).collect()} == {"PARTIAL"}
    # No other node to turn to: nothing is stored.
    assert {r.outcome for r in placement.distribute(chunks, "label", alone, lost).collect()} == {"FAILED"}


def test_encryption(spark):
    keys = spark.createDataFrame(
        [("d", "k1", bytearray(b"1" * 32), dt.datetime(2024, 1, 1), False), ("d", "k2", bytearray(b"2" * 32), dt.datetime(2024, 1, 2), True)],
        "device_id string, key_id string, secret binary, created_at timestamp, is_active boolean",
    )
    plain = spark.createDataFrame([("d", 1, bytearray(b"secret")), ("x", 2, bytearray(b"lost"))], "device_id string, id long, data binary")
    sealed = crypto.encrypt(plain, keys, F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 12))
    got = {r.id: r for r in sealed.collect()}
    assert got[2].status == "NO_KEY" and got[2].encrypted is None and got[1].key_id == "k2"
    back = {r.id: r for r in crypto.decrypt(sealed.drop("status"), keys).collect()}
    assert bytes(back[1].data) == b"secret" and back[2].status == "NO_KEY"
    moved = sealed.drop("status").withColumn("device_id", F.lit("d")).withColumn("key_id", F.lit("k1"))
    assert {r.status for r in crypto.decrypt(moved.filter("id = 1"), keys).collect()} == {"BAD_DATA"}
    by_active = sealed.drop("status").filter("id = 1").withColumn("key_id", F.lit(None).cast("string"))
    assert bytes(crypto.decrypt(by_active, keys).first().data) == b"secret"


def test_cleanup_borders(spark, rows):
    now = F.lit("2024-01-31").cast("timestamp")
    on, before = dt.datetime(2024, 1, 1), dt.datetime(2023, 12, 31, 23, 59)
    files = spark.createDataFrame([("on", True, on), ("old", True, before), ("live", False, before)], "path string, is_deleted boolean, backup_time timestamp")
    kept, gone = cleanup.expired_files(files, now)
    assert rows(gone, "path") == [("old",)] and rows(kept, "path") == [("live",), ("on",)]
    jobs = spark.createDataFrame(
        [("a", "COMPLETED", before, None), ("b", "FAILED", before, on), ("c", "RUNNING", before, None), ("d", "FAILED", on, before)],
        "id string, status string, start_time timestamp, end_time timestamp",
    )
    kept, gone = cleanup.finished_jobs(jobs, now)
    assert rows(gone, "id") == [("a",), ("d",)] and kept.count() == 2
    chunks = spark.createDataFrame([("x", before), ("y", before), ("z", on)], "chunk_id string, created_at timestamp")
    refs = spark.createDataFrame([("x", False), ("y", True)], "chunk_id string, is_deleted boolean")
    kept, gone = cleanup.orphaned_chunks(chunks, refs, now)
    assert rows(gone, "chunk_id") == [("y",)] and rows(kept, "chunk_id") == [("x",), ("z",)]


def test_restore_verdicts(spark, files):
    parts = chunking.split_fixed(files.filter("path in ('2','3','4')"), 512)
    store = dedup.chunk_store(parts).select(F.col("digest").alias("chunk_id"), "data")
    lists = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("l"))
    manifest = files.join(lists, "path").select(
        F.lit("b").alias("backup_id"), "path", F.transform("l", lambda x: x["digest"]).alias("chunks"),
        F.when(F.col("path") == "4", F.lit("wrong")).otherwise(F.sha2("data", 256)).alias("checksum"),
    )
    requests = spark.createDataFrame([("r", "b", ["2", "3", "4", "none"])], "restore_id string, backup_id string, files array<string>")
    existing = spark.createDataFrame([("3",)], "path string")
    got = {r.path: r for r in restore.restore(requests, manifest, store, existing).collect()}
    assert {p: r.status for p, r in got.items()} == {"2": "RESTORED", "3": "SKIPPED_EXISTS", "4": "CORRUPT", "none": "NOT_IN_BACKUP"}
    assert bytes(got["2"].data) == BLOBS[2]
    again = {r.path: r.status for r in restore.restore(requests, manifest, store, existing, overwrite=True).collect()}
    assert again["3"] == "RESTORED"


def test_audit(spark):
    df = spark.createDataFrame([("a", bytearray(b"x"))], "id string, data binary").withColumn("checksum", F.sha2("data", 256))
    assert restore.audit(df).first().is_corrupt is False
    assert restore.audit(df.withColumn("data", F.lit(b"y"))).first().is_corrupt is True
