"""Edge rows of the relational operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from backuplake.functions import features, text
from backuplake.operators import aggregates, filters, joins, projections, sets, sorting, windows
from backuplake.sources import readers, sinks


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def test_parse_events_survives_bad_input(spark):
    lines = [
        '{"eventTime":"2024-01-01T10:00:00+02:00","tenantId":"t","backupType":"FULL","size":"10.5","duration":"3","file_count":"2"}',
        '{"eventTime":"bad","tenantId":"t","size":"x"}',
        '{"timestamp":"2024-01-01T10:00:00Z","tenant_id":"u","backup_type":"FULL"}',
        "not json",
    ]
    got = projections.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert got[0].timestamp == at(1, 8) and got[0].size == 10.5 and got[0].file_count == 2
    assert got[1].timestamp is None and got[1].size is None and got[1].tenant_id == "t"
    assert got[2].timestamp == at(1, 10) and got[2].tenant_id == "u"
    assert got[3].tenant_id is None


def test_updates_only_touch_existing_rows(spark, rows):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 1)], "id long, name string, n long")
    assert rows(projections.apply_updates(old, new, "id")) == [(1, "a", 5), (2, "b", 9)]
    stamped = projections.apply_updates(old, new, "id", {"name": F.lit("now")})
    assert rows(stamped) == [(1, "a", 5), (2, "now", 9)]


def test_soft_delete_keeps_records(spark, rows):
    files = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, is_deleted boolean")
    gone = spark.createDataFrame([("a",), ("a",), ("x",)], "path string")
    assert rows(projections.soft_delete(files, gone, ["path"])) == [("a", True), ("b", True), ("c", False)]


def test_search(spark, rows):
    df = spark.createDataFrame([("Photo.JPG", "/a/Photo.JPG"), ("x.txt", "/photos/x.txt"), ("y.txt", "/b/y.txt")], "name string, path string")
    assert len(rows(filters.search_files(df, "PHOTO"))) == 2
    assert rows(filters.search_files(df, "photo", [".jpg"]), "name") == [("Photo.JPG",)]
    assert rows(filters.search_files(df, "photo", name_only=True), "name") == [("Photo.JPG",)]
    assert len(rows(filters.search_files(df, "", []))) == 3


def test_backup_candidates(spark, rows):
    paths = [("/a/b.tmp", 1), ("/a/.cache/x", 1), ("/a/node_modules/y", 1), ("/a/.hidden/z", 1), ("/a/ok.txt", 1), ("/a/big", 105_000_000), ("/a/x.log", 1), ("/a/tmp.b", 104_857_600)]
    df = spark.createDataFrame(paths, "path string, size long").withColumn("is_link", F.col("path") == "/a/tmp.b")
    assert rows(filters.backup_candidates(df), "path") == [("/a/ok.txt",)]
    assert rows(filters.backup_candidates(df, follow_links=True), "path") == [("/a/ok.txt",), ("/a/tmp.b",)]
    assert ("/a/.hidden/z",) in rows(filters.backup_candidates(df, include_hidden=True), "path")


def test_pages(spark, rows):
    df = spark.createDataFrame([(i, at(1 + i // 3)) for i in range(7)], "id long, created_at timestamp")
    last = sorting.page(df, 2, 3, "created_at", "id").collect()
    assert [(r.id, r.total_rows, r.total_pages) for r in last] == [(2, 7, 3)]
    assert sorting.page(df, 9, 3, "created_at", "id").count() == 0
    first = sorting.page(df, 0, 3, "created_at", "id").collect()
    after = sorting.page_after(df, first[-1].created_at, first[-1].id, 3, "created_at", "id").collect()
    assert [r.id for r in after] == [r.id for r in sorting.page(df, 1, 3, "created_at", "id").collect()]


def test_newest_is_exact(spark):
    data = [(i, at(1 + i % 5, i % 24, i % 60)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, ts timestamp")
    for keep in (1, 37, 499, 5000):
        want = [i for i, _ in sorted(data, key=lambda r: (r[1], r[0]), reverse=True)][:keep]
        assert [r.id for r in sinks.newest(df, ["ts", "id"], keep).collect()] == want


def test_schedule_ranking(spark):
    df = spark.createDataFrame([(0, 2, 1e6), (1, 5, 5e6), (2, 2, 1e6), (3, None, None)], "pos long, priority int, estimated_size double")
    got = sorting.rank_schedule(df, "pos").collect()
    assert [(r.pos, r.optimization_score) for r in got] == [(1, 45.0), (0, 19.0), (2, 19.0), (3, 9.0)]


def test_top_metrics_order(spark):
    df = spark.createDataFrame([(1.0, -3.0, 2.0)], "a double, b double, c double")
    assert df.select(sorting.top_metrics({c: F.col(c) for c in "abc"})).first()[0] == ["c", "b"]


def test_file_chunks_keep_repeats_and_drop_unknown(spark, rows):
    files = spark.createDataFrame([("f", ["a", "b", "a", "zz"]), ("g", [])], "path string, chunks array<string>")
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, size long")
    assert rows(joins.file_chunks(files, chunks), "path", "pos", "chunk_id") == [("f", 0, "a"), ("f", 1, "b"), ("f", 2, "a")]


def test_snapshot_diff(spark, rows):
    old = spark.createDataFrame([("d", "a", "1"), ("d", "b", "1"), ("d", "c", "1"), ("e", "a", "1")], "device string, path string, checksum string")
    new = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2"), ("d", "n", "1"), ("e", "a", "2")], "device string, path string, checksum string")
    got = rows(joins.snapshot_diff(old, new, ["device", "path"]), "device", "path", "change")
    assert got == [("d", "a", "unchanged"), ("d", "b", "modified"), ("d", "c", "deleted"), ("d", "n", "new"), ("e", "a", "modified")]


def test_lineage(spark):
    data = [(0, None)] + [(i, i - 1) for i in range(1, 20)] + [(i, 0) for i in range(100, 140)] + [(200, 999)]
    got = {r.snapshot_id: (r.base_id, r.depth) for r in joins.lineage(spark.createDataFrame(data, "snapshot_id long, parent_id long")).collect()}
    assert got[19] == (0, 19) and got[0] == (0, 0) and got[120] == (0, 1) and got[200] == (999, 1)
    assert len(got) == len(data)


def signed(text_value):
    h = 0
    for c in text_value:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def ring_of(nodes, points=3):
    circle = {}
    for n in nodes:
        for i in range(points):
            circle[signed(f"{n}:{i}")] = n
    return circle


def walk(circle, start, keep):
    order = [circle[h] for h in sorted(circle) if h >= start] + [circle[h] for h in sorted(circle)]
    out = []
    for n in order:
        if n not in out and len(out) < keep:
            out.append(n)
    return out


@pytest.mark.parametrize("count", [1, 2, 7])
def test_replicas_match_a_walk_round_the_ring(spark, count):
    nodes = [f"n{i}" for i in range(count)]
    ring = joins.ring_points(spark.createDataFrame([(n,) for n in nodes], "node_id string"))
    circle = ring_of(nodes)
    # Keys on a ring point, at both ends of the circle, and anywhere.
    labels = [f"{nodes[0]}:{i}" for i in range(3)] + [f"key{i}" for i in range(300)]
    keys = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {}
    for r in sorted(joins.replicas(keys, "label", ring, 3).collect(), key=lambda r: r.replica):
        got.setdefault(r.label, []).append(r.node_id)
    assert got == {x: walk(circle, signed(x), 3) for x in labels}
    follow = {r.node_id: r.next_node_id for r in joins.failover_nodes(ring).collect()}
    for n in nodes:
        first = min(h for h in circle if circle[h] == n)
        others = [x for x in walk(circle, first + 1, count) if x != n]
        assert follow[n] == (others[0] if others else None)


def test_quota_check_default_and_border(spark, rows):
    req = spark.createDataFrame([(1, "t", "S", 10), (2, "t", "S", 11), (3, "u", "S", 1 << 30), (4, "u", "S", (1 << 30) + 1)], "id long, tenant_id string, resource string, amount long")
    usage = spark.createDataFrame([("t", "S", 90)], "tenant_id string, resource string, used long")
    quota = spark.createDataFrame([("t", "S", 100)], "tenant_id string, resource string, quota_limit long")
    assert rows(joins.quota_check(req, usage, quota), "id", "admitted") == [(1, True), (2, False), (3, True), (4, False)]


def test_empty_fleet(spark):
    empty = {
        "devices": "device_id long, is_online boolean, last_sync timestamp",
        "files": "size long, is_deleted boolean, backup_time timestamp",
        "chunks": "chunk_id long",
        "jobs": "status string",
    }
    frames = [spark.createDataFrame([], s) for s in empty.values()]
    row = aggregates.fleet_stats(*frames).first()
    assert row.total_devices == 0 and row.total_size == 0 and row.last_activity is None


def test_bytes_per_device_without_rows(spark, rows):
    snaps = spark.createDataFrame([(1, 5)], "device_id long, size long")
    devices = spark.createDataFrame([(1,), (2,)], "device_id long")
    assert rows(aggregates.bytes_per_device(snaps, devices)) == [(1, 5), (2, None)]


def test_schedule_totals_of_nothing(spark):
    zero = spark.createDataFrame([(0,)], "estimated_duration int")
    assert aggregates.schedule_totals(zero).first().time_reduction is None


def test_windowed_stats_match_a_direct_grouping(spark, rows):
    data = [(at(1, 0, i % 9, i % 60), "t" if i % 3 else "hot", "F", None if i % 7 == 0 else i, i) for i in range(200)]
    df = spark.createDataFrame(data, "timestamp timestamp, tenant_id string, backup_type string, size long, duration long")
    direct = df.groupBy(F.window("timestamp", "5 minutes", "1 minute").alias("w"), "tenant_id", "backup_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("size"), F.sum("size"), F.avg("duration")
    )
    assert rows(aggregates.windowed_stats(df)) == rows(direct.select("w.start", "w.end", "tenant_id", "backup_type", "n", "avg(size)", "sum(size)", "avg(duration)"))


def test_directory_tree(spark, rows):
    df = spark.createDataFrame([("/a/x",), ("/a/b/y",), ("/a/b/c/z",), ("/r",), ("/a/b/c/d/w",)], "path string")
    assert rows(aggregates.directory_tree(df)) == [("/", 0, 1, 1), ("/a", 1, 1, 1), ("/a/b", 2, 1, 1), ("/a/b/c", 3, 0, 0)]


def test_conflict_rules(spark, rows):
    f = [
        ("one", "a", at(1), True), ("one", "b", at(2), False),
        ("pri", "a", at(1), False), ("pri", "b", at(9), False),
        ("unk", "a", at(9), False), ("unk", "zz", at(1), False),
        ("tie", "c", at(1), False), ("tie", "c2", at(1), False),
        ("del", "a", at(1), True), ("del", "b", at(3), True),
        ("win", "a", at(9), True), ("win", "b", at(1), False), ("win", "c", at(2), False),
    ]
    df = spark.createDataFrame(f, "path string, device_id string, backup_time timestamp, is_deleted boolean")
    got = dict(rows(windows.resolve_conflicts(df, ["a", "b"]), "path", "device_id"))
    assert got == {"one": "b", "pri": "a", "unk": "zz", "tie": "c", "del": "b", "win": "c"}


def test_merge_is_commutative_and_idempotent(spark, rows):
    schema = "path string, version long, timestamp timestamp, node_id string"
    a = spark.createDataFrame([("p", 1, at(1), "x"), ("q", 2, at(1), "x")], schema)
    c = spark.createDataFrame([("p", 1, at(1), "y"), ("q", 1, at(9), "y"), ("r", 1, at(1), "y")], schema)
    by = ["version", "timestamp", "node_id"]
    merged = rows(sets.merge_states([a, c], ["path"], by))
    assert merged == rows(sets.merge_states([c, a], ["path"], by)) == rows(sets.merge_states([a, c, a], ["path"], by))
    assert [m[3] for m in merged] == ["y", "x", "y"]


def test_tombstones(spark, rows):
    state = spark.createDataFrame([("a", at(2)), ("b", at(2)), ("c", at(2))], "path string, timestamp timestamp")
    tombs = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("b", at(1))], "path string, deleted_at timestamp")
    assert rows(sets.drop_deleted(state, tombs, ["path"]), "path") == [("a",), ("c",)]


def test_optimal_windows(spark, rows):
    scores = [0.9, 0.5, 0.8, 0.8, 0.7, 0.9, 0.7, 0.75, 0.85, 0.1, 0.9, 0.9]
    df = spark.createDataFrame([("t", at(1, h), s) for h, s in enumerate(scores)], "tenant string, hour_ts timestamp, quality_score double")
    got = rows(windows.optimal_windows(df, ["tenant"]), "start_time", "duration_hours")
    # Single hours and scores of exactly 0.7 do not count; the run open at the end is dropped.
    assert got == [(at(1, 2), 2), (at(1, 7), 2)]
    assert len(rows(windows.optimal_windows(df, ["tenant"], close_trailing=True))) == 3


def test_keys(spark, rows):
    schema = "device_id string, key_id string, created_at timestamp, is_active boolean"
    keys = spark.createDataFrame([("a", "1", at(1), True), ("a", "2", at(2), False), ("b", "3", at(1), False), ("b", "4", at(2), False)], schema)
    assert rows(windows.active_key(keys), "device_id", "key_id") == [("a", "1"), ("b", "4")]
    assert rows(windows.mark_active_keys(keys), "key_id", "is_active") == [("1", False), ("2", True), ("3", False), ("4", True)]


def test_retention_keeps_newest_versions_within_age(spark, rows):
    now = at(31)
    data = [("d", "p", f"s{i:02d}", at(31) - dt.timedelta(days=i), "FULL") for i in range(14)]
    data += [("d", "q", "in", at(24), "INCREMENTAL"), ("d", "q", "old", at(23), "INCREMENTAL"), ("d", "q", "full", at(1), "FULL")]
    df = spark.createDataFrame(data, "device_id string, path string, snapshot_id string, created_at timestamp, backup_type string")
    kept = {r.snapshot_id for r in windows.retained(df, F.lit(now)).collect()}
    assert kept == {f"s{i:02d}" for i in range(10)} | {"in", "full"}


@pytest.mark.parametrize("size, out", [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (1024**5, "1024.0 TB")])
def test_format_bytes(spark, size, out):
    assert spark.range(1).select(text.format_bytes(F.lit(size))).first()[0] == out


def test_other_formats(spark):
    now = F.lit(10 * 86_400_000)
    row = spark.range(1).select(
        text.format_age(F.lit(0), now).alias("never"),
        text.format_age(F.lit(86_400_000), now).alias("weeks"),
        text.format_age_short(F.lit(10 * 86_400_000 - 5), now).alias("now"),
        text.format_uptime(F.lit(93784)).alias("up"),
        text.format_count(F.lit(2_500_000)).alias("m"),
        text.title_service(F.lit("sync-coordinator_x")).alias("name"),
        text.join_path(F.lit(""), F.lit("a")).alias("root"),
        text.file_class(F.lit("/a/b.MP4")).alias("cls"),
    ).first()
    assert tuple(row) == ("Never", "1w ago", "Just now", "1d 2h 3m", "2.5M", "Sync Coordinator X", "a", "VIDEO")


def test_rules_and_hash(spark):
    row = spark.range(1).select(
        features.success_rate(F.lit(4000.0)).alias("s"),
        features.floor_duration(F.lit(3.0)).alias("f"),
        features.saved_ratio(F.lit(0), F.lit(5)).alias("z"),
        features.java_hash(F.lit("Supplier#1:0")).alias("h"),
        features.normality_score(F.lit(-3.0)).alias("n"),
    ).first()
    assert row.s == pytest.approx(1 - 4000 / 36000) and row.f == 30.0 and row.z == 0.0 and row.n == 0.0
    assert row.h == signed("Supplier#1:0")


def test_directory_listing(spark, tmp_path, rows):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "f.txt").write_text("12345")
    (tmp_path / "a" / "b" / "g.txt").write_text("1")
    files = readers.directory_listing(spark, str(tmp_path))
    assert rows(files, "name", "size") == [("f.txt", 5), ("g.txt", 1)]
    every = readers.with_directories(files)
    base = str(tmp_path)
    assert {r.path for r in every.filter("is_directory").collect()} >= {base, f"{base}/a", f"{base}/a/b"}
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_time_encodings(spark):
    row = spark.range(1).select(
        readers.to_utc(F.lit(1000), "epoch_ms").alias("a"),
        readers.to_utc(F.lit(1), "epoch_s").alias("b"),
        readers.to_utc(F.lit("1970-01-01T00:00:01Z"), "iso").alias("c"),
        readers.to_utc(F.lit("junk"), "iso").alias("d"),
    ).first()
    assert row.a == row.b == row.c and row.d is None


def test_replayed_batch_is_not_doubled(spark, tmp_path):
    write = sinks.batch_writer(str(tmp_path / "out"))
    df = spark.range(5)
    write(df, 3)
    write(df, 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_key_registry_never_holds_secrets(spark, tmp_path):
    df = spark.createDataFrame([("k", "d", "A", "S", 1, 2, True, "hidden")], "keyId string, deviceId string, algorithm string, keyDerivation string, iterations int, createdAt long, isActive boolean, encryptedKey string")
    sinks.write_keys(df, str(tmp_path / "keys"))
    text_out = "".join(p.read_text() for p in (tmp_path / "keys").glob("*.json"))
    assert "hidden" not in text_out
    assert readers.key_registry(spark, str(tmp_path / "keys")).first().keyId == "k"


def test_recipient_counts(spark, rows):
    updates = spark.createDataFrame([(1, "a"), (2, "x")], "id long, device_id string")
    peers = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "device_id string, is_open boolean")
    assert rows(joins.recipient_counts(updates, peers), "id", "recipients") == [(1, 1), (2, 2)]
