"""Joins. The lookup side is unique per key in every join here, so adaptive skew splitting can cut a hot
key of the row side. It does so only where exchange and sort are next to each other: lookups that must
first be made unique are written out (`unique_keys`), which takes that step out of the join's stage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.session import pin

DEFAULT_QUOTA = 1 << 30
#: Buckets of a ring; their bounds travel with the lookup.
RING_CUTS = 4096


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, written out for a join that adaptive execution can split."""
    return pin(df.select(*keys).distinct(), "unique-keys")


def file_chunks(files: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """A file's chunks with their list position: unknown chunks dropped, repeats kept."""
    listed = files.select(*keys, F.posexplode("chunks").alias("pos", "chunk_id"))
    return listed.join(chunks, "chunk_id", "inner")


def orphan_chunks(chunks: DataFrame, references: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks nothing refers to. References shrink to distinct ids before they are shuffled."""
    return chunks.join(unique_keys(references, key), key, "left_anti")


def quota_check(requests: DataFrame, usage: DataFrame, quotas: DataFrame, default_limit: int = DEFAULT_QUOTA) -> DataFrame:
    """Admits a request when usage plus amount stays within the limit."""
    keys = ["tenant_id", "resource"]
    joined = requests.join(usage, keys, "left").join(quotas, keys, "left")
    used, limit = F.coalesce("used", F.lit(0)), F.coalesce("quota_limit", F.lit(default_limit))
    return joined.withColumns({"used": used, "quota_limit": limit, "admitted": used + F.col("amount") <= limit})


def duplicate_flags(incoming: DataFrame, index: DataFrame, key: str = "digest") -> DataFrame:
    """Each incoming chunk with `is_duplicate`. `index` may list a digest many times."""
    known = unique_keys(index, key).withColumn("_known", F.lit(True))
    return (
        incoming.join(known, key, "left")
        .withColumn("is_duplicate", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def new_chunks(incoming: DataFrame, index: DataFrame, key: str = "digest") -> DataFrame:
    return incoming.join(unique_keys(index, key), key, "left_anti")


def known_chunks(incoming: DataFrame, index: DataFrame, key: str = "digest") -> DataFrame:
    return incoming.join(unique_keys(index, key), key, "left_semi")


def restore_plan(requests: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requested files to their chunk rows.

    `requests`: restore_id, backup_id, files (array of paths). `manifest`: backup_id, path, chunks.
    """
    wanted = requests.select("restore_id", "backup_id", F.explode("files").alias("path"))
    found = wanted.join(manifest, ["backup_id", "path"], "inner")
    return file_chunks(found, chunks, keys=["restore_id", "backup_id", "path"])


def state_as_of(snapshots: DataFrame, keys: Sequence[str], at: str | None = None) -> DataFrame:
    """The live row per key before `at` (the end without it): its newest row, however old, unless that is a deletion.

    `snapshots`: the keys, snapshot_id, created_at, checksum, is_deleted.
    """
    rows = snapshots if at is None else snapshots.filter(F.col("created_at") < at)
    newest = rows.groupBy(*keys).agg(
        F.max_by(F.struct("checksum", "is_deleted"), F.struct("created_at", "snapshot_id")).alias("_newest")
    )
    return newest.filter(~F.coalesce("_newest.is_deleted", F.lit(False))).select(*keys, "_newest.checksum")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], checksum: str = "checksum") -> DataFrame:
    """new / modified / deleted / unchanged per key; each side has one row per key."""
    a = old.select(*keys, F.col(checksum).alias("old_checksum"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(checksum).alias("new_checksum"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, list(keys), "full_outer").withColumn("change", change).drop("_in_old", "_in_new")


def lineage(snapshots: DataFrame) -> DataFrame:
    """Base snapshot and distance of every snapshot. `snapshots`: snapshot_id, parent_id.

    Pointer doubling: each step doubles the distance covered, so a chain of n parents takes
    log2(n) joins. Snapshots that have reached their base drop out of the joins, so a base with
    very many descendants is never a join key.
    """
    hops = pin(
        snapshots.select(
            "snapshot_id",
            F.coalesce("parent_id", "snapshot_id").alias("base_id"),
            F.col("parent_id").isNotNull().cast("bigint").alias("depth"),
            F.col("parent_id").isNotNull().alias("_open"),
        ),
        "lineage",
    )
    # A chain cannot be longer than the number of ids; a cycle would never close.
    for _ in range(64):
        if hops.filter("_open").isEmpty():
            return hops.drop("_open")
        up = hops.select(
            F.col("snapshot_id").alias("base_id"),
            F.col("base_id").alias("_up_base"),
            F.col("depth").alias("_up_depth"),
            F.col("_open").alias("_up_open"),
        )
        moved = hops.filter("_open").join(up, "base_id", "left").select(
            "snapshot_id",
            F.coalesce("_up_base", "base_id").alias("base_id"),
            (F.col("depth") + F.coalesce("_up_depth", F.lit(0))).alias("depth"),
            F.coalesce("_up_open", F.lit(False)).alias("_open"),
        )
        hops = pin(hops.filter("NOT _open").unionByName(moved), "lineage")
    raise ValueError("snapshot parents form a cycle")


def ring_points(nodes: DataFrame, node: str = "node_id", points: int = 3) -> DataFrame:
    """Ring positions `"{id}:{i}"`; on equal hashes the node added last wins.

    The ring is written out, as placement reads it several times; it has three rows per node.
    """
    placed = nodes.select(
        F.col(node).alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")
    )
    label = F.concat(F.col("node_id").cast("string"), F.lit(":"), F.col("_i").cast("string"))
    hashes = placed.select("node_id", features.java_hash(label).alias("ring_hash"))
    return pin(hashes.groupBy("ring_hash").agg(F.max("node_id").alias("node_id")), "ring")


def _followers(ring: DataFrame, reach: int, start: int) -> DataFrame:
    """Each ring point with the nodes of the points after it, clockwise, wrapping around.

    The window has no partition key: a ring holds three rows per storage node.
    """
    lap = 1 << 32
    laps = ring.select("ring_hash", "node_id", F.explode(F.array(F.lit(0), F.lit(lap))).alias("_lap")).select(
        (F.col("ring_hash") + F.col("_lap")).alias("_at"), "node_id"
    )
    ahead = Window.orderBy("_at").rowsBetween(start, reach)
    out = laps.select(
        F.col("_at").alias("ring_hash"), "node_id", F.array_distinct(F.collect_list("node_id").over(ahead)).alias("_next")
    )
    return out.filter(F.col("ring_hash") < (1 << 31))


def ring_cuts(ring: DataFrame, most: int = RING_CUTS) -> list[int]:
    """At most `most` ring points, equally many points apart; they bound the buckets of the ring."""
    every = -(-ring.count() // most)
    numbered = ring.select("ring_hash", F.row_number().over(Window.orderBy("ring_hash")).alias("_n"))
    return sorted(r.ring_hash for r in numbered.filter(F.col("_n") % max(every, 1) == 0).collect())


def _bucket(cuts: Sequence[int]):
    """Expression of the bucket a hash lies in: the number of cuts below it."""
    bounds = np.array(cuts, dtype="int64")

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, hashes.to_numpy("int64"), side="left").astype("int32"))

    return place


def replica_ranges(ring: DataFrame, count: int, cuts: Sequence[int], points: int = 3) -> DataFrame:
    """Hash ranges (lo, hi] with their replica nodes and their bucket, so a key finds its range by an
    equi-join instead of by comparing it with the whole ring.

    Cuts are ring points, so a range never crosses one, and all buckets hold equally many ranges
    however close together the hashes lie.
    """
    lowest, highest = -(1 << 31), (1 << 31) - 1
    stops = _followers(ring, points * count, 0).select("ring_hash", F.slice("_next", 1, count).alias("nodes"))
    by_hash = Window.orderBy("ring_hash")
    ranges = stops.select(
        (F.coalesce(F.lag("ring_hash").over(by_hash), F.lit(lowest - 1)) + 1).alias("lo"),
        F.col("ring_hash").alias("hi"),
        "nodes",
    )
    # Keys above the last point belong to the first one.
    wrap = stops.agg(
        (F.max("ring_hash") + 1).alias("lo"),
        F.lit(highest).cast("bigint").alias("hi"),
        F.min_by("nodes", "ring_hash").alias("nodes"),
    )
    both = ranges.unionByName(wrap).filter("lo <= hi")
    return pin(both.withColumn("bucket", _bucket(cuts)("hi")).coalesce(1), "ring-ranges")


def replicas(keys: DataFrame, key: str, ring: DataFrame, count: int = 3, points: int = 3) -> DataFrame:
    """The first `count` distinct nodes clockwise from the key's hash, one row per replica.

    A null key has no replica."""
    cuts = ring_cuts(ring)
    ranges = replica_ranges(ring, count, cuts, points)
    hashed = keys.filter(F.col(key).isNotNull()).withColumn("key_hash", features.java_hash(F.col(key)))
    placed = hashed.withColumn("bucket", _bucket(cuts)("key_hash"))
    found = placed.join(ranges, "bucket", "inner").filter(F.col("key_hash").between(F.col("lo"), F.col("hi")))
    return found.select(*keys.columns, "key_hash", F.posexplode("nodes").alias("replica", "node_id"))


def failover_nodes(ring: DataFrame, points: int = 3) -> DataFrame:
    """For each node, the next ring point after its smallest hash owned by another node."""
    follow = _followers(ring, points, 1).groupBy("node_id").agg(F.min_by("_next", "ring_hash").alias("_next"))
    others = F.filter("_next", lambda n: n != F.col("node_id"))
    return follow.select("node_id", F.get(others, F.lit(0)).alias("next_node_id"))


def inbox(updates: DataFrame, peer, source: str = "device_id") -> DataFrame:
    """The updates one peer receives."""
    return updates.filter(F.col(source) != F.lit(peer)).withColumn("peer_id", F.lit(peer))


def recipient_counts(updates: DataFrame, peers: DataFrame, source: str = "device_id") -> DataFrame:
    """How many peers each update goes to, without writing out the pairs."""
    open_peers = peers.filter("is_open").select(F.col("device_id").alias(source), F.lit(1).alias("_self"))
    total = open_peers.agg(F.count(F.lit(1)).alias("_open"))
    return (
        updates.join(open_peers, source, "left")
        .join(F.broadcast(total), F.lit(True), "left")
        .withColumn("recipients", F.col("_open") - F.coalesce("_self", F.lit(0)))
        .drop("_self", "_open")
    )


def job_summary(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Jobs with file count and bytes of their snapshots; jobs without snapshots count zero."""
    sums = snapshots.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"), F.max("created_at").alias("_last")
    )
    return jobs.join(sums, "job_id", "left").select(
        "job_id",
        "device_id",
        "status",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.coalesce("total_size", F.lit(0)).alias("total_size"),
        (F.unix_timestamp("_last") - F.unix_timestamp("created_at")).alias("duration_seconds"),
    )


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    return left.join(F.broadcast(right), F.lit(True), "left")

