"""Per-key ordering work.

Winners come from a rank filter or from `max_by`. Spark cuts the former to the wanted rank in
each map task, and combines the latter there, so a hot key sends a row per task. Work that
needs every row in order goes through `ordered`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from backuplake.operators.ordered import BLOCK, running_totals, sorted_blocks


def latest_by(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the greatest `by` per key."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by])
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def resolve_conflicts(files: DataFrame, device_priority: Sequence, device: str = "device_id") -> DataFrame:
    """One winner per path: device priority, then newest backup, then device id.

    Devices outside the list rank first. Deleted candidates lose unless at most one live
    candidate is left; then the path's own record (its newest) is returned as it is.
    """
    rest = F.struct(*[c for c in files.columns if c != "path"])
    ranks = F.array(*[F.lit(d) for d in device_priority])
    rank = F.coalesce(F.array_position(ranks, F.col(device)) - 1, F.lit(-1))
    newest = -F.unix_micros(F.col("backup_time").cast("timestamp"))
    live = ~F.col("is_deleted")
    # Settles candidates that are equal in all of these.
    last = F.xxhash64(*[c for c in files.columns if c != "path"])
    picked = files.groupBy("path").agg(
        F.count_if(live).alias("_live"),
        F.min_by(F.when(live, rest), F.when(live, F.struct(rank, newest, F.col(device), last))).alias("_best"),
        F.min_by(rest, F.struct(newest, F.col(device), last)).alias("_own"),
    )
    return picked.select("path", F.when(F.col("_live") > 1, F.col("_best")).otherwise(F.col("_own")).alias("_w")).select(
        "path", "_w.*"
    )


def lww_register(versions: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Last write wins: version, then clock, then node."""
    return latest_by(versions, keys, ["version", "timestamp", "node_id"])


def latest_state(base: DataFrame, incrementals: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Base plus incrementals folded to the newest state per path, deletions applied.

    One pass over the union, whatever the length of the chain.
    """
    return latest_by(base.unionByName(incrementals), keys, by).filter(~F.col("is_deleted"))


def optimal_windows(
    scores: DataFrame,
    keys: Sequence[str],
    threshold: float = 0.7,
    min_hours: int = 2,
    close_trailing: bool = False,
) -> DataFrame:
    """Runs of consecutive recommended hours. `scores`: keys, hour_ts, quality_score.

    An hour without a row ends a run. A run still open at the end of the horizon is dropped unless `close_trailing`. A key has
    one row per hour of its horizon, which bounds the window.
    """
    by_hour = Window.partitionBy(*keys).orderBy("hour_ts")
    marked = scores.withColumn("_last", F.lead("hour_ts").over(by_hour).isNull()).filter(F.col("quality_score") > threshold)
    hour = F.unix_seconds(F.col("hour_ts").cast("timestamp")) / 3600
    runs = (
        marked.withColumn("_run", hour - F.row_number().over(by_hour))
        .groupBy(*keys, "_run")
        .agg(
            F.min("hour_ts").alias("start_time"),
            F.max("hour_ts").alias("end_time"),
            F.count(F.lit(1)).alias("duration_hours"),
            F.avg("quality_score").alias("avg_quality"),
            F.bool_or("_last").alias("_open"),
        )
        .filter(F.col("duration_hours") >= min_hours)
    )
    if not close_trailing:
        runs = runs.filter(~F.col("_open"))
    return runs.drop("_run", "_open")


def mark_active_keys(keys: DataFrame) -> DataFrame:
    """Only a device's newest key is active. `keys`: device_id, key_id, created_at, is_active."""
    newest = keys.groupBy("device_id").agg(F.max_by("key_id", F.struct("created_at", "key_id")).alias("_newest"))
    return (
        keys.join(newest, "device_id")
        .withColumn("is_active", F.col("key_id") == F.col("_newest"))
        .select(*keys.columns)
    )


def active_key(keys: DataFrame) -> DataFrame:
    """The flagged key per device (the earliest flagged), else the last key."""
    rest = F.struct(*[c for c in keys.columns if c != "device_id"])
    at = F.struct("created_at", "key_id")
    flagged = F.min_by(F.when(F.col("is_active"), rest), F.when(F.col("is_active"), at))
    return keys.groupBy("device_id").agg(F.coalesce(flagged, F.max_by(rest, at)).alias("_k")).select("device_id", "_k.*")


def retained(
    snapshots: DataFrame,
    as_of: Column,
    full_days: int = 30,
    incremental_days: int = 7,
    max_versions: int = 10,
    keys: Sequence[str] = ("device_id", "path"),
    tie: str = "snapshot_id",
) -> DataFrame:
    """Snapshots within their age limit and among the newest versions of their path.

    Rows older than the longest age limit rank behind all others, so they are cut at the scan. The
    rank filter cuts each map task to `max_versions` rows per path before the shuffle.
    """
    oldest = as_of - F.make_interval(days=F.lit(max(full_days, incremental_days)))
    snapshots = snapshots.filter(F.col("created_at") >= oldest)
    days = F.when(F.col("backup_type") == "FULL", full_days).otherwise(incremental_days)
    order = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col(tie).desc())
    ranked = snapshots.withColumn("version_rank", F.row_number().over(order)).filter(
        F.col("version_rank") <= max_versions
    )
    return ranked.filter(F.col("created_at") >= as_of - F.make_interval(days=days)).withColumn(
        "version_rank", F.col("version_rank").cast("bigint")
    )


def latest_modifications(changes: DataFrame) -> DataFrame:
    """Newest modification per device and inode, flagged for backup."""
    return changes.groupBy("device_id", "inode").agg(
        F.max("modified_at").alias("modified_at"), F.lit(True).alias("needs_backup")
    )


def stale_peers(heartbeats: DataFrame, as_of: Column, seconds: int = 30) -> DataFrame:
    """Peers silent for more than `seconds`."""
    last = heartbeats.groupBy("device_id").agg(F.max("ts").alias("last_heartbeat"))
    return last.filter(F.col("last_heartbeat") < as_of - F.make_interval(secs=F.lit(seconds)))


def dirty_triggers(writes: DataFrame, threshold: int = 1000, parts: int | None = None) -> DataFrame:
    """Moments at which a device's first-dirtied blocks exceed the threshold.

    Dirty flags stay set, so every `threshold + 1`-th distinct block fires.
    `writes`: device_id, block_number, ts.
    """
    first = writes.groupBy("device_id", "block_number").agg(F.min("ts").alias("ts"))
    counted = running_totals(first, ["device_id"], ["ts", "block_number"], {"dirty_seen": F.lit(1)}, parts)
    return counted.filter(F.col("dirty_seen") % (threshold + 1) == 0).withColumn(
        "trigger_no", (F.col("dirty_seen") / (threshold + 1)).cast("bigint")
    )


# --- quota -----------------------------------------------------------------------------------


def admit(amounts: np.ndarray, remaining: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Serial admission: each accepted amount uses up the remainder, rejected ones do not.

    Returns which amounts are admitted, the remainder after each, and the last remainder. While a
    remainder lies between two powers of two, all amounts below the lower one fit; one that is not
    below it fits at most once. So a run is cut only where the remainder changes its size.
    """
    values = np.asarray(amounts, dtype="int64")
    taken, at, rest = np.zeros(len(values), dtype=bool), 0, int(remaining)
    while at < len(values):
        if rest <= 0:
            taken[at:] = values[at:] <= rest
            break
        border = 1 << (rest.bit_length() - 1)
        # So many amounts below the border cannot exceed 64 bits in sum.
        part = values[at : at + max(1, (1 << 62) // border)]
        small = part < border
        used = np.cumsum(np.where(small, part, 0))
        stops = np.flatnonzero(np.where(small, rest - used < border, part <= rest - used))
        end = int(stops[0]) if len(stops) else len(part) - 1
        taken[at : at + end + 1] = small[: end + 1]
        taken[at + end] |= len(stops) > 0
        rest -= int(used[end]) + (int(part[end]) if len(stops) and not small[end] else 0)
        at += end + 1
    left = int(remaining) - np.cumsum(np.where(taken, values, 0))
    return taken, left, rest


def _profile(amounts: np.ndarray, cap: int) -> tuple[list[int], list[int | None]]:
    """What a block does to a remainder of each power-of-two size that a limit of `cap` allows.

    For a remainder in [2^k, 2^(k+1)): `small[k]` is the sum of amounts below 2^k, all admitted
    while the remainder keeps its size; `gate[k]` is the least remainder at block start that
    would let one of the larger amounts in.
    """
    values = np.asarray(amounts, dtype="int64")
    if not len(values):
        return [0], [None]
    if float(values.astype("float64").sum()) > 2.0**62:
        values = values.astype(object)
    most = (1 << 63) - 1
    top = max(0, min(int(values.max()).bit_length() + 1, int(cap).bit_length() - 1))
    small, gate = [], []
    for k in range(top + 1):
        below = values < (1 << k)
        before = np.cumsum(np.where(below, values, 0))
        needed = (values + before)[~below.astype(bool)]
        small.append(min(most, int(before[-1])))
        gate.append(min(most, int(needed.min())) if len(needed) else None)
    return small, gate


def _passes(small: list[int], gate: list[int | None], remaining: int) -> int | None:
    """Remainder after the block, or None when the profile cannot tell."""
    if remaining <= 0:
        return remaining
    size = remaining.bit_length() - 1
    k = min(size, len(small) - 1)
    if gate[k] is not None and gate[k] <= remaining:
        return None
    after = remaining - small[k]
    # With every amount below the border no size change matters as long as all fit.
    if after >= (1 << size) or (k < size and after >= (1 << k)):
        return after
    return None


_KEY, _START, _USED = "_quota_key", "_quota_start", "_quota_used"


def _ordered(table: pa.Table, by: Sequence[str]) -> pa.Table:
    """Rows in Spark's order: ascending, nulls first."""
    keys = [(c, "ascending") for c in by]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def _amounts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Amounts, and which rows have one."""
    column = table.column("amount")
    known = pc.is_valid(column).to_numpy(zero_copy_only=False).astype(bool)
    return pc.fill_null(column, 0).cast(pa.int64()).to_numpy(), known


def consume_quota(
    requests: DataFrame,
    limits: DataFrame | None = None,
    order: Sequence[str] = ("ts", "request_id"),
    keys: Sequence[str] = ("tenant_id", "resource"),
    default_limit: int = 1 << 30,
    warn_share: float = 0.8,
    parts: int | None = None,
    used: DataFrame | None = None,
) -> DataFrame:
    """Quota consumption in arrival order: rejected requests consume nothing.

    Exact for tenants of any size. Rows are cut into ordered blocks. A key within one block is
    folded there. For keys that span blocks, each block is first profiled in parallel; the
    driver walks those profiles (at most two rows per block) and asks for a fold only of blocks
    where the remainder changes its power-of-two size, which happens at most once per bit.
    Amounts are whole and not negative; a request without an amount is not admitted. A null in the
    keys is a tenant or resource of its own. Other columns pass through Arrow unchanged.
    `limits` and `used` (what each key has used before, if anything) have one row per key.
    """

    def looked_up(rows: DataFrame, table: DataFrame | None, name: str, otherwise: int, to: str) -> DataFrame:
        fallback = F.lit(otherwise).cast("bigint")
        if table is None:
            return rows.withColumn(to, fallback)
        own = table.select(*[F.col(c).alias(f"_own_{c}") for c in keys], F.col(name).cast("bigint").alias("_own"))
        same = [rows[c].eqNullSafe(own[f"_own_{c}"]) for c in keys]
        found = rows.join(own, same, "left").withColumn(to, F.coalesce("_own", fallback))
        return found.drop("_own", *[f"_own_{c}" for c in keys])

    requests = looked_up(requests, limits, "quota_limit", default_limit, "quota_limit")
    requests = looked_up(requests, used, "used", 0, _USED)
    # The fold starts from what is left of the limit.
    left = requests.withColumn("quota_limit", F.col("quota_limit") - F.col(_USED))
    folded = _folded(left, order, keys, parts)
    whole = {c: F.col(c) + F.col(_USED) for c in ("quota_limit", "used_after")}
    return folded.withColumns(whole).drop(_USED).withColumn(
        "warned", F.col("admitted") & (F.col("used_after") > F.col("quota_limit") * warn_share)
    )


def _folded(requests: DataFrame, order: Sequence[str], keys: Sequence[str], parts: int | None) -> DataFrame:
    """`requests` with `admitted` and `used_after`, each key folded against its `quota_limit`."""
    # One text per key: nulls are left out of it, so they group and join like any value.
    keyed = requests.withColumn(_KEY, F.to_json(F.struct(*keys)))
    blocks = sorted_blocks(keyed, [_KEY], order, parts)
    by = [_KEY, *order]
    starts = _block_starts(blocks, order)
    if starts:
        seeds = blocks.sparkSession.createDataFrame(
            [(key, block, rest) for (key, block), rest in starts.items()], f"{_KEY} string, {BLOCK} int, {_START} bigint"
        )
        # Proven bound: two rows per block at most.
        tagged = blocks.join(F.broadcast(seeds), [_KEY, BLOCK], "left")
    else:
        tagged = blocks.withColumn(_START, F.lit(None).cast("bigint"))
    kept = requests.columns

    def fold(table: pa.Table) -> pa.Table:
        table = _ordered(table, by)
        values, known = _amounts(table)
        names = table.column(_KEY).combine_chunks().dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        admitted, used = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype="int64")
        for lo, hi in zip(edges, edges[1:]):
            cap, start = table.column("quota_limit")[lo].as_py(), table.column(_START)[lo].as_py()
            start = cap if start is None else start
            here = np.flatnonzero(known[lo:hi]) + lo
            admitted[here] = admit(values[here], start)[0]
            used[lo:hi] = cap - start + np.cumsum(np.where(admitted[lo:hi], values[lo:hi], 0))
        out = table.select(kept)
        return out.append_column("admitted", pa.array(admitted)).append_column("used_after", pa.array(used))

    schema = StructType([*requests.schema.fields, StructField("admitted", BooleanType()), StructField("used_after", LongType())])
    return tagged.groupBy(BLOCK).applyInArrow(fold, schema)


def _block_starts(blocks: DataFrame, order: Sequence[str]) -> dict[tuple[str, int], int]:
    """Remainder at the start of every (key, block) of the keys that span blocks."""
    narrow = blocks.select(_KEY, BLOCK, *order, "amount", "quota_limit")
    spanning = (
        blocks.groupBy(_KEY).agg(F.min(BLOCK).alias("_lo"), F.max(BLOCK).alias("_hi")).filter("_lo < _hi").select(_KEY)
    )
    # A key that spans blocks crosses a border, so there are fewer of them than blocks.
    rows = narrow.join(F.broadcast(spanning), _KEY, "left_semi")

    def profile(table: pa.Table) -> pa.Table:
        values, known = _amounts(_ordered(table, order))
        cap = table.column("quota_limit")[0].as_py()
        small, gate = _profile(values[known], cap)
        return pa.table(
            {
                _KEY: table.column(_KEY)[:1],
                BLOCK: table.column(BLOCK)[:1],
                "cap": pa.array([cap], pa.int64()),
                "small": pa.array([small], pa.list_(pa.int64())),
                "gate": pa.array([gate], pa.list_(pa.int64())),
            }
        )

    def end(table: pa.Table) -> pa.Table:
        values, known = _amounts(_ordered(table, order))
        rest = admit(values[known], table.column(_START)[0].as_py())[2]
        return pa.table({_KEY: table.column(_KEY)[:1], "rest": pa.array([rest], pa.int64())})

    profiles = rows.groupBy(_KEY, BLOCK).applyInArrow(
        profile, f"{_KEY} string, {BLOCK} int, cap bigint, small array<bigint>, gate array<bigint>"
    )
    walk: dict[str, list] = {}
    for row in sorted(profiles.collect(), key=lambda r: r[BLOCK]):
        walk.setdefault(row[_KEY], []).append(row)
    starts: dict[tuple[str, int], int] = {}
    state = {key: (0, items[0]["cap"]) for key, items in walk.items()}
    while state:
        stops = {}
        for key, (at, remaining) in state.items():
            while at < len(walk[key]):
                row = walk[key][at]
                starts[(key, row[BLOCK])] = remaining
                after = _passes(row["small"], row["gate"], remaining)
                if after is None:
                    stops[key] = (at, row[BLOCK], remaining)
                    break
                at, remaining = at + 1, after
        if not stops:
            break
        wanted = blocks.sparkSession.createDataFrame(
            [(key, block, remaining) for key, (_at, block, remaining) in stops.items()],
            f"{_KEY} string, {BLOCK} int, {_START} bigint",
        )
        # A block is one file, so the scan skips all others.
        here = F.col(BLOCK).isin(sorted({block for _at, block, _rest in stops.values()}))
        ends = (
            narrow.filter(here)
            .join(F.broadcast(wanted), [_KEY, BLOCK])
            .groupBy(_KEY, BLOCK)
            .applyInArrow(end, f"{_KEY} string, rest bigint")
            .collect()
        )
        state = {r[_KEY]: (stops[r[_KEY]][0] + 1, r["rest"]) for r in ends}
    return starts
