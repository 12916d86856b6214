"""Set operations on replica states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.operators.windows import latest_by


def merge_states(states: Sequence[DataFrame], keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Union of keys with one winner per key. `by` must tell any two different rows of a key
    apart; then order and repetition of the inputs do not matter."""
    union = states[0]
    for other in states[1:]:
        union = union.unionByName(other)
    return latest_by(union, keys, by)


def drop_deleted(state: DataFrame, tombstones: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Removes paths whose newest tombstone is not older than their write."""
    last = tombstones.groupBy(*keys).agg(F.max("deleted_at").alias("_deleted_at"))
    dead = F.col("_deleted_at") >= F.col(ts)
    return (
        state.join(last, list(keys), "left").filter(F.col("_deleted_at").isNull() | ~dead).drop("_deleted_at")
    )


def referenced_chunks(files: DataFrame) -> DataFrame:
    """Distinct chunk ids of live files."""
    return files.filter(~F.col("is_deleted")).select(F.explode("chunks").alias("chunk_id")).distinct()
