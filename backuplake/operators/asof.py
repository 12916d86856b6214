"""As-of joins: for each request the newest version up to its own time.

Requests and versions are range-partitioned together by key and time, so a key with a third of all rows spans many
blocks. Each block finds the last version before each of its requests; what a block needs from the blocks before it
is the last version of its first key, at most one row per block.

A version at the very time of a request counts; of versions at the same time the one with the greatest `tie` does.
Null keys, times and ties meet nothing: such versions are left out, such requests come back without a version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.operators import ordered
from backuplake.operators.ordered import BLOCK


def latest_before(
    requests: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, ts: str, tie: str, payload: Sequence[str], parts: int | None = None
) -> DataFrame:
    """`requests` plus the version's `payload` columns; null where no version is old enough.

    Payload columns must not carry names of request columns.
    """
    keys, given, time = list(keys), [c for c in requests.columns if c not in keys], F.col(at)
    order = ["_time", "_asks", "_tie"]
    ask = F.struct(*[F.col(c) for c in given])
    # Versions come before requests of the same time.
    rows = versions.select(
        *keys, F.col(ts).alias("_time"), F.lit(False).alias("_asks"), F.col(tie).alias("_tie"),
        F.struct(*payload).alias("_version"), F.lit(None).cast(requests.select(ask.alias("x")).schema["x"].dataType).alias("_ask"),
    )
    usable = [F.col(k).isNotNull() for k in keys]
    rows = rows.filter(F.col("_time").isNotNull() & F.col("_tie").isNotNull())
    for k in usable:
        rows = rows.filter(k)
    kinds = rows.schema
    open_ = requests.withColumn("_open", time.isNotNull())
    for k in usable:
        open_ = open_.withColumn("_open", F.col("_open") & k)
    asks = open_.filter("_open").select(
        *keys, time.cast(kinds["_time"].dataType).alias("_time"), F.lit(True).alias("_asks"), F.lit(None).cast(kinds["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(kinds["_version"].dataType).alias("_version"), ask.alias("_ask"),
    )
    blocks = ordered.sorted_blocks(rows.unionByName(asks), keys, order, parts)
    last = blocks.groupBy(*keys, BLOCK).agg(F.max_by("_version", F.when(~F.col("_asks"), F.struct("_time", "_tie"))).alias("_last"))
    chain = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(chain)).filter("_carried IS NOT NULL")
    # What is carried on stands before the rows of its block: no time sorts first.
    first = carry.select(
        *keys, F.lit(None).cast(kinds["_time"].dataType).alias("_time"), F.lit(False).alias("_asks"), F.lit(None).cast(kinds["_tie"].dataType).alias("_tie"),
        F.col("_carried").alias("_version"), F.lit(None).cast(kinds["_ask"].dataType).alias("_ask"), BLOCK,
    )
    before = Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = blocks.unionByName(first).withColumn("_found", F.last("_version", ignorenulls=True).over(before)).filter("_asks")
    picked = [F.col(f"_found.{c}").alias(c) for c in payload]
    out = found.select(*keys, *[F.col(f"_ask.{c}").alias(c) for c in given], *picked)
    rest = open_.filter("NOT _open").select(*keys, *given, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in payload])
    return out.unionByName(rest).select(*requests.columns, *payload)
