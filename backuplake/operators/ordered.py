"""Ordered work over keys of any size.

A window partitioned by a hot key puts that key into one task. Here rows are range-partitioned
by (key, order) instead, so one key may span many balanced blocks. Whatever a block needs from
the blocks before it is carried in a table with at most one row per block: rows are sorted by
key first, so only the first key of a block can have started earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backuplake.session import pin

BLOCK = "_block"
#: Rows of a block, about; work on one block is bounded by it.
BLOCK_ROWS = 1_000_000


def sorted_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows sorted by (keys, order), tagged with a frozen block number.

    The layout is written out because range boundaries are sampled: a second run of the same
    exchange could cut elsewhere, and block numbers must mean the same in every job that uses them.
    The number of blocks follows the number of rows, so a block stays at about `BLOCK_ROWS` at any size.
    """
    if not parts:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, -(-df.count() // BLOCK_ROWS))
    cols = [*keys, *order]
    return pin(
        df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn(BLOCK, F.spark_partition_id())
    )


def carried(blocks: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Sums of each measure over a key's earlier blocks; at most one row per block."""
    per_block = blocks.groupBy(*keys, BLOCK).agg(
        *[F.sum(expr).alias(f"_carry_{name}") for name, expr in measures.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.withColumns(
        {
            "_earlier": F.count(F.lit(1)).over(before),
            **{f"_carry_{name}": F.sum(f"_carry_{name}").over(before) for name in measures},
        }
    ).filter("_earlier > 0").drop("_earlier")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """`df` plus an inclusive running sum per measure, in `order` within `keys`.

    `order` must be unique within the keys. Keys must not be null.
    """
    blocks = sorted_blocks(df, keys, order, parts)
    inside = (
        Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocks.withColumns({name: F.sum(expr).over(inside) for name, expr in measures.items()})
    # Proven bound: one row per block at most.
    carry = F.broadcast(carried(blocks, keys, measures))
    joined = local.join(carry, [*keys, BLOCK], "left")
    return joined.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) for name in measures}
    ).drop(BLOCK, *[f"_carry_{name}" for name in measures])


def indexed_with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, parts: int | None = None
) -> DataFrame:
    """`df` plus 0-based `idx` and `next_value` (the following value of the same key, or null)."""
    blocks = sorted_blocks(df, keys, order, parts)
    by_order = Window.partitionBy(BLOCK, *keys).orderBy(*order)
    local = blocks.withColumns(
        {"_pos": F.row_number().over(by_order).cast("long"), "_next": F.lead(value).over(by_order)}
    )
    per_block = blocks.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by(value, F.struct(*order)).alias("_first")
    )
    chain = Window.partitionBy(*keys).orderBy(BLOCK)
    # A key reaches into at most one block per range boundary: two rows per block at most.
    edges = (
        per_block.withColumns(
            {
                "_before": F.coalesce(
                    F.sum("_rows").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "_follow": F.lead("_first").over(chain),
            }
        )
        .filter("_before > 0 OR _follow IS NOT NULL")
        .select(*keys, BLOCK, "_before", "_follow")
    )
    joined = local.join(F.broadcast(edges), [*keys, BLOCK], "left")
    return joined.withColumns(
        {
            "idx": F.col("_pos") - 1 + F.coalesce("_before", F.lit(0)),
            "next_value": F.coalesce("_next", "_follow"),
        }
    ).drop(BLOCK, "_pos", "_next", "_before", "_follow")
