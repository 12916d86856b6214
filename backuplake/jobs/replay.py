"""Job state from its command log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.operators.ordered import BLOCK, sorted_blocks

# Job states, and for each command the state it leads to from the state named.
# A command that does not apply leaves the state as it is.
STATES = ["QUEUED", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"]
MOVES = {
    "start": {"QUEUED": "RUNNING"},
    "pause": {"RUNNING": "PAUSED"},
    "resume": {"PAUSED": "RUNNING"},
    "complete": {"RUNNING": "COMPLETED"},
    "fail": {"RUNNING": "FAILED"},
    "cancel": {s: "CANCELLED" for s in STATES},
}


def _map_of(command: Column) -> Column:
    """State numbers after a command, by state number before it."""
    same = list(range(len(STATES)))
    out = None
    for name, moves in MOVES.items():
        after = F.array(*[F.lit(STATES.index(moves.get(s, s))) for s in STATES])
        out = F.when(command == name, after) if out is None else out.when(command == name, after)
    return out.otherwise(F.array(*[F.lit(i) for i in same]))


def _then(first: Column, second: Column) -> Column:
    """One map after another."""
    return F.transform(first, lambda s: F.get(second, s))


def _compose(steps: Column) -> Column:
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(steps, identity, _then)


def replay(commands: DataFrame, key: str, order: Sequence[str], initial: str = "QUEUED", parts: int | None = None) -> DataFrame:
    """Final state per job.

    A run of commands is a map from states to states, and such maps compose: ordered blocks are
    folded in parallel and a job's block maps are joined in order afterwards. A job with a long
    log is spread over many blocks.
    """
    blocks = sorted_blocks(commands, [key], order, parts)
    step = F.struct(*order, _map_of(F.col("command")).alias("_map"))
    # Proven bound: a group is part of one block.
    folded = blocks.groupBy(key, BLOCK).agg(
        _compose(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["_map"])).alias("_map"),
        F.count(F.lit(1)).alias("_n"),
    )
    # Proven bound: one entry per block.
    joined = folded.groupBy(key).agg(
        _compose(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "_map"))), lambda s: s["_map"])).alias("_map"),
        F.sum("_n").alias("commands"),
    )
    names = F.array(*[F.lit(s) for s in STATES])
    return joined.select(key, F.get(names, F.get("_map", F.lit(STATES.index(initial)))).alias("status"), "commands")
