"""Observed-remove sets: replicas add and remove on their own, and a removal takes only what it has seen.

Every operation of a replica has a dot: the replica (`actor`) and its running number (`counter`). A version vector
says how far somebody has seen each actor: (actor, counter). A replica's state is its entries (element, actor,
counter), one per addition that still stands, and its vector. An element is in the set while an entry of it is.

States merge in one step, however many: an entry stays if every state that has seen its dot still holds it, since a
state that has seen an addition and no longer holds it has removed it. So an addition that a removal did not know of
survives it, and order, grouping and repetition of the states make no difference. Entries are counted per dot before
they meet vectors, which have one row per actor: no element and no actor is gathered in one task.

A state's vector covers its entries. Rows without an actor or a counter are no operations and are left out; a null element is an element.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.operators import ordered
from backuplake.session import pin

DOT = ["actor", "counter"]


@dataclass
class State:
    """`entries`: element, actor, counter. `vector`: actor, counter, one row per actor."""

    entries: DataFrame
    vector: DataFrame


def numbered(operations: DataFrame, order: Sequence[str], actor: str = "actor") -> DataFrame:
    """`operations` plus `counter`, from 1 per actor in `order`; a busy actor is cut into blocks."""
    known = operations.filter(F.col(actor).isNotNull())
    return ordered.running_totals(known, [actor], order, {"counter": F.lit(1).cast("bigint")})


def _bounds(removals: DataFrame) -> DataFrame:
    """element, actor, bound: removals of the element have seen the actor so far. The vectors of a hot element
    shrink to one row per actor in each task before they are shuffled."""
    seen = removals.select("element", F.explode("seen").alias("actor", "upto"))
    return seen.groupBy("element", "actor").agg(F.max("upto").alias("bound"))


def apply(operations: DataFrame, vector: DataFrame | None = None) -> State:
    """The state after all operations, or after those that `vector` has seen.

    `operations`: actor, counter, element, is_removal, seen (map from actors to how far the removal had seen them).
    """
    known = operations.filter(F.col("actor").isNotNull() & F.col("counter").isNotNull())
    if vector is not None:
        upto = vector.select("actor", F.col("counter").alias("_upto"))
        known = known.join(upto, "actor").filter(F.col("counter") <= F.col("_upto")).drop("_upto")
    removed = pin(_bounds(known.filter("is_removal")), "removed").withColumnRenamed("element", "_e").withColumnRenamed("actor", "_a")
    added = known.filter("NOT is_removal").select("element", *DOT)
    same = F.col("element").eqNullSafe(F.col("_e")) & (F.col("actor") == F.col("_a"))
    entries = added.join(removed, same, "left").filter(F.col("bound").isNull() | (F.col("counter") > F.col("bound")))
    seen = known.groupBy("actor").agg(F.max("counter").alias("counter")) if vector is None else vector
    return State(entries.select("element", *DOT), seen.select(*DOT))


def merge(states: Sequence[State]) -> State:
    """One state that has seen what any of them has."""
    tagged = [s.entries.select("element", *DOT).distinct().withColumn("_state", F.lit(i)) for i, s in enumerate(states)]
    held = reduce(DataFrame.unionByName, tagged).groupBy("element", *DOT).agg(F.count(F.lit(1)).alias("_holders"))
    vectors = reduce(DataFrame.unionByName, [s.vector.select(*DOT).withColumn("_state", F.lit(i)) for i, s in enumerate(states)])
    # At most one number per state.
    per_actor = pin(vectors.groupBy("actor").agg(F.collect_list("counter").alias("_seen")), "vectors")
    covering = F.size(F.filter("_seen", lambda n: n >= F.col("counter")))
    entries = held.join(per_actor, "actor", "left").filter(F.col("_holders") >= F.coalesce(covering, F.lit(0)))
    return State(entries.select("element", *DOT), per_actor.select("actor", F.array_max("_seen").alias("counter")))


def elements(state: State) -> DataFrame:
    """element and how many additions of it stand."""
    return state.entries.groupBy("element").agg(F.count(F.lit(1)).alias("additions"))
