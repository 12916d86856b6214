"""The trie of conversation prefixes, and what sharing them saves, by the Euler-tour technique.

A node is a distinct sequence of the first d turns. It is found by its depth and the sum, over its turns, of
120 bits of the SHA-256 of (position, role, text): a running sum, so a conversation of any length is cut into
blocks and carried on. A node is named by its smallest member and its depth. Where the smallest member of a
node is c, it is c in every deeper node of c too, so each conversation owns one run of nodes down to its end.

The tour enters and leaves every node, children in the order of their names. The child that goes on with the
parent's own conversation comes first, so after entering a node the tour enters the rest of its owner's run: enter
arcs are ranked by the last one of their run. Those and all exit arcs are ranked as a linked list: one in `RULERS`
arcs, by digest, is a ruler; pointers are doubled until each arc points at a ruler or the end (rounds that follow the logarithm
of the longest gap), then rulers are ranked the same way among themselves, until at most `WALK` are left, and
every arc adds its distance. Each round joins written frames; arcs that have arrived drop out. Sums over a subtree
are differences of prefix sums at a node's two arcs, taken in blocks of `BLOCK_ARCS` positions, sums of whole
blocks carried on.

Turns are ordered by `turn` (null first), then role and text; null role or text is empty. Rows with a null
conv_id belong to no conversation and take no part. Repeated rows are turns of their own. Remainders are those of
SQL (they have the sign of the id). An empty table has no conversations and so no nodes. Role and text are
digested with the role's length before them, so ("a", "b") and ("ab", "") differ. The digest of the ends of a node
needs all their ids in order: blocks of ids are sorted and joined to strings in parallel, and only those strings
stream through one hash. Only `conv_id`, `turn`, `role` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backuplake.operators import ordered
from backuplake.session import pin

#: A conversation takes over fewer than so many turns, from the first of its hundred.
HEADS, HUNDRED = 6, 100
RULERS = 32
#: Rulers that one task walks at the end.
WALK = 1 << 14
#: Positions of the tour in one block.
BLOCK_ARCS = 1 << 17
ROUNDS = 64


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (digest of role and text) and n_chars of every turn; texts end here."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        # Tells equal rows apart, so that they can lie in several blocks; which of them is first makes no difference.
        F.monotonically_increasing_id().alias("_id"),
    ).filter("conv_id IS NOT NULL")
    placed = ordered.running_totals(rows, ["conv_id"], ["turn", "role", "text", "_id"], {"pos": F.lit(1).cast("bigint")})
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    return pin(placed.select("conv_id", "pos", said.alias("said"), F.length("text").cast("bigint").alias("n_chars")), "turns")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and their turns as they are rebuilt: conv_id, depth, said, n_chars."""
    heads = own.filter(F.col("pos") < HEADS)
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("_n"))
    asked = own.groupBy("conv_id").agg(F.lit(1).alias("_one")).select(
        "conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base")
    )
    convs = pin(
        asked.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0)))).select("conv_id", "h", "base", "taken"),
        "convs",
    )
    taken = convs.filter("taken > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").filter(F.col("pos") <= F.col("taken"))
    rest = own.join(convs, "conv_id").filter(F.col("pos") > F.col("h"))
    depth = F.col("taken") + F.col("pos") - F.col("h")
    cols = ["said", "n_chars"]
    return convs.select("conv_id"), taken.select("conv_id", F.col("pos").alias("depth"), *cols).unionByName(rest.select("conv_id", depth.alias("depth"), *cols))


def _bits(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(38,0)")


def members(turns: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo (the node's sums), up_hi, up_lo (its parent's), n_chars of every turn."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "said"), 256)
    rows = turns.select("conv_id", "depth", "n_chars", _bits(digest, 1).alias("a"), _bits(digest, 16).alias("b"))
    sums = ordered.running_totals(rows, ["conv_id"], ["depth"], {"hi": F.col("a"), "lo": F.col("b")})
    big = lambda c: c.cast("decimal(38,0)")
    return pin(
        sums.select(
            "conv_id", "depth", "n_chars", big(F.col("hi")).alias("hi"), big(F.col("lo")).alias("lo"),
            big(F.col("hi") - F.col("a")).alias("up_hi"), big(F.col("lo") - F.col("b")).alias("up_lo"),
        ),
        "members",
    )


def nodes(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_chars), and where conversations end (member, conv_id, depth)."""
    zero = F.lit(0).cast("decimal(38,0)")
    found = rows.groupBy("depth", "hi", "lo").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        # The same for all members.
        F.max("n_chars").alias("n_chars"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"),
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), zero.alias("hi"), zero.alias("lo"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_chars"),
        F.lit(None).cast("decimal(38,0)").alias("up_hi"), F.lit(None).cast("decimal(38,0)").alias("up_lo"),
    )
    named = pin(found.unionByName(top), "nodes")
    up = named.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    tree = pin(named.join(up, ["depth", "up_hi", "up_lo"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_chars"), "tree")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "hi", "lo"), "depth").alias("_end"))
    start = F.struct(F.lit(0).cast("bigint").alias("depth"), zero.alias("hi"), zero.alias("lo"))
    last = convs.join(last, "conv_id", "left").select(F.col("conv_id").alias("member"), F.coalesce("_end", start).alias("_end")).select("member", "_end.*")
    ends = pin(last, "lasts").join(named.select("depth", "hi", "lo", "conv_id"), ["depth", "hi", "lo"]).select("member", "conv_id", "depth")
    return tree, pin(ends, "ends")


def _is_ruler(conv: str, depth: str, level: int) -> Column:
    """One arc in `RULERS`, another choice at each level; the last arc always."""
    return (F.col(depth) == 0) | (F.pmod(F.xxhash64(F.col(conv), F.col(depth), F.lit(level)), F.lit(RULERS)) == 0)


def _walk(links: DataFrame) -> DataFrame:
    """Distances to the end of a list of at most `WALK` arcs, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        c, d, nc, nd, dist = (table.column(i).to_pylist() for i in range(5))
        before = {(x, y): i for i, (x, y) in enumerate(zip(nc, nd))}
        starts, far = set(zip(c, d)), {}
        at, total = next((k for k in before if k[1] == 0 and k not in starts), None), 0
        while at in before:
            i = before[at]
            total += dist[i]
            at = (c[i], d[i])
            far[at] = total
        if len(far) != len(c):
            raise ValueError("arcs do not form one list")
        columns = [[k[0] for k in far], [k[1] for k in far], list(far.values())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c", "d", "far"])

    names = ["c", "d", "nc", "nd", "dist"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    return links.select(*names).coalesce(1).mapInArrow(run, "c long, d long, far long")


def distances(links: DataFrame, level: int = 0) -> DataFrame:
    """How far each arc (c, d) is from the end; `links` (c, d, nc, nd, dist) lead from arc to arc."""
    state = pin(links.select("c", "d", "nc", "nd", "dist"), "links")
    arrived, open_ = state.filter(_is_ruler("nc", "nd", level)), state.filter(~_is_ruler("nc", "nd", level))
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        here = state.filter(~_is_ruler("c", "d", level)).select(
            F.col("c").alias("nc"), F.col("d").alias("nd"), F.col("nc").alias("_c"), F.col("nd").alias("_d"), F.col("dist").alias("_far")
        )
        moved = open_.join(here, ["nc", "nd"]).select(
            "c", "d", F.col("_c").alias("nc"), F.col("_d").alias("nd"), (F.col("dist") + F.col("_far")).alias("dist")
        )
        moved = pin(moved, "links")
        arrived = arrived.unionByName(moved.filter(_is_ruler("nc", "nd", level)))
        open_ = moved.filter(~_is_ruler("nc", "nd", level))
        state = arrived.unionByName(open_)
    else:
        raise RuntimeError(f"arcs not at their rulers after {ROUNDS} rounds")
    rulers = pin(arrived.filter(_is_ruler("c", "d", level)), "rulers")
    far = _walk(rulers) if rulers.count() <= WALK else distances(rulers, level + 1)
    to = pin(far, "ruler-ranks").select(F.col("c").alias("nc"), F.col("d").alias("nd"), "far")
    # The end itself is no link's start: arcs that point at it are `dist` away.
    return arrived.join(to, ["nc", "nd"], "left").select("c", "d", (F.col("dist") + F.coalesce("far", F.lit(0))).alias("far"))


def tour(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """Positions of both arcs of each node: conv_id, depth, enter, leave."""
    last = ends.select(F.col("member").alias("conv_id"), F.col("depth").alias("last"))
    # The last node of each conversation's own run; conversations without a run of their own drop out.
    last = pin(last.join(tree.groupBy("conv_id").agg(F.lit(1).alias("_owns")), "conv_id").select("conv_id", "last"), "last")
    below = tree.filter("depth > 0").select(F.col("parent_conv_id").alias("parent"), "depth", "conv_id")
    run = last.select(F.col("conv_id").alias("sibling"), "last")
    # Entering the last node of a run is an arc of the list too, at depth -1.
    down = F.lit(-1).cast("bigint")
    chained = ordered.indexed_with_next(below, ["parent", "depth"], ["conv_id"], "conv_id")
    joined = chained.withColumnRenamed("next_value", "sibling").join(run, "sibling", "left")
    leaving = joined.select(
        F.col("conv_id").alias("c"),
        F.col("depth").alias("d"),
        F.coalesce("sibling", "parent").alias("nc"),
        F.when(F.col("sibling").isNull(), F.col("depth") - 1).otherwise(down).alias("nd"),
        F.when(F.col("sibling").isNull(), F.lit(1)).otherwise(F.col("last") - F.col("depth") + 1).cast("bigint").alias("dist"),
    )
    firsts = below.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("last")).agg(F.min("conv_id").alias("sibling"))
    deeper = last.join(firsts, ["conv_id", "last"], "left").join(run.withColumnRenamed("last", "_to"), "sibling", "left")
    entering = deeper.select(
        F.col("conv_id").alias("c"),
        down.alias("d"),
        F.coalesce("sibling", "conv_id").alias("nc"),
        F.when(F.col("sibling").isNull(), F.col("last")).otherwise(down).alias("nd"),
        F.when(F.col("sibling").isNull(), F.lit(1)).otherwise(F.col("_to") - F.col("last")).cast("bigint").alias("dist"),
    )
    root = tree.filter("depth = 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(0).cast("bigint").alias("far"))
    size = tree.count()
    ranked = pin(distances(leaving.unionByName(entering)).unionByName(root), "ranked")
    at = ranked.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), (F.lit(2 * size - 1) - F.col("far")).alias("leave"))
    # Written: the long run of one conversation can then be split where it meets its one row here.
    bottom = pin(at.filter("depth < 0").withColumnRenamed("leave", "_bottom").drop("depth").join(last, "conv_id"), "bottoms")
    placed = at.filter("depth >= 0").join(bottom, "conv_id")
    return placed.select("conv_id", "depth", (F.col("_bottom") - F.col("last") + F.col("depth")).alias("enter"), "leave")


def subtree_sums(placed: DataFrame, measures: list[str]) -> DataFrame:
    """Each measure summed over the subtree of every node: `placed` has conv_id, depth, enter, leave and measures."""
    kinds = [("enter", F.col), ("leave", lambda _m: F.lit(0).cast("bigint"))]
    arcs = F.array(*[F.struct(F.col(at).alias("pos"), F.lit(at).alias("kind"), *[value(m).alias(m) for m in measures]) for at, value in kinds])
    rows = placed.select("conv_id", "depth", F.inline(arcs)).withColumn("_block", F.floor(F.col("pos") / BLOCK_ARCS))
    blocks = pin(rows, "arcs")
    inside = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per block of the tour.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy("_block").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    carried = carried.select("_block", *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}") for m in measures])
    local = blocks.select("conv_id", "depth", "kind", "_block", *[F.sum(m).over(inside).alias(m) for m in measures], *[F.col(m).alias(f"_own_{m}") for m in measures])
    sums = local.join(carried, "_block").select("conv_id", "depth", "kind", *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in measures], *[f"_own_{m}" for m in measures])
    signed = lambda m: F.sum(F.when(F.col("kind") == "leave", F.col(m)).otherwise(F.col(f"_own_{m}") - F.col(m)))
    return sums.groupBy("conv_id", "depth").agg(*[signed(m).alias(m) for m in measures])


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of nodes that conversations end at."""
    keys = ["conv_id", "depth"]
    blocks = ordered.sorted_blocks(ends.select(*keys, "member"), keys, ["member"])
    ids = F.array_sort(F.collect_list("member")).cast("array<string>")
    # A block has at most `ordered.BLOCK_ROWS` rows, about.
    strings = blocks.groupBy(*keys, ordered.BLOCK).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if (conv, depth) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (conv, depth), hashlib.sha256(text.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, digest.hexdigest())])

    def _rows(done: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*keys, "ends_sha256"])

    sorted_ = strings.repartition(*keys).sortWithinPartitions(*keys, ordered.BLOCK).select(*keys, "ids")
    return sorted_.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, rows = rebuilt(turns(conversations))
    tree, ends = nodes(convs, members(rows))
    keys = ["conv_id", "depth"]
    children = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = pin(tree.join(children, keys, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    own = full.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    measures = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(own.join(tour(full, ends), keys), measures)
    out = full.join(sums, keys).join(end_digests(ends), keys, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*keys, "parent_conv_id", "n_convs", "n_children", *measures, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     i AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
     h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
             list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))) % 6 AS h FROM i),
     r AS (SELECT h.conv_id, list_concat(coalesce(i.own[1 : h.h], []), h.own[h.h + 1 :]) AS whole FROM h LEFT JOIN i ON i.conv_id = h.base),
     m AS (SELECT conv_id, d, whole[1 : d] AS prefix, whole[1 : d - 1] AS up, len(whole) = d AS ends
           FROM (SELECT conv_id, whole, unnest(range(len(whole) + 1)) AS d FROM r)),
     n AS (SELECT d, prefix, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                  CASE WHEN d > 0 THEN (count(*) - 1) * length(any_value(prefix)[d].text) ELSE 0 END AS saved,
                  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
           FROM m GROUP BY d, prefix),
     p AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.prefix = n.up AND n.d > 0),
     k AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL),
     a AS (SELECT n.conv_id AS of_conv, n.d AS of_d, n.saved, k.n_children IS NULL AS leaf, unnest(range(n.d + 1)) AS d, n.prefix
           FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.d = n.d),
     s AS (SELECT d, prefix[1 : d] AS prefix, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY ALL)
SELECT p.conv_id, p.d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM p JOIN s ON s.d = p.d AND s.prefix = p.prefix LEFT JOIN k ON k.conv_id = p.conv_id AND k.d = p.d
"""
