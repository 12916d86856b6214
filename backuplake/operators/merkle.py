"""Differences of two trees of files by digests of their folders.

`digested` rolls checksums up, folder by folder from the deepest level: a folder's digest is a sum of 120-bit hashes of
(name, digest) of what lies in it, so each task adds up its own rows first and a full folder is never gathered. The
digests of a state are written out once and serve every later comparison with it. `compare` walks down from the
roots: only children of folders that differ are joined, level by level, and in the end only the files of such folders.
Equal subtrees are never joined; their files are passed on as unchanged, or not at all.

Paths start with a slash; keys (of a device) and paths are never null, and a state has one row per key and path. A null
checksum is a value of its own. Two different folders pass for equal with a probability of one in 2**120.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.session import pin


def _bits(name: Column, value: Column) -> list[Column]:
    """Two 60-bit halves of a hash, as decimals that can be added up."""
    digest = F.sha2(F.concat_ws("/", name, value), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)").alias(c) for at, c in ((1, "_a"), (16, "_b"))]


def _parent(path: Column) -> Column:
    """The folder of a path; that of the top level is empty."""
    return F.regexp_replace(path, "/[^/]*$", "")


@dataclass
class Digested:
    """`files`: keys, path, folder, checksum. `folders`: one frame per level from the roots: keys, path, folder, a, b."""

    keys: list[str]
    files: DataFrame
    folders: list[DataFrame]


@dataclass
class Comparison:
    """`changes`: keys, path, old_checksum, new_checksum, change; `joined`: rows that each level's join read."""

    changes: DataFrame
    joined: list[int] = field(default_factory=list)


def digested(state: DataFrame, keys: Sequence[str]) -> Digested:
    """`state`: the keys, path, checksum."""
    keys = list(keys)
    files = pin(state.select(*keys, "path", _parent(F.col("path")).alias("folder"), "checksum"), "files")
    depth = F.size(F.split("folder", "/")) - 1
    deepest = files.agg(F.coalesce(F.max(depth), F.lit(-1))).first()[0]
    said = F.coalesce(F.concat(F.lit("="), F.col("checksum").cast("string")), F.lit("-"))
    levels: list[DataFrame] = []
    for level in range(deepest, -1, -1):
        rows = files.filter(depth == level).select(*keys, F.col("folder").alias("path"), *_bits(F.col("path"), F.concat(F.lit("f"), said)))
        if levels:
            below = F.concat_ws(":", F.lit("d"), F.col("a").cast("string"), F.col("b").cast("string"))
            rows = rows.unionByName(levels[-1].select(*keys, F.col("folder").alias("path"), *_bits(F.col("path"), below)))
        sums = rows.groupBy(*keys, "path").agg(F.sum("_a").cast("decimal(38,0)").alias("a"), F.sum("_b").cast("decimal(38,0)").alias("b"))
        folder = F.when(F.col("path") == "", F.lit(None)).otherwise(_parent(F.col("path")))
        levels.append(pin(sums.select(*keys, "path", folder.alias("folder"), "a", "b"), "folders"))
    return Digested(keys, files, levels[::-1])


def _level(state: Digested, i: int) -> DataFrame:
    if i < len(state.folders):
        return state.folders[i]
    return state.files.select(*state.keys, "path", "folder", *[F.lit(None).cast("decimal(38,0)").alias(c) for c in "ab"]).limit(0)


def compare(old: Digested, new: Digested, unchanged: bool = True) -> Comparison:
    """new / modified / deleted / unchanged per file; without `unchanged`, changes only."""
    keys, at = old.keys, [*old.keys, "path"]
    inside = [*keys, "folder"]
    joined, differing, open_ = [], None, None
    for i in range(max(len(old.folders), len(new.folders))):
        sides = [_level(s, i) for s in (old, new)]
        if open_ is not None:
            # Folders that differ are unique, and written: a full folder is a hot key that can be split.
            sides = [s.join(open_, inside, "left_semi") for s in sides]
        a, b = (pin(s.select(*at, F.col("a").alias(f"_a{n}"), F.col("b").alias(f"_b{n}")), "level") for n, s in enumerate(sides))
        joined.append(a.count() + b.count())
        same = F.col("_a0").eqNullSafe(F.col("_a1")) & F.col("_b0").eqNullSafe(F.col("_b1"))
        found = a.join(b, at, "full_outer").filter(~same)
        open_ = pin(found.select(*keys, F.col("path").alias("folder")), "differing")
        differing = open_ if differing is None else differing.unionByName(open_)
    if differing is None:
        empty = old.files.select(*at, *[F.lit(None).cast("string").alias(c) for c in ("old_checksum", "new_checksum", "change")])
        return Comparison(empty, joined)
    differing = pin(differing, "differing")
    sides = [
        pin(s.files.join(differing, inside, "left_semi").select(*at, F.col("checksum").alias(f"{n}_checksum"), F.lit(True).alias(f"_{n}")), "open-files")
        for n, s in (("old", old), ("new", new))
    ]
    joined.append(sum(s.count() for s in sides))
    change = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted")
        .when(F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "unchanged").otherwise("modified")
    )
    out = sides[0].join(sides[1], at, "full_outer").select(*at, "old_checksum", "new_checksum", change.alias("change"))
    if not unchanged:
        return Comparison(out.filter("change <> 'unchanged'"), joined)
    rest = old.files.join(differing, inside, "left_anti")
    rest = rest.select(*at, F.col("checksum").alias("old_checksum"), F.col("checksum").alias("new_checksum"), F.lit("unchanged").alias("change"))
    return Comparison(out.unionByName(rest), joined)
