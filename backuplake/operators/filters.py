"""Predicates. All are plain column tests, so they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions import text

# Default exclude globs and size cap of a backup selection.
EXCLUDE_GLOBS = ["*.tmp", "*.log", ".cache/*", "node_modules/*"]
MAX_FILE_BYTES = 100 * 1024 * 1024


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def live_of(df: DataFrame, owner: str, value) -> DataFrame:
    """Rows of one owner that are not deleted."""
    return df.filter((F.col(owner) == F.lit(value)) & ~F.col("is_deleted"))


def with_status(df: DataFrame, statuses: Sequence[str], device: tuple[str, object] | None = None) -> DataFrame:
    """Status in a caller-given set, for one device if asked; "active" has no single meaning."""
    out = df.filter(F.col("status").isin(list(statuses)))
    return by_key(out, *device) if device else out


def in_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(ts).between(start, end))


def since(df: DataFrame, ts: str, bound, strict: bool = False) -> DataFrame:
    return df.filter(F.col(ts) > bound) if strict else df.filter(F.col(ts) >= bound)


def path_like(df: DataFrame, pattern: str, owner: str, value) -> DataFrame:
    return df.filter((F.col(owner) == F.lit(value)) & F.col("path").like(pattern))


def search_files(df: DataFrame, query: str, extensions: Iterable[str] = (), name_only: bool = False) -> DataFrame:
    """Case-blind text in name or path, and any of the extensions (none given: all)."""
    needle = query.lower()
    hit = F.lower("name").contains(needle)
    if not name_only:
        hit = hit | F.lower("path").contains(needle)
    tests = [F.lower("name").endswith(e.lower()) for e in extensions]
    return df.filter(hit & reduce(Column.__or__, tests) if tests else hit)


def of_class(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows whose `path` falls in one of the file classes."""
    return df.filter(text.file_class(F.col("path")).isin(list(classes)))


def backup_candidates(
    df: DataFrame,
    exclude: Sequence[str] = EXCLUDE_GLOBS,
    include_hidden: bool = False,
    follow_links: bool = False,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Files a backup takes: not excluded, not hidden, not a link, not too big."""
    keep = F.col("size") <= max_bytes
    if exclude:
        keep = keep & ~F.col("path").rlike("|".join(text.glob_pattern(g) for g in exclude))
    if not include_hidden:
        keep = keep & ~F.col("path").rlike(r"(^|/)\.[^/]")
    if not follow_links and "is_link" in df.columns:
        keep = keep & ~F.col("is_link")
    return df.filter(keep)


def dirty_blocks(blocks: DataFrame, after) -> DataFrame:
    return blocks.filter((F.col("last_modified") > after) & F.col("is_dirty"))


def flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag))


def above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Strictly above the threshold."""
    return df.filter(F.col(score) > threshold)


def optimal_hours(df: DataFrame, scores: str, threshold: float = 0.7) -> DataFrame:
    """Array positions, read as hours, whose score is above the threshold."""
    keep = [c for c in df.columns if c != scores]
    return above(df.select(*keep, F.posexplode(scores).alias("hour", "score")), "score", threshold)


def children(df: DataFrame, directory: str) -> DataFrame:
    """Direct children of a directory."""
    return df.filter(text.parent_path(F.col("path")) == directory)
