"""Per-tenant distance models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant_model(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every metric per tenant."""
    return df.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    )


def distance(metrics: Sequence[str]) -> Column:
    """Root mean square of the z-scores; a constant metric adds nothing."""
    total = None
    for m in metrics:
        z = F.coalesce(F.try_divide(F.col(m) - F.col(f"{m}_mean"), F.col(f"{m}_std")), F.lit(0.0))
        total = z * z if total is None else total + z * z
    return F.sqrt(total / len(metrics))
