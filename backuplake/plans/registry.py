"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WIDER = {T.IntegerType: "bigint", T.ShortType: "bigint", T.FloatType: "double", T.TimestampType: "timestamp_ntz"}


def settle(df: DataFrame) -> DataFrame:
    """Widest integer and float types, and timestamps without zone, for comparison."""
    return df.select(
        *[
            F.col(f.name).cast(_WIDER[type(f.dataType)]).alias(f.name) if type(f.dataType) in _WIDER else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query; `views` names the views its SQL needs."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Timestamps are UTC throughout, whatever session the caller brings.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return settle(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add


def with_views(sql: str, names: str) -> str:
    from backuplake.plans.views import VIEWS

    if not names:
        return sql
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {text},\n{body[15:]}"
    return f"WITH {text},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {text}\n{body}"
