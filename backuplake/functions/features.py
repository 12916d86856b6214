"""Feature, scoring and digest expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_features(ts: Column) -> dict[str, Column]:
    """Calendar features; weekday counts from Monday = 0."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
    }


def cyclical_features(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour of day and day of week."""
    hour = F.hour(ts) * (2 * math.pi) / 24
    day = F.weekday(ts) * (2 * math.pi) / 7
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}


def schedule_score(priority: Column, size: Column) -> Column:
    """Priority x 10 less up to ten points for size; missing values count as 1 and 1,000,000."""
    weight = F.coalesce(priority, F.lit(1)) * 10
    return weight - F.least(F.lit(10.0), F.coalesce(size, F.lit(1_000_000)) / 1_000_000.0)


def success_rate(raw_duration: Column) -> Column:
    """Falls by a tenth per hour of raw duration, held within 0.7 and 0.99."""
    return F.greatest(F.lit(0.7), F.least(F.lit(0.99), 1.0 - raw_duration / 3600.0 * 0.1))


def floor_duration(raw_duration: Column) -> Column:
    return F.greatest(F.lit(30.0), raw_duration)


def resource_needs(file_count: Column, size: Column) -> dict[str, Column]:
    return {
        "cpu": F.least(F.lit(80.0), file_count * 0.01),
        "memory": F.least(F.lit(90.0), size / 1_000_000.0),
        "network": F.least(F.lit(100.0), size / 100_000.0),
    }


def _messages(rules: list[tuple[Column, str]]) -> Column:
    """Messages of the rules that hold, in rule order."""
    found = F.array(*[F.when(test, F.lit(text)) for test, text in rules])
    return F.filter(found, lambda m: m.isNotNull())


def backup_advice(duration: Column, success: Column, size: Column) -> Column:
    # Thresholds and message texts.
    return _messages(
        [
            (duration > 1800, "Consider running backup during off-peak hours"),
            (success < 0.9, "Check network stability before starting backup"),
            (size > 10_000_000, "Enable compression to reduce transfer time"),
        ]
    )


def anomaly_advice(affected: Column) -> Column:
    # Message texts per affected metric.
    return _messages(
        [
            (
                F.array_contains(affected, "cpu_usage"),
                "High CPU usage detected - consider reducing concurrent backups",
            ),
            (F.array_contains(affected, "memory_usage"), "Memory usage anomaly - check for memory leaks"),
            (
                F.array_contains(affected, "backup_speed"),
                "Backup speed anomaly - check network or storage performance",
            ),
        ]
    )


def with_defaults(features: Column, defaults: Mapping[str, float]) -> dict[str, Column]:
    """One column per feature of a map column, falling back to the feature's default."""
    return {name: F.coalesce(features[name], F.lit(value)) for name, value in defaults.items()}


def java_hash(text: Column) -> Column:
    """Signed 32-bit `31*h + c` string hash over UTF-16 units, as a long."""
    ascii_codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    # Beyond ASCII a character is one unit of two bytes, or two of them.
    wide = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.length(wide) - 3, F.lit(1)), F.lit(4)), lambda i: F.conv(F.substring(wide, i, F.lit(4)), 16, 10).cast("long"))
    codes = F.when(F.octet_length(text) == F.length(text), ascii_codes).otherwise(units)
    unsigned = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(1 << 32))
    return F.when(unsigned >= (1 << 31), unsigned - (1 << 32)).otherwise(unsigned)


def digest(data: Column) -> Column:
    """Hex SHA-256 of a binary or string column."""
    return F.sha2(data, 256)


def saved_ratio(original: Column, compressed: Column) -> Column:
    """Share of bytes saved; zero for empty input."""
    return F.when(original == 0, F.lit(0.0)).otherwise((original - compressed) / original.cast("double"))


def logistic(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-distance))


def normality_score(decision: Column) -> Column:
    """Maps a decision value to 0..1; it rises with normality, hence the name."""
    return F.greatest(F.lit(0.0), (decision + 1) / 2)
