"""Event-time arithmetic. All wall-clock values are UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.vocabulary import BUCKETS, LIVE_MINUTES, WINDOWS, one_of

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone the package's wall-clock arithmetic relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session time zone must be UTC, not {zone}; see use_utc")


def utc_wall_clock(events: DataFrame) -> DataFrame:
    """The same events with ``timestamp`` as TIMESTAMP_NTZ in UTC."""
    require_utc(events.sparkSession)
    if is_zoneless(events):
        return events
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def is_zoneless(events: DataFrame) -> bool:
    return isinstance(events.schema["timestamp"].dataType, T.TimestampNTZType)


def as_of_column(as_of: Column | datetime | None, zoneless: bool = False) -> Column:
    """The moment a relative window is counted back from; ``None`` is now.

    A datetime without a zone is taken as UTC. The result is foldable unless a
    non-foldable Column was given, so comparisons with it reach the scan.
    """
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.localtimestamp() if zoneless else F.current_timestamp()
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    text = as_of.isoformat(sep=" ")
    return F.expr(f"TIMESTAMP_NTZ '{text}'" if zoneless else f"TIMESTAMP '{text}+00:00'")


def window_start(window: str, as_of: Column | datetime | None = None, zoneless: bool = False) -> Column:
    hours = WINDOWS[one_of("window", window, WINDOWS)]
    return as_of_column(as_of, zoneless) - F.expr(f"INTERVAL '{hours}' HOUR")


def live_start(as_of: Column | datetime | None = None, zoneless: bool = False) -> Column:
    return as_of_column(as_of, zoneless) - F.expr(f"INTERVAL '{LIVE_MINUTES}' MINUTE")


def bucket_start(bucket: str, events: DataFrame) -> Column:
    """Start of the minute, hour or day of ``timestamp``, in the column's own type."""
    one_of("bucket", bucket, BUCKETS)
    return F.date_trunc(bucket, "timestamp").cast(events.schema["timestamp"].dataType)


def month_key(timestamp: Column) -> Column:
    """Year and month as one number, e.g. 202401."""
    return F.year(timestamp) * 100 + F.month(timestamp)


def iso_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
