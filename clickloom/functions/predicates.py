"""Row filters: relative windows and optional equality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.times import as_of_column, is_zoneless, live_start, require_utc, window_start


def in_window(
    events: DataFrame,
    window: str,
    as_of: Column | datetime | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Rows no older than ``window`` before ``as_of``.

    The window has no upper end, so rows stamped later than ``as_of`` count;
    ``bounded=True`` leaves them out.
    """
    require_utc(events.sparkSession)
    zoneless = is_zoneless(events)
    kept = events.where(F.col("timestamp") >= window_start(window, as_of, zoneless))
    if bounded:
        kept = kept.where(F.col("timestamp") <= as_of_column(as_of, zoneless))
    return kept


def in_live_window(
    events: DataFrame, as_of: Column | datetime | None = None, bounded: bool = False
) -> DataFrame:
    """Rows of the last minutes before ``as_of``; any stamped later too, unless ``bounded``."""
    require_utc(events.sparkSession)
    zoneless = is_zoneless(events)
    kept = events.where(F.col("timestamp") >= live_start(as_of, zoneless))
    if bounded:
        kept = kept.where(F.col("timestamp") <= as_of_column(as_of, zoneless))
    return kept


def equal_to(events: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-sensitive equality per column; ``None`` and ``""`` mean no filter."""
    for column, value in wanted.items():
        if value:
            events = events.where(F.col(column) == F.lit(value))
    return events
