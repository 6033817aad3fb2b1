"""Pages of the log by cursor: a page costs the same however far into the log it lies.

Every row comes with a cursor, an opaque text that holds its place in the
log's whole order and which of several equal rows it is. The next page begins
behind the last row's cursor, the previous one ends before the first row's. A
page's rows are found by comparing places, and only in so long a stretch of
time as holds enough rows; so row groups of other times are skipped, and no
rows are counted that lie in front of the page.
"""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.predicates import equal_to, in_window
from clickloom.functions.times import as_of_column, iso_text, is_zoneless
from clickloom.operators.log import WITHIN_SECOND
from clickloom.vocabulary import EVENT_COLUMNS, LOG_LIMIT, in_range

_TYPES = {"price": "DOUBLE"}
PLACE_DDL = "age BIGINT, " + ", ".join(f"{c} {_TYPES.get(c, 'STRING')}" for c in WITHIN_SECOND)
_EPOCH = datetime(1970, 1, 1)
# The first stretch looked at, and how much longer each further one is.
_STRETCH, _GROWTH = timedelta(hours=1), 8
_STRETCHES = 5


def cursor_at(moment: datetime) -> str:
    """The cursor in front of all events of a second: the page behind it begins with the newest event up to ``moment``."""
    return _spelled({"age": -((moment - _EPOCH) // timedelta(microseconds=1)), "copy": 0})


def _spelled(place: dict) -> str:
    return base64.b64encode(json.dumps(place).encode()).decode()


def read_cursor(cursor: str) -> tuple[str, datetime, int]:
    """(the place as JSON, its time, the number among equal rows)."""
    try:
        place = base64.b64decode(cursor, validate=True).decode()
        fields = json.loads(place)
        moment = _EPOCH - timedelta(microseconds=fields["age"])
        return place, moment, int(fields["copy"])
    except (binascii.Error, UnicodeDecodeError, ValueError, KeyError, TypeError, OverflowError) as wrong:
        raise ValueError("this is no cursor of a log page") from wrong


def _place() -> Column:
    # Newer is less, as the log is newest first.
    return F.struct((-F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("age"), *WITHIN_SECOND)


def _cursor() -> Column:
    fields = [F.col(f"place.{name}").alias(name) for name in ("age", *WITHIN_SECOND)]
    # Without the line breaks that long texts get.
    return F.regexp_replace(F.base64(F.encode(F.to_json(F.struct(*fields, "copy")), "UTF-8")), r"\s", "")


def _near(rows: DataFrame, moment: datetime, limit: int, backwards: bool) -> DataFrame:
    """The rows of a stretch of time from a moment on that holds a page, if a short one does."""
    zoneless = is_zoneless(rows)
    time, stretch = F.col("timestamp"), _STRETCH
    for _ in range(_STRETCHES):
        end = moment + stretch if backwards else moment - stretch
        near = rows.where(time <= as_of_column(end, zoneless) if backwards else time >= as_of_column(end, zoneless))
        # Rows of the moment itself may all lie on the other side of the cursor.
        beyond = near.where(time != as_of_column(moment, zoneless))
        if beyond.limit(limit).count() == limit:
            return near
        stretch = stretch * _GROWTH
    return rows


def page_after(
    events: DataFrame, cursor: str | None = None, limit: int = 50, backwards: bool = False,
    event_type: str | None = None, category: str | None = None, user_id: str | None = None,
    window: str = "24h", as_of: Column | datetime | None = None, bounded: bool = False,
) -> DataFrame:
    """The page behind a cursor, or the one before it, as the columns of the log and ``cursor``; newest first.

    Without a cursor it is the first page, or backwards the last. Filters are
    those of ``list_events``, and the pages of one walk must have the same. Rows
    that come in meanwhile never make a page repeat or skip others.
    """
    in_range("limit", limit, *LOG_LIMIT)
    kept = equal_to(
        in_window(events, window, as_of, bounded), event_type=event_type, category=category, user_id=user_id
    ).select(*EVENT_COLUMNS)
    rows, found = kept, []
    if cursor is not None:
        text, moment, copy = read_cursor(cursor)
        at = as_of_column(moment, is_zoneless(rows))
        rows = rows.where(F.col("timestamp") >= at if backwards else F.col("timestamp") <= at)
        rows = _near(rows, moment, limit, backwards).withColumn("place", _place())
        known = F.from_json(F.lit(text), PLACE_DDL)
        same = rows.where((F.col("timestamp") == at) & F.col("place").eqNullSafe(known))
        found.append(_copies(same, copy, limit, backwards))
        rows = rows.where(F.col("place") < known if backwards else F.col("place") > known)
    else:
        rows = rows.withColumn("place", _place())
    order = [F.desc("place") if backwards else F.asc("place")]
    strict = rows.orderBy(*order).limit(limit)
    alike = Window.partitionBy("place").orderBy("event_id")
    strict = strict.withColumn("copy", F.row_number().over(alike).cast("bigint"))
    if backwards:
        strict = _numbered_from_the_end(strict, rows)
    found.append(strict)
    page = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    page = page.orderBy(*order, F.desc("copy") if backwards else F.asc("copy")).limit(limit).orderBy("place", "copy")
    return page.select(*EVENT_COLUMNS, _cursor().alias("cursor")).withColumn("timestamp", iso_text(F.col("timestamp")))


def _copies(same: DataFrame, copy: int, limit: int, backwards: bool) -> DataFrame:
    """Of rows equal to the cursor's, those behind or before it; they are counted, and made again."""
    counted = same.groupBy(*EVENT_COLUMNS, "place").agg(F.count("*").alias("n"))
    first, last = (F.lit(max(1, copy - limit)), F.lit(copy - 1)) if backwards else (
        F.lit(copy + 1), F.least("n", F.lit(copy + limit))
    )
    wanted = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    return counted.withColumn("copy", F.explode(wanted)).drop("n")


def _numbered_from_the_end(strict: DataFrame, rows: DataFrame) -> DataFrame:
    """Backwards, a page may hold only the last of several equal rows, so these are numbered by how many there are."""
    # At most as many places as the page has rows, which bounds the broadcast.
    places = F.broadcast(strict.groupBy(F.col("place").alias("of")).agg(F.max("copy").alias("shown")))
    counts = rows.join(places, F.col("place").eqNullSafe(F.col("of"))).groupBy("of").agg(
        (F.count("*") - F.first("shown")).alias("hidden")
    )
    joined = strict.join(counts, F.col("place").eqNullSafe(F.col("of")))
    return joined.withColumn("copy", F.col("copy") + F.col("hidden")).drop("of", "hidden")
