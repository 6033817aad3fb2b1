"""The event log, per-user lookup and the table's row count."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clickloom.functions.aggregates import purchase_revenue, stage_counts
from clickloom.functions.predicates import equal_to, in_window
from clickloom.functions.times import iso_text
from clickloom.vocabulary import EVENT_COLUMNS, JOURNEY_LIMIT, LOG_LIMIT, in_range

AsOf = Column | datetime | None

# What orders events of one second: the id, and for events that share it or lack
# one, everything else, so that consecutive pages never repeat or skip a row.
WITHIN_SECOND = ("event_id", "user_id", "product_id", "event_type", "price", "category", "ip_address")

# A top list of so many rows costs less than counting first; both ways give the same page.
TOP_LIST_ROWS = 2_000
# An hour the page touches is split at about so many of its own rows, but not finer than one in RARELY.
SPLITTERS, RARELY = 1_023, 4_096


def event_total(events: DataFrame) -> DataFrame:
    """Row count of the whole table."""
    return events.agg(F.count("*").alias("total_events"))


def _user_totals() -> list[Column]:
    # unique_products_viewed counts products over all event types.
    return [
        F.count("*").alias("total_events"),
        *stage_counts(),
        purchase_revenue().alias("total_spent"),
        F.count_distinct("product_id").alias("unique_products_viewed"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    ]


def _seen_as_text(totals: DataFrame) -> DataFrame:
    return totals.withColumns({name: iso_text(F.col(name)) for name in ("first_seen", "last_seen")})


def user_summary(
    events: DataFrame, user_id: str, window: str = "7d", as_of: AsOf = None, bounded: bool = False
) -> DataFrame:
    """One row about one user; no row for a user without events in the window."""
    mine = in_window(events, window, as_of, bounded).where(F.col("user_id") == F.lit(user_id))
    return _seen_as_text(mine.agg(*_user_totals()).where("total_events > 0"))


def user_summaries(events: DataFrame, window: str = "7d", as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """The same summary for every user in the window.

    The distinct count makes Spark aggregate by (user, product) first, so one
    user holding much of the table is spread over many tasks.
    """
    return _seen_as_text(in_window(events, window, as_of, bounded).groupBy("user_id").agg(*_user_totals()))


def user_events(
    events: DataFrame,
    user_id: str,
    window: str = "7d",
    as_of: AsOf = None,
    limit: int = JOURNEY_LIMIT,
    bounded: bool = False,
) -> DataFrame:
    """A user's first ``limit`` events of the window, oldest first."""
    in_range("limit", limit, *LOG_LIMIT)
    return (
        in_window(events, window, as_of, bounded)
        .where(F.col("user_id") == F.lit(user_id))
        .orderBy("timestamp", *WITHIN_SECOND)
        .limit(limit)
        .select("event_id", "event_type", "product_id", "price", "timestamp", "category")
        .withColumn("timestamp", iso_text(F.col("timestamp")))
    )


def list_events(
    events: DataFrame,
    limit: int = 50,
    offset: int = 0,
    event_type: str | None = None,
    category: str | None = None,
    user_id: str | None = None,
    window: str = "24h",
    as_of: AsOf = None,
    bounded: bool = False,
) -> DataFrame:
    """One page of the log, newest first; events of one second are ordered by event_id."""
    in_range("limit", limit, *LOG_LIMIT)
    in_range("offset", offset, 0)
    kept = equal_to(
        in_window(events, window, as_of, bounded),
        event_type=event_type, category=category, user_id=user_id,
    ).select(*EVENT_COLUMNS)
    if offset + limit <= TOP_LIST_ROWS:
        page = kept.orderBy(F.desc("timestamp"), *WITHIN_SECOND).offset(offset).limit(limit)
    else:
        page = deep_page(kept, limit, offset)
    return page.withColumn("timestamp", iso_text(F.col("timestamp")))


def _touched(groups: DataFrame, order: WindowSpec, limit: int, offset: int) -> DataFrame:
    """Groups holding rows of the page, from row counts ``n``.

    ``before`` is the number of rows in front of a group. It is added to the
    ``before`` the groups already carry for the range they lie in.
    """
    ahead = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = groups.withColumn("before", F.col("before") + F.coalesce(ahead, F.lit(0)))
    return placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))


def _within(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Rows of the groups, with the groups' other columns; null keys meet each other.

    At most ``limit`` groups can hold rows of a page, which bounds the broadcast.
    """
    small = F.broadcast(groups.withColumnsRenamed({key: f"of_{key}" for key in keys}))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"of_{key}"))
    return rows.join(small, same).drop(*[f"of_{key}" for key in keys])


def _slot() -> Column:
    """How many of the sorted ``splitters`` lie before a row's ``place``, by binary search."""
    steps = ", ".join(str(1 << bit) for bit in reversed(range(SPLITTERS.bit_length() + 1)))
    return F.expr(
        f"aggregate(array({steps}), 0, (n, step) -> "
        "CASE WHEN get(splitters, n + step - 1) < place THEN n + step ELSE n END)"
    )


def deep_page(kept: DataFrame, limit: int, offset: int) -> DataFrame:
    """Page ``offset`` rows into the log, without sorting the rows in front of it.

    Row counts say where the page lies: first per hour, of which a window has
    few, then, in the hours it touches, between splitters. These are rows of the
    hour, chosen by a hash of their content and so the same whenever asked for,
    and compared in the log's whole order; whatever times and ids a crowded hour
    has, it falls into parts of about equal size. Of the parts the page touches,
    equal rows are counted before they are numbered. Null ids come first, and
    null times last, as in the sorted log.
    """
    in_range("limit", limit, *LOG_LIMIT)
    in_range("offset", offset, 0)
    # Newer is less; the time is null only in the hour that is null as well.
    place = F.struct((-F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("age"), *WITHIN_SECOND)
    rows = kept.withColumns({"hour": F.date_trunc("hour", "timestamp"), "place": place})
    counted = rows.groupBy("hour").agg(F.count("*").alias("n"))
    # At least one row of an hour the page touches is on the page, and all but two such hours are on it whole.
    hours = _touched(
        counted.withColumn("before", F.lit(0).cast("bigint")), Window.orderBy(F.desc("hour")), limit, offset
    )
    chosen = F.expr(f"pmod(xxhash64(place), greatest(n div {SPLITTERS}, {RARELY})) = 0")
    splitters = F.array_sort(F.collect_set(F.when(chosen, F.col("place")))).alias("splitters")
    hours = _within(rows, hours, "hour").groupBy("hour").agg(F.first("before").alias("before"), splitters)
    near = _within(rows, hours, "hour").withColumn("slot", _slot()).drop("splitters", "place")
    slots = _touched(
        near.groupBy("hour", "slot").agg(F.count("*").alias("n"), F.first("before").alias("before")),
        Window.partitionBy("hour").orderBy("slot"), limit, offset,
    ).drop("n")
    alike = (
        _within(near.drop("before"), slots, "hour", "slot")
        .groupBy("hour", "slot", "before", *EVENT_COLUMNS).agg(F.count("*").alias("n"))
    )
    in_slot = Window.partitionBy("hour", "slot").orderBy(F.desc("timestamp"), *WITHIN_SECOND)
    # Copies of one row follow each other, so only those on the page are made.
    first = F.greatest(F.col("before") + 1, F.lit(offset + 1).cast("bigint"))
    last = F.least(F.col("before") + F.col("n"), F.lit(offset + limit).cast("bigint"))
    return (
        _touched(alike, in_slot, limit, offset)
        .withColumn("position", F.explode(F.sequence(first, last)))
        .orderBy("position")
        .select(*EVENT_COLUMNS)
    )
