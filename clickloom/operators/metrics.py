"""KPI, funnel, ranking and time-series operators over an events frame.

Each takes a frame with the columns of ``vocabulary.EVENT_DDL`` and returns a
lazy frame. ``timestamp`` may be TIMESTAMP or TIMESTAMP_NTZ; bucket times come
out as ISO text. Filters come first so that they reach the scan, and
aggregates combine on the map side, so a hot product, user or minute is
reduced before any row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.aggregates import (
    count_of,
    money_sum,
    percent,
    purchase_revenue,
    ratio,
    round_cents,
    stage_counts,
)
from clickloom.functions.predicates import equal_to, in_live_window, in_window
from clickloom.functions.times import bucket_start, iso_text
from clickloom.vocabulary import PURCHASE, RANK_BY, STAGES, TOP_LIMIT, in_range, one_of

AsOf = Column | datetime | None


def conversion() -> Column:
    return percent("purchases", "views")


def order_value() -> Column:
    return ratio("revenue", "purchases")


def overview(events: DataFrame, window: str = "24h", as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """One row of headline numbers; zeros when the window is empty."""
    totals = in_window(events, window, as_of, bounded).agg(
        F.count("*").alias("total_events"),
        *stage_counts(),
        F.count_distinct("user_id").alias("unique_users"),
        purchase_revenue().alias("total_revenue"),
    )
    return totals.withColumns({
        "aov": ratio("total_revenue", "purchases"),
        "cvr_pct": conversion(),
    })


def stage_rows(
    events: DataFrame, stages: Sequence[str], count: Callable[[str], Column] = count_of
) -> DataFrame:
    """One row per stage with its count, the one before it, the first and the last; ``count`` is how one is counted."""
    if not stages or len(set(stages)) != len(stages):
        raise ValueError(f"stages must be distinct and not empty, not {list(stages)}")
    totals = events.agg(F.array(*[count(stage) for stage in stages]).alias("n"))
    n = F.col("n")
    rows = [
        F.struct(
            F.lit(stage).alias("stage"),
            n[i].alias("count"),
            (n[i - 1] if i else F.lit(None).cast("bigint")).alias("previous"),
            n[0].alias("first"),
            n[len(stages) - 1].alias("last"),
        )
        for i, stage in enumerate(stages)
    ]
    return totals.select(F.inline(F.array(*rows)))


def funnel(
    events: DataFrame,
    window: str = "24h",
    category: str | None = None,
    as_of: AsOf = None,
    stages: Sequence[str] = STAGES,
    bounded: bool = False,
) -> DataFrame:
    """Event count per stage, in stage order.

    ``drop_off_pct`` is the count as a percentage of the stage before (the name
    is historical), null for the first stage. Events are counted by type, not
    followed per user, so it can exceed 100. ``overall_cvr_pct`` compares the
    last stage with the first and repeats on each row.
    """
    return funnel_rates(stage_rows(equal_to(in_window(events, window, as_of, bounded), category=category), stages))


def funnel_rates(rows: DataFrame) -> DataFrame:
    """What ``funnel`` returns, from its stages' counts."""
    rates = rows.withColumns({
        "step": percent("count", "previous"),
        "overall": percent("last", "first"),
    })
    return rates.select(
        "stage",
        "count",
        F.when(F.col("previous").isNotNull(), round_cents("step")).alias("drop_off_pct"),
        round_cents("overall").alias("overall_cvr_pct"),
    )


def funnel_share(
    events: DataFrame,
    window: str = "24h",
    category: str | None = None,
    as_of: AsOf = None,
    stages: Sequence[str] = STAGES,
    bounded: bool = False,
) -> DataFrame:
    """Stage counts as a percentage of the first stage; an empty first stage counts as 1."""
    rows = stage_rows(equal_to(in_window(events, window, as_of, bounded), category=category), stages)
    share = F.col("count") / F.greatest("first", F.lit(1))
    return rows.select("stage", "count", (share * 100).alias("share_pct"))


def timeseries(
    events: DataFrame,
    window: str = "24h",
    bucket: str = "hour",
    event_type: str | None = None,
    as_of: AsOf = None,
    bounded: bool = False,
) -> DataFrame:
    """Count and revenue per bucket and event type; buckets without events are absent."""
    return (
        equal_to(in_window(events, window, as_of, bounded), event_type=event_type)
        .groupBy(bucket_start(bucket, events).alias("bucket"), "event_type")
        .agg(F.count("*").alias("cnt"), purchase_revenue().alias("revenue"))
        .orderBy("bucket", "event_type")
        .withColumn("bucket", iso_text(F.col("bucket")))
    )


def timeseries_pivot(
    events: DataFrame,
    window: str = "24h",
    bucket: str = "hour",
    as_of: AsOf = None,
    bounded: bool = False,
) -> DataFrame:
    """One row per bucket with a zero-filled count column per funnel stage."""
    return (
        in_window(events, window, as_of, bounded)
        .groupBy(bucket_start(bucket, events).alias("bucket"))
        .agg(*[count_of(stage).alias(stage) for stage in STAGES])
        .orderBy("bucket")
        .withColumn("bucket", iso_text(F.col("bucket")))
    )


def _sales(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(*stage_counts(), purchase_revenue().alias("revenue"))


def top_products(
    events: DataFrame,
    window: str = "24h",
    by: str = "revenue",
    limit: int = 10,
    as_of: AsOf = None,
    bounded: bool = False,
) -> DataFrame:
    """The ``limit`` best (product, category) pairs; ties go to the smaller keys."""
    one_of("by", by, RANK_BY)
    in_range("limit", limit, *TOP_LIMIT)
    return (
        _sales(in_window(events, window, as_of, bounded), "product_id", "category")
        .orderBy(F.desc(by), "product_id", "category")
        .limit(limit)
        .withColumn("cvr_pct", conversion())
    )


def top_categories(events: DataFrame, window: str = "24h", as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """Every category with its stage counts, best revenue first."""
    return (
        _sales(in_window(events, window, as_of, bounded), "category")
        .withColumns({"cvr_pct": conversion(), "aov": order_value()})
        .orderBy(F.desc("revenue"), "category")
    )


def revenue(
    events: DataFrame,
    window: str = "24h",
    bucket: str = "hour",
    as_of: AsOf = None,
    bounded: bool = False,
) -> DataFrame:
    """Orders, revenue and average order value per bucket that has purchases."""
    return (
        equal_to(in_window(events, window, as_of, bounded), event_type=PURCHASE)
        .groupBy(bucket_start(bucket, events).alias("bucket"))
        .agg(F.count("*").alias("orders"), money_sum("price").alias("revenue"))
        .orderBy("bucket")
        .select(
            iso_text(F.col("bucket")).alias("bucket"),
            "orders",
            "revenue",
            (F.col("revenue") / F.col("orders")).alias("aov"),
        )
    )


def revenue_totals(events: DataFrame, window: str = "24h", as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """Total revenue, orders and average order value of the window, money rounded to cents."""
    totals = equal_to(in_window(events, window, as_of, bounded), event_type=PURCHASE).agg(
        F.count("*").alias("total_orders"), money_sum("price").alias("total")
    )
    means = totals.withColumn("mean", ratio("total", "total_orders"))
    return means.select(
        round_cents("total").alias("total_revenue"),
        "total_orders",
        round_cents("mean").alias("overall_aov"),
    )


def _live_minutes(events: DataFrame, as_of: AsOf, bounded: bool) -> DataFrame:
    return (
        in_live_window(events, as_of, bounded)
        .groupBy(bucket_start("minute", events).alias("bucket"))
        .agg(*stage_counts(), F.count("*").alias("total"))
    )


def realtime(events: DataFrame, as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """Stage counts per minute over the live window."""
    return _live_minutes(events, as_of, bounded).orderBy("bucket").withColumn("bucket", iso_text(F.col("bucket")))


def events_per_sec(events: DataFrame, as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """Events per second in the latest live minute; 0.0 when there is none."""
    latest = _live_minutes(events, as_of, bounded).agg(F.max_by("total", "bucket").alias("total"))
    rate = latest.select((F.coalesce("total", F.lit(0)) / F.lit(60.0)).alias("rate"))
    return rate.select(round_cents("rate").alias("events_per_sec"))


def last_minute_total(events: DataFrame, as_of: AsOf = None, bounded: bool = False) -> DataFrame:
    """Event count of the latest live minute; 0 when there is none."""
    latest = _live_minutes(events, as_of, bounded).agg(F.max_by("total", "bucket").alias("total"))
    return latest.select(F.coalesce("total", F.lit(0)).alias("last_minute_total"))
