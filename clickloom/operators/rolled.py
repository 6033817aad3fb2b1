"""The KPI operators over a stored table with a rollup: whole hours from sums, the cut edges from rows.

A window begins, and if it is bounded ends, somewhere within an hour. Rows are
read of these hours only; all hours between come from the rollup, whose size
does not depend on the number of events. Results are the rows that the
operators of ``metrics`` give on the table. A batch of which the ingest has
written the rows and not yet the sums counts in the edges only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.aggregates import money_total, ratio, round_cents
from clickloom.functions.predicates import equal_to
from clickloom.functions.times import as_of_column, iso_text, month_key, require_utc, window_start
from clickloom.operators.metrics import conversion, funnel_rates, order_value, stage_rows
from clickloom.sources.rollup import (
    MONEY, bitmaps, hour_sums, merged_users, read_codes, read_hours, read_users,
)
from clickloom.sources.table import read_events
from clickloom.vocabulary import PURCHASE, STAGE_COLUMNS, STAGES, one_of

ROLLED_BUCKETS = ("hour", "day")


class Stitched:
    """A window of a table and its rollup."""

    def __init__(
        self, spark: SparkSession, table: str, rollup: str, window: str = "24h",
        as_of: Column | datetime | None = None, bounded: bool = False,
    ):
        require_utc(spark)
        self._spark, self._table, self._rollup = spark, table, rollup
        self._start = window_start(window, as_of, zoneless=True)
        # The first whole hour: the start itself if it is one.
        cut = F.date_trunc("hour", self._start - F.expr("INTERVAL '0.000001' SECOND"))
        self._first = cut.cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
        self._end = as_of_column(as_of, zoneless=True) if bounded else None
        self._last = None if self._end is None else F.date_trunc("hour", self._end).cast("timestamp_ntz")

    def edges(self) -> DataFrame:
        """The window's events outside its whole hours."""
        time = F.col("timestamp")
        lower = read_events(self._spark, self._table, self._start, self._first).where(time < self._first)
        if self._end is None:
            return lower
        return lower.unionByName(read_events(self._spark, self._table, self._last, self._end))

    def _whole(self, rows: DataFrame) -> DataFrame:
        rows = rows.where((F.col("event_month") >= month_key(self._first)) & (F.col("hour") >= self._first))
        if self._last is not None:
            rows = rows.where((F.col("event_month") <= month_key(self._last)) & (F.col("hour") < self._last))
        return rows

    def sums(self) -> DataFrame:
        """(hour, event_type, category, cnt and money parts), to be added up."""
        names = ("hour", "event_type", "category", "cnt", *MONEY)
        return self._whole(read_hours(self._spark, self._rollup)).select(*names).unionByName(
            hour_sums(self.edges()).select(*names)
        )

    def users(self) -> DataFrame:
        """(bucket, bitmap): the codes of all users of the window."""
        seen = self.edges().where("user_id IS NOT NULL").select("user_id").distinct()
        coded = seen.join(read_codes(self._spark, self._rollup).select("user_id", "code").hint("merge"), "user_id")
        whole = self._whole(read_users(self._spark, self._rollup)).select("bucket", "bitmap")
        return merged_users(whole.unionByName(bitmaps(coded)))


def _counted(event_type: str) -> Column:
    return F.expr(f"coalesce(sum(cnt) FILTER (WHERE event_type = '{event_type}'), 0L)")


def _stage_counts() -> list[Column]:
    return [_counted(stage).alias(name) for name, stage in STAGE_COLUMNS.items()]


def _total() -> Column:
    return F.expr("coalesce(sum(cnt), 0L)")


def _revenue() -> Column:
    return money_total({part: f"sum({part}) FILTER (WHERE event_type = '{PURCHASE}')" for part in MONEY})


def overview(spark: SparkSession, table: str, rollup: str, window: str = "24h", **moment) -> DataFrame:
    """The row of ``metrics.overview``."""
    stitched = Stitched(spark, table, rollup, window, **moment)
    users = stitched.users().select(F.bitmap_count("bitmap").alias("users"))
    # Counts and bitmaps meet as rows of one aggregate.
    both = stitched.sums().unionByName(users, allowMissingColumns=True)
    totals = both.agg(
        _total().alias("total_events"), *_stage_counts(),
        F.expr("coalesce(sum(users), 0L) AS unique_users"), _revenue().alias("total_revenue"),
    )
    return totals.withColumns({"aov": ratio("total_revenue", "purchases"), "cvr_pct": conversion()})


def unique_users(spark: SparkSession, table: str, rollup: str, window: str = "24h", **moment) -> DataFrame:
    """The exact number of different users of the window."""
    users = Stitched(spark, table, rollup, window, **moment).users()
    return users.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("unique_users"))


def funnel(
    spark: SparkSession, table: str, rollup: str, window: str = "24h", category: str | None = None,
    stages: Sequence[str] = STAGES, **moment,
) -> DataFrame:
    """The rows of ``metrics.funnel``."""
    sums = equal_to(Stitched(spark, table, rollup, window, **moment).sums(), category=category)
    return funnel_rates(stage_rows(sums, stages, _counted))


def timeseries(
    spark: SparkSession, table: str, rollup: str, window: str = "24h", bucket: str = "hour",
    event_type: str | None = None, **moment,
) -> DataFrame:
    """The rows of ``metrics.timeseries``, for buckets of whole hours."""
    sums = equal_to(Stitched(spark, table, rollup, window, **moment).sums(), event_type=event_type)
    return (
        sums.groupBy(_bucket(bucket), "event_type").agg(_total().alias("cnt"), _revenue().alias("revenue"))
        .orderBy("bucket", "event_type").withColumn("bucket", iso_text(F.col("bucket")))
    )


def _bucket(bucket: str) -> Column:
    one_of("bucket", bucket, ROLLED_BUCKETS)
    return (F.col("hour") if bucket == "hour" else F.date_trunc(bucket, "hour").cast("timestamp_ntz")).alias("bucket")


def top_categories(spark: SparkSession, table: str, rollup: str, window: str = "24h", **moment) -> DataFrame:
    """The rows of ``metrics.top_categories``."""
    sales = Stitched(spark, table, rollup, window, **moment).sums().groupBy("category").agg(
        *_stage_counts(), _revenue().alias("revenue")
    )
    return sales.withColumns({"cvr_pct": conversion(), "aov": order_value()}).orderBy(F.desc("revenue"), "category")


def revenue(
    spark: SparkSession, table: str, rollup: str, window: str = "24h", bucket: str = "hour", **moment
) -> DataFrame:
    """The rows of ``metrics.revenue``, for buckets of whole hours."""
    sums = equal_to(Stitched(spark, table, rollup, window, **moment).sums(), event_type=PURCHASE)
    totals = sums.groupBy(_bucket(bucket)).agg(_total().alias("orders"), _revenue().alias("revenue"))
    return totals.orderBy("bucket").select(
        iso_text(F.col("bucket")).alias("bucket"), "orders", "revenue", (F.col("revenue") / F.col("orders")).alias("aov")
    )


def revenue_totals(spark: SparkSession, table: str, rollup: str, window: str = "24h", **moment) -> DataFrame:
    """The row of ``metrics.revenue_totals``."""
    sums = equal_to(Stitched(spark, table, rollup, window, **moment).sums(), event_type=PURCHASE)
    totals = sums.agg(_total().alias("total_orders"), _revenue().alias("total"))
    means = totals.withColumn("mean", ratio("total", "total_orders"))
    return means.select(
        round_cents("total").alias("total_revenue"), "total_orders", round_cents("mean").alias("overall_aov")
    )
