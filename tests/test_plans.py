"""Physical plans: what reaches the scan, and what must not appear."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import log
from clickloom.plans.registered import QUERIES
from clickloom.sources.fixtures import bind_columns, fixture_events, raw_events
from clickloom.sources.messages import decode, normalize, split_malformed

SF_DIR = "/root/testdata/sf0.001"

WINDOWED = [
    "overview_24h", "overview_30d", "window_counts", "funnel_30d", "funnel_custom_7d", "funnel_category_30d",
    "timeseries_hour_24h", "timeseries_day_30d", "timeseries_click_minute_6h", "top_products_revenue",
    "top_products_views", "top_products_purchases", "top_categories_30d", "user_summary_u42", "user_events_u42",
    "user_summaries_30d", "revenue_hour_7d", "revenue_day_30d", "revenue_totals_30d", "realtime", "events_per_sec",
    "events_page", "events_filtered", "timeseries_pivot", "funnel_share", "product_share", "category_share",
    "category_profile", "cvr_bands", "events_page_info", "events_priced", "last_minute_total",
]
TOP_LISTS = ["top_products_revenue", "user_events_u42", "events_page", "events_filtered", "product_share"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WINDOWED)
def test_windows_reach_the_scan_and_rows_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts," in plan
    for unwanted in ("Python", "CartesianProduct", "NestedLoop", "ObjectHashAggregate", "SortAggregate"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", TOP_LISTS)
def test_limits_are_top_lists(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["overview_30d", "top_products_revenue", "user_summaries_30d", "timeseries_day_30d"])
def test_aggregates_combine_before_every_shuffle(spark, name):
    lines = plan_of(QUERIES[name](spark, SF_DIR)).splitlines()
    for above, below in zip(lines, lines[1:]):
        if "Exchange hashpartitioning" in above or "Exchange SinglePartition" in above:
            assert "HashAggregate" in below


def test_category_share_aggregates_once(spark):
    frame = QUERIES["category_share"](spark, SF_DIR)
    frame.collect()
    plan = plan_of(frame)
    assert "Window" not in plan
    assert "ReusedExchange" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["timeseries_day_30d"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "user_id" in plan_of(QUERIES["overview_30d"](spark, SF_DIR))
    assert plan_of(log.event_total(fixture_events(spark, SF_DIR, with_category=False))).endswith("ReadSchema: struct<>\n")


def test_large_categories_are_not_broadcast(spark):
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet")
    small = plan_of(bind_columns(raw_events(spark, SF_DIR), parts))
    assert "BroadcastHashJoin" in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        large = bind_columns(raw_events(spark, SF_DIR), parts)
        assert "SortMergeJoin" in plan_of(large) and "Broadcast" not in plan_of(large)
        assert large.where(F.col("category") == "").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages_are_parsed_once(spark):
    messages = spark.createDataFrame([("{}",)], "value STRING")
    for frame in (normalize(decode(messages)), *split_malformed(decode(messages))):
        assert plan_of(frame).count("from_json") == 1


@pytest.mark.parametrize("name,columns", [
    ("report_overview", "event_type:string,user_id:string,price:double,timestamp:timestamp_ntz"),
    ("report_revenue", "event_type:string,price:double,timestamp:timestamp_ntz"),
    ("report_user_events", None),
])
def test_reports_prune_by_themselves(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "event_month" in partitions and "GreaterThanOrEqual(timestamp," in pushed
    if columns is None:
        assert "EqualTo(user_id,u_42)" in pushed
    else:
        assert f"ReadSchema: struct<{columns}>" in plan


def test_deep_pages_number_no_more_than_few_groups_in_one_task(spark):
    plan = plan_of(QUERIES["events_deep_page"](spark, SF_DIR))
    assert "Python" not in plan and "CartesianProduct" not in plan
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line:
            assert "timestamp" in line and "lead" in line
