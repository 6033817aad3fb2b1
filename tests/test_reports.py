"""Reports over a stored table against the operators over the same rows."""

from datetime import datetime, timezone

import pytest
from events import AS_OF
from pyspark.sql import functions as F

from clickloom.operators import log, metrics
from clickloom.plans.reports import Reports
from clickloom.sources.fixtures import fixture_events, latest_second
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.table import write_events

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    return fixture_events(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def path(spark, batch):
    folder = fresh_folder(spark, "reports")
    write_events(batch, folder, "load")
    return folder


def test_reports_equal_operators(spark, batch, path):
    as_of = latest_second(spark, SF_DIR)
    reports = Reports(spark, path, as_of)
    pairs = [
        (reports.health(), log.event_total(batch)),
        (reports.events("7d", limit=7, offset=3, event_type="click"),
         log.list_events(batch, 7, 3, "click", window="7d", as_of=as_of)),
        (reports.overview("7d"), metrics.overview(batch, "7d", as_of)),
        (reports.funnel("30d", "promo"), metrics.funnel(batch, "30d", "promo", as_of)),
        (reports.timeseries("7d", "day"), metrics.timeseries(batch, "7d", "day", as_of=as_of)),
        (reports.top_products("30d", "views", 5), metrics.top_products(batch, "30d", "views", 5, as_of)),
        (reports.top_categories("30d"), metrics.top_categories(batch, "30d", as_of)),
        *zip(reports.user("u_3", "30d"),
             (log.user_summary(batch, "u_3", "30d", as_of), log.user_events(batch, "u_3", "30d", as_of))),
        *zip(reports.revenue("30d", "day"),
             (metrics.revenue_totals(batch, "30d", as_of), metrics.revenue(batch, "30d", "day", as_of))),
        *zip(reports.realtime(), (metrics.events_per_sec(batch, as_of), metrics.realtime(batch, as_of))),
    ]
    for report, operator in pairs:
        assert report.collect() == operator.collect()


def test_reports_default_to_now(spark, make_events):
    folder = fresh_folder(spark, "reports")
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    shift = F.lit(now - AS_OF)
    events = make_events([("a", "view", "u", "p", 1, 20), ("b", "purchase", "u", "p", 2, 3 * 86400)])
    write_events(events.withColumn("timestamp", F.col("timestamp") + shift), folder, "load")
    reports = Reports(spark, folder)
    assert reports.overview().first().total_events == 1
    assert reports.overview("7d").first().total_revenue == 2.0
    assert reports.realtime()[0].first()[0] == 0.02
    assert reports.user("u")[0].first().total_events == 2
