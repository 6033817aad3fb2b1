"""Operators on hand-made rows, for the cases the fixture tables lack."""

from datetime import timezone

import pytest
from events import AS_OF
from pyspark.sql import functions as F

from clickloom.operators import log, metrics, shaping

HOUR = 3600

SHOP = [
    # id, type, user, product, price, seconds before AS_OF, category
    ("a", "view", "u_1", "p_1", 10.0, 60, "books"),
    ("b", "click", "u_1", "p_1", 10.0, 50, "books"),
    ("c", "add_to_cart", "u_1", "p_1", 10.0, 40, "books"),
    ("d", "purchase", "u_1", "p_1", 10.0, 30, "books"),
    ("e", "view", "u_2", "p_2", 20.5, 2 * HOUR, "food"),
    ("f", "purchase", "u_2", "p_2", 20.5, 2 * HOUR, "food"),
    ("g", "view", "u_2", "p_3", 7.0, 3 * HOUR, "food"),
    ("h", "refund", "u_3", "p_3", 7.0, 5 * HOUR, "food"),
    ("old", "purchase", "u_9", "p_9", 99.0, 25 * HOUR, "books"),
    ("future", "view", "u_4", "p_1", 10.0, -HOUR, "books"),
]


@pytest.fixture(scope="module", params=[False, True], ids=["ntz", "zoned"])
def shop(request, make_events):
    return make_events(SHOP, zoned=request.param).cache()


@pytest.fixture(scope="module")
def nothing(make_events):
    return make_events([("x", "view", "u", "p", 1.0, 40 * 24 * HOUR)])


def dicts(frame):
    return [row.asDict() for row in frame.collect()]


def test_overview(shop):
    (row,) = dicts(metrics.overview(shop, as_of=AS_OF))
    assert row == dict(
        total_events=9, views=4, clicks=1, carts=1, purchases=2, unique_users=4,
        total_revenue=30.5, aov=15.25, cvr_pct=50.0,
    )


def test_overview_of_nothing_is_one_row_of_zeros(nothing):
    (row,) = dicts(metrics.overview(nothing, as_of=AS_OF))
    assert set(row.values()) == {0}


def test_future_rows_count_unless_bounded(shop):
    assert metrics.overview(shop, "1h", AS_OF).first().total_events == 5
    assert metrics.overview(shop, "1h", AS_OF, bounded=True).first().total_events == 4


def test_window_start_is_included(make_events):
    edge = make_events([("in", "view", "u", "p", 1, HOUR), ("out", "view", "u", "p", 1, HOUR + 1)])
    assert metrics.overview(edge, "1h", AS_OF).first().total_events == 1


def test_as_of_forms(shop):
    aware = AS_OF.replace(tzinfo=timezone.utc)
    kind = shop.schema["timestamp"].dataType
    column = F.lit(AS_OF.isoformat(sep=" ")).cast(kind)
    for as_of in (AS_OF, aware, column):
        assert metrics.overview(shop, as_of=as_of).first().total_events == 9


def test_as_of_defaults_to_now(shop, spark):
    assert metrics.overview(shop).first().total_events == 0
    fresh = shop.limit(1).withColumn("timestamp", F.current_timestamp().cast(shop.schema["timestamp"].dataType))
    assert metrics.overview(fresh, "1h").first().total_events == 1


@pytest.mark.parametrize("window", ["2h", "", "24H", "1d"])
def test_unknown_window(shop, window):
    with pytest.raises(ValueError):
        metrics.overview(shop, window)


def test_other_session_zones_are_refused(shop, spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for call in (metrics.overview, metrics.realtime, log.list_events):
            with pytest.raises(ValueError, match="UTC"):
                call(shop)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_funnel_with_all_stages(shop):
    rows = [tuple(r) for r in metrics.funnel(shop, as_of=AS_OF).collect()]
    assert rows == [
        ("view", 4, None, 50.0), ("click", 1, 25.0, 50.0),
        ("add_to_cart", 1, 100.0, 50.0), ("purchase", 2, 200.0, 50.0),
    ]


def test_funnel_zero_denominators(shop, nothing):
    rows = [tuple(r) for r in metrics.funnel(shop, category="food", as_of=AS_OF).collect()]
    assert rows == [
        ("view", 2, None, 50.0), ("click", 0, 0.0, 50.0), ("add_to_cart", 0, 0.0, 50.0), ("purchase", 1, 0.0, 50.0),
    ]
    assert [tuple(r)[1:] for r in metrics.funnel(nothing, as_of=AS_OF).collect()] == [
        (0, None, 0.0), (0, 0.0, 0.0), (0, 0.0, 0.0), (0, 0.0, 0.0),
    ]


def test_funnel_rounds_ties_to_even(make_events):
    rows = [(f"v{i}", "view", "u", "p", 1, 1) for i in range(32)] + [("k", "click", "u", "p", 1, 1)]
    got = {r.stage: r.drop_off_pct for r in metrics.funnel(make_events(rows), as_of=AS_OF).collect()}
    assert got["click"] == 3.12


def test_empty_category_is_no_filter(shop):
    assert dicts(metrics.funnel(shop, category="", as_of=AS_OF)) == dicts(metrics.funnel(shop, as_of=AS_OF))


def test_funnel_share(shop, nothing):
    assert [r.share_pct for r in metrics.funnel_share(shop, as_of=AS_OF).collect()] == [100.0, 25.0, 25.0, 50.0]
    assert [r.share_pct for r in metrics.funnel_share(nothing, as_of=AS_OF).collect()] == [0.0] * 4


@pytest.mark.parametrize("stages", [(), ("view", "view")])
def test_bad_stages(shop, stages):
    with pytest.raises(ValueError):
        metrics.funnel(shop, stages=stages)


def test_timeseries(shop):
    rows = [tuple(r) for r in metrics.timeseries(shop, as_of=AS_OF).collect()]
    assert rows == [
        ("2024-05-01T07:00:00", "refund", 1, 0.0),
        ("2024-05-01T09:00:00", "view", 1, 0.0),
        ("2024-05-01T10:00:00", "purchase", 1, 20.5),
        ("2024-05-01T10:00:00", "view", 1, 0.0),
        ("2024-05-01T11:00:00", "add_to_cart", 1, 0.0),
        ("2024-05-01T11:00:00", "click", 1, 0.0),
        ("2024-05-01T11:00:00", "purchase", 1, 10.0),
        ("2024-05-01T11:00:00", "view", 1, 0.0),
        ("2024-05-01T13:00:00", "view", 1, 0.0),
    ]
    only = metrics.timeseries(shop, bucket="day", event_type="purchase", as_of=AS_OF).collect()
    assert [tuple(r) for r in only] == [("2024-05-01T00:00:00", "purchase", 2, 30.5)]
    with pytest.raises(ValueError):
        metrics.timeseries(shop, bucket="week")


def test_pivot_keeps_buckets_without_stages(shop):
    rows = [tuple(r) for r in metrics.timeseries_pivot(shop, as_of=AS_OF).collect()]
    assert rows[0] == ("2024-05-01T07:00:00", 0, 0, 0, 0)
    assert rows[3] == ("2024-05-01T11:00:00", 1, 1, 1, 1)


def test_pivot_agrees_with_pivoting_the_series(shop):
    from clickloom.vocabulary import STAGES

    series = metrics.timeseries(shop, as_of=AS_OF)
    by_hand = series.groupBy("bucket").pivot("event_type", list(STAGES)).sum("cnt").na.fill(0).orderBy("bucket")
    assert dicts(by_hand) == dicts(metrics.timeseries_pivot(shop, as_of=AS_OF))


def test_top_products(shop):
    rows = dicts(metrics.top_products(shop, as_of=AS_OF))
    assert [(r["product_id"], r["revenue"], r["cvr_pct"]) for r in rows] == [
        ("p_2", 20.5, 100.0), ("p_1", 10.0, 50.0), ("p_3", 0.0, 0.0),
    ]
    assert [r["product_id"] for r in dicts(metrics.top_products(shop, by="views", limit=2, as_of=AS_OF))] == ["p_1", "p_2"]


def test_ties_at_the_limit_go_to_the_smaller_key(make_events):
    rows = [(f"e{i}", "purchase", "u", f"p_{i}", 5.0, 1) for i in (3, 1, 2)]
    got = metrics.top_products(make_events(rows), limit=2, as_of=AS_OF).collect()
    assert [r.product_id for r in got] == ["p_1", "p_2"]


@pytest.mark.parametrize("arguments", [{"by": "carts"}, {"limit": 0}, {"limit": 101}, {"limit": 2.5}, {"limit": True}])
def test_bad_ranking(shop, arguments):
    with pytest.raises(ValueError):
        metrics.top_products(shop, **arguments)


def test_categories_and_their_shapes(shop, nothing):
    categories = metrics.top_categories(shop, as_of=AS_OF)
    assert [(r.category, r.revenue, r.aov) for r in categories.collect()] == [("food", 20.5, 20.5), ("books", 10.0, 10.0)]
    assert [r.share_pct for r in shaping.category_share(categories).collect()] == [100.0, 10.0 / 20.5 * 100]
    assert shaping.category_profile(categories).columns == ["category", "views", "purchases", "cvr", "revenue", "aov"]
    assert metrics.top_categories(nothing, as_of=AS_OF).collect() == []


def test_share_of_a_zero_best_is_zero(make_events):
    views = make_events([("a", "view", "u", "p_1", 5, 1), ("b", "view", "u", "p_2", 5, 1)])
    products = metrics.top_products(views, as_of=AS_OF)
    assert [r.share_pct for r in shaping.product_share(products).collect()] == [0.0, 0.0]
    assert [r.share_pct for r in shaping.product_share(products, "views").collect()] == [100.0, 100.0]
    assert [r.share_pct for r in shaping.category_share(metrics.top_categories(views, as_of=AS_OF)).collect()] == [0.0]


def test_revenue_buckets_add_up_to_the_totals(shop, nothing):
    buckets = dicts(metrics.revenue(shop, as_of=AS_OF))
    assert [tuple(b.values()) for b in buckets] == [
        ("2024-05-01T10:00:00", 1, 20.5, 20.5), ("2024-05-01T11:00:00", 1, 10.0, 10.0),
    ]
    assert dicts(metrics.revenue_totals(shop, as_of=AS_OF)) == [
        {"total_revenue": 30.5, "total_orders": 2, "overall_aov": 15.25}
    ]
    assert metrics.revenue(nothing, as_of=AS_OF).collect() == []
    assert dicts(metrics.revenue_totals(nothing, as_of=AS_OF)) == [
        {"total_revenue": 0.0, "total_orders": 0, "overall_aov": 0.0}
    ]


def test_live(make_events, nothing):
    live = make_events([
        ("1", "view", "u", "p", 1, 121), ("2", "view", "u", "p", 1, 120), ("3", "click", "u", "p", 1, 70),
        ("4", "purchase", "u", "p", 1, 59), ("5", "other", "u", "p", 1, 1),
    ])
    assert [tuple(r) for r in metrics.realtime(live, AS_OF).collect()] == [
        ("2024-05-01T11:58:00", 1, 1, 0, 0, 2), ("2024-05-01T11:59:00", 0, 0, 0, 1, 2),
    ]
    assert metrics.events_per_sec(live, AS_OF).first()[0] == 0.03
    assert metrics.last_minute_total(live, AS_OF).first()[0] == 2
    assert metrics.realtime(nothing, AS_OF).collect() == []
    assert metrics.events_per_sec(nothing, AS_OF).first()[0] == 0.0
    assert metrics.last_minute_total(nothing, AS_OF).first()[0] == 0


def test_user_lookup(shop):
    (row,) = dicts(log.user_summary(shop, "u_2", as_of=AS_OF))
    assert row == dict(
        total_events=3, views=2, clicks=0, carts=0, purchases=1, total_spent=20.5, unique_products_viewed=2,
        first_seen="2024-05-01T09:00:00", last_seen="2024-05-01T10:00:00",
    )
    assert [r.event_id for r in log.user_events(shop, "u_2", as_of=AS_OF).collect()] == ["g", "e", "f"]
    assert [r.event_id for r in log.user_events(shop, "u_2", as_of=AS_OF, limit=2).collect()] == ["g", "e"]


def test_unknown_user_is_empty(shop):
    assert log.user_summary(shop, "u'; --", as_of=AS_OF).collect() == []
    assert log.user_events(shop, "nobody", as_of=AS_OF).collect() == []


def test_all_summaries_agree_with_single_ones(shop):
    together = {r.pop("user_id"): r for r in dicts(log.user_summaries(shop, "24h", AS_OF))}
    assert set(together) == {"u_1", "u_2", "u_3", "u_4"}
    for user, row in together.items():
        assert dicts(log.user_summary(shop, user, "24h", AS_OF)) == [row]


def test_log_filters(shop):
    def ids(**filters):
        return [r.event_id for r in log.list_events(shop, as_of=AS_OF, **filters).collect()]

    assert ids() == ["future", "d", "c", "b", "a", "e", "f", "g", "h"]
    assert ids(event_type="", category="", user_id="") == ids()
    assert ids(event_type="view", category="food") == ["e", "g"]
    assert ids(user_id="u_2", limit=1, offset=1) == ["f"]
    assert ids(event_type="VIEW") == []
    assert ids(offset=100) == []


@pytest.mark.parametrize("arguments", [{"limit": 0}, {"limit": 1001}, {"offset": -1}, {"window": "x"}])
def test_bad_page(shop, arguments):
    with pytest.raises(ValueError):
        log.list_events(shop, **arguments)


def test_page_shapes(shop):
    page = log.list_events(shop, limit=4, offset=2, as_of=AS_OF)
    assert dicts(shaping.page_info(page, 4, 2)) == [{"first_row": 3, "last_row": 6, "row_count": 4, "has_next": True}]
    last = log.list_events(shop, limit=4, offset=8, as_of=AS_OF)
    assert dicts(shaping.page_info(last, 4, 8)) == [{"first_row": 9, "last_row": 9, "row_count": 1, "has_next": False}]
    shown = page.select("event_id", shaping.shown_price(F.col("event_type"), F.col("price")).alias("p"))
    assert [tuple(r) for r in shown.collect()] == [("c", None), ("b", None), ("a", None), ("e", None)]


def test_bands(spark):
    rows = spark.createDataFrame([(3.0,), (2.99,), (1.0,), (0.99,), (0.0,)], "x DOUBLE")
    assert [r[0] for r in rows.select(shaping.cvr_band(F.col("x"))).collect()] == ["good", "fair", "fair", "poor", "poor"]


def test_total_has_no_window(shop):
    assert log.event_total(shop).first().total_events == 10


def test_properties(shop):
    kpi = metrics.overview(shop, as_of=AS_OF).first()
    assert kpi.views + kpi.clicks + kpi.carts + kpi.purchases <= kpi.total_events
    assert metrics.timeseries(shop, as_of=AS_OF).agg(F.sum("cnt")).first()[0] == kpi.total_events
    assert metrics.revenue(shop, as_of=AS_OF).agg(F.sum("revenue")).first()[0] == kpi.total_revenue
    pages = [r.event_id for o in range(0, 9, 2) for r in log.list_events(shop, 2, o, as_of=AS_OF).collect()]
    assert pages == [r.event_id for r in log.list_events(shop, as_of=AS_OF).collect()]
