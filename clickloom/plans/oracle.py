"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

_EVENTS = """
WITH bound AS (
    SELECT CAST(e.event_id AS VARCHAR) AS event_id,
           e.event_type,
           'u_' || e.user_id AS user_id,
           'p_' || json_extract_string(e.props, '$.k') AS product_id,
           e.value AS price,
           date_trunc('second', e.ts) AS ts,
           coalesce(lower(p.p_type), '') AS category,
           '' AS ip_address
    FROM events e
    LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
),
clock AS (SELECT max(ts) AS as_of FROM bound)
"""

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"

_STAGES = """count(*) FILTER (event_type = 'view') AS views,
    count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'add_to_cart') AS carts,
    count(*) FILTER (event_type = 'purchase') AS purchases"""

_REVENUE = """CAST(coalesce(sum(CAST(price AS DECIMAL(18,2)))
    FILTER (event_type = 'purchase'), 0) AS DOUBLE)"""

_MONEY = "CAST(coalesce(sum(CAST(price AS DECIMAL(18,2))), 0) AS DOUBLE)"

_CVR = "CASE WHEN views > 0 THEN 100.0::DOUBLE * purchases / views ELSE 0.0::DOUBLE END"


def _since(interval: str) -> str:
    return f"ts >= (SELECT as_of FROM clock) - INTERVAL {interval}"


def _aov(revenue: str) -> str:
    return f"CASE WHEN purchases > 0 THEN {revenue} / purchases ELSE 0.0::DOUBLE END"


def _overview(interval: str) -> str:
    return f"""{_EVENTS}, totals AS (
    SELECT count(*) AS total_events, {_STAGES}, count(DISTINCT user_id) AS unique_users,
           {_REVENUE} AS total_revenue
    FROM bound WHERE {_since(interval)})
    SELECT *, {_aov('total_revenue')} AS aov, {_CVR} AS cvr_pct FROM totals"""


def _stage_rows(interval: str, stages: tuple[str, ...], extra: str = "") -> str:
    listed = ", ".join(f"({i}, '{stage}')" for i, stage in enumerate(stages))
    return f"""{_EVENTS}, stages(step, stage) AS (VALUES {listed}),
    counted AS (
        SELECT step, stage, count(b.event_id) AS n
        FROM stages LEFT JOIN (SELECT * FROM bound WHERE {_since(interval)} {extra}) b
        ON b.event_type = stages.stage
        GROUP BY step, stage),
    chained AS (
        SELECT *, lag(n) OVER (ORDER BY step) AS before,
               first_value(n) OVER (ORDER BY step) AS first_n,
               last_value(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING
                                   AND UNBOUNDED FOLLOWING) AS last_n
        FROM counted)"""


def _funnel(interval: str, stages: tuple[str, ...], extra: str = "") -> str:
    return f"""{_stage_rows(interval, stages, extra)}
    SELECT stage, n AS "count",
           CASE WHEN step = 0 THEN NULL
                WHEN before > 0 THEN round_even(100.0::DOUBLE * n / before, 2)
                ELSE 0.0 END AS drop_off_pct,
           CASE WHEN first_n > 0 THEN round_even(100.0::DOUBLE * last_n / first_n, 2)
                ELSE 0.0 END AS overall_cvr_pct
    FROM chained"""


def _timeseries(interval: str, bucket: str, extra: str = "") -> str:
    return f"""{_EVENTS}
    SELECT {_ISO.format(f"date_trunc('{bucket}', ts)")} AS bucket, event_type,
           count(*) AS cnt, {_REVENUE} AS revenue
    FROM bound WHERE {_since(interval)} {extra} GROUP BY 1, 2"""


def _sales(keys: str) -> str:
    return f"""{_EVENTS}, sales AS (
    SELECT {keys}, {_STAGES}, {_REVENUE} AS revenue
    FROM bound WHERE {_since('30 DAY')} GROUP BY {keys})"""


def _top_products(by: str, limit: int = 10) -> str:
    return f"""{_sales('product_id, category')}
    SELECT *, {_CVR} AS cvr_pct FROM sales
    ORDER BY {by} DESC, product_id, category LIMIT {limit}"""


_CATEGORIES = f"""{_sales('category')}, categories AS (
    SELECT *, {_CVR} AS cvr_pct, {_aov('revenue')} AS aov FROM sales)"""

_USER_TOTALS = f"""count(*) AS total_events, {_STAGES}, {_REVENUE} AS total_spent,
    count(DISTINCT product_id) AS unique_products_viewed,
    {_ISO.format('min(ts)')} AS first_seen, {_ISO.format('max(ts)')} AS last_seen"""


def _revenue(interval: str, bucket: str) -> str:
    return f"""{_EVENTS}, buckets AS (
    SELECT date_trunc('{bucket}', ts) AS b, count(*) AS orders, {_MONEY} AS revenue
    FROM bound WHERE event_type = 'purchase' AND {_since(interval)} GROUP BY 1)
    SELECT {_ISO.format('b')} AS bucket, orders, revenue, revenue / orders AS aov FROM buckets"""


_LIVE = f"""{_EVENTS}, live AS (
    SELECT date_trunc('minute', ts) AS b, {_STAGES}, count(*) AS total
    FROM bound WHERE {_since('2 MINUTE')} GROUP BY 1)"""

_LOG = f"""event_id, event_type, user_id, product_id, price, {_ISO.format('ts')} AS timestamp,
    category, ip_address"""


def _page(extra: str = "", limit: int = 20, offset: int = 20) -> str:
    return f"""{_EVENTS}, page AS (
    SELECT * FROM bound WHERE {_since('30 DAY')} {extra}
    ORDER BY ts DESC, event_id LIMIT {limit} OFFSET {offset})"""


_WHOLE_TABLE = f"{_EVENTS} SELECT {_LOG} FROM bound"

_STAGE_TUPLE = ("view", "click", "add_to_cart", "purchase")
_FIXTURE_TUPLE = ("view", "click", "signup", "purchase")

ORACLE: dict[str, str] = {
    "overview_24h": _overview("24 HOUR"),
    "overview_30d": _overview("30 DAY"),
    "window_counts": f"""{_EVENTS}, windows(name, hours) AS (
        VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168), ('30d', 720))
        SELECT name AS "window", count(*) AS total_events, {_REVENUE} AS revenue
        FROM windows JOIN bound ON ts >= (SELECT as_of FROM clock) - to_hours(hours)
        GROUP BY name""",
    "funnel_30d": _funnel("30 DAY", _STAGE_TUPLE),
    "funnel_custom_7d": _funnel("7 DAY", _FIXTURE_TUPLE),
    "funnel_category_30d": _funnel("30 DAY", _STAGE_TUPLE, "AND category = 'promo'"),
    "timeseries_hour_24h": _timeseries("24 HOUR", "hour"),
    "timeseries_day_30d": _timeseries("30 DAY", "day"),
    "timeseries_click_minute_6h": _timeseries("6 HOUR", "minute", "AND event_type = 'click'"),
    "top_products_revenue": _top_products("revenue"),
    "top_products_views": _top_products("views"),
    "top_products_purchases": _top_products("purchases"),
    "top_categories_30d": f"{_CATEGORIES} SELECT * FROM categories ORDER BY revenue DESC, category",
    "user_summary_u42": f"""{_EVENTS}
        SELECT {_USER_TOTALS} FROM bound
        WHERE user_id = 'u_42' AND {_since('7 DAY')} HAVING count(*) > 0""",
    "user_events_u42": f"""{_EVENTS}
        SELECT event_id, event_type, product_id, price, {_ISO.format('ts')} AS timestamp, category
        FROM bound WHERE user_id = 'u_42' AND {_since('7 DAY')} ORDER BY ts, event_id LIMIT 200""",
    "user_events_limited": f"""{_EVENTS}
        SELECT event_id, event_type, product_id, price, {_ISO.format('ts')} AS timestamp, category
        FROM bound WHERE user_id = 'u_42' AND {_since('30 DAY')} ORDER BY ts, event_id LIMIT 5""",
    "user_summaries_30d": f"""{_EVENTS}
        SELECT user_id, {_USER_TOTALS} FROM bound WHERE {_since('30 DAY')} GROUP BY user_id""",
    "revenue_hour_7d": _revenue("7 DAY", "hour"),
    "revenue_day_30d": _revenue("30 DAY", "day"),
    "revenue_totals_30d": f"""{_EVENTS}, totals AS (
        SELECT count(*) AS total_orders, {_MONEY} AS total
        FROM bound WHERE event_type = 'purchase' AND {_since('30 DAY')})
        SELECT round_even(total, 2) AS total_revenue, total_orders,
               CASE WHEN total_orders > 0 THEN round_even(total / total_orders, 2)
                    ELSE 0.0 END AS overall_aov
        FROM totals""",
    "realtime": f"""{_LIVE}
        SELECT {_ISO.format('b')} AS bucket, views, clicks, carts, purchases, total FROM live""",
    "realtime_bounded": f"""{_EVENTS}, past AS (
        SELECT max(ts) AS moment FROM bound WHERE ts < (SELECT as_of - INTERVAL 1 HOUR FROM clock)),
        live AS (
            SELECT date_trunc('minute', ts) AS b, {_STAGES}, count(*) AS total FROM bound, past
            WHERE ts >= moment - INTERVAL 2 MINUTE AND ts <= moment GROUP BY 1)
        SELECT {_ISO.format('b')} AS bucket, views, clicks, carts, purchases, total FROM live""",
    "events_per_sec": f"""{_LIVE}
        SELECT coalesce(round_even(arg_max(total, b) / 60.0::DOUBLE, 2), 0.0) AS events_per_sec
        FROM live""",
    "events_page": f"{_page()} SELECT {_LOG} FROM page",
    "events_deep_page": f"{_page(limit=50, offset=5000)} SELECT {_LOG} FROM page",
    "events_deep_page_null_ids": f"""{_EVENTS}, page AS (
        SELECT * REPLACE (CASE WHEN event_id::BIGINT % 3 <> 0 THEN event_id END AS event_id) FROM bound
        WHERE {_since('30 DAY')}
        ORDER BY ts DESC, 1 NULLS FIRST, user_id, product_id, event_type, price, category LIMIT 50 OFFSET 5000)
        SELECT {_LOG} FROM page""",
    "events_hot_second": f"""{_EVENTS}, page AS (
        SELECT * REPLACE ('evt-2024-' || event_id AS event_id,
                          CASE WHEN event_id::BIGINT % 2 = 0 THEN TIMESTAMP '2024-01-20 12:00:00' ELSE ts END AS ts)
        FROM bound WHERE {_since('30 DAY')}),
        sorted AS (SELECT * FROM page ORDER BY ts DESC, event_id LIMIT 50 OFFSET 4000)
        SELECT {_LOG} FROM sorted""",
    "revenue_large_amounts": f"""{_EVENTS}, sales AS (
        SELECT category, {_STAGES}, CAST(coalesce(sum(CAST(round(price * 100) AS BIGINT) * 10000)
               FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS revenue
        FROM bound WHERE {_since('30 DAY')} GROUP BY category)
        SELECT *, {_CVR} AS cvr_pct, {_aov('revenue')} AS aov FROM sales""",
    "events_filtered": f"""{_page("AND event_type = 'purchase' AND user_id = 'u_42'", 50, 0)}
        SELECT {_LOG} FROM page""",
    "event_total": "SELECT count(*) AS total_events FROM events",
    "timeseries_pivot": f"""{_EVENTS}
        SELECT {_ISO.format("date_trunc('hour', ts)")} AS bucket,
               count(*) FILTER (event_type = 'view') AS "view",
               count(*) FILTER (event_type = 'click') AS click,
               count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart,
               count(*) FILTER (event_type = 'purchase') AS purchase
        FROM bound WHERE {_since('7 DAY')} GROUP BY 1""",
    "funnel_share": f"""{_stage_rows('30 DAY', _FIXTURE_TUPLE)}
        SELECT stage, n AS "count", n / greatest(first_n, 1) * 100 AS share_pct
        FROM chained""",
    "product_share": f"""{_sales('product_id, category')}, top AS (
        SELECT *, {_CVR} AS cvr_pct FROM sales
        ORDER BY revenue DESC, product_id, category LIMIT 8),
        best AS (SELECT max(revenue) AS revenue FROM top)
        SELECT top.*, CASE WHEN best.revenue > 0
               THEN least(top.revenue / best.revenue * 100, 100.0)
               ELSE 0.0 END AS share_pct
        FROM top, best""",
    "category_share": f"""{_CATEGORIES}, best AS (SELECT max(revenue) AS revenue FROM categories)
        SELECT categories.*, CASE WHEN best.revenue > 0
               THEN categories.revenue / best.revenue * 100
               ELSE 0.0 END AS share_pct
        FROM categories, best""",
    "category_profile": f"""{_CATEGORIES}
        SELECT category, views, purchases, cvr_pct AS cvr, revenue, aov FROM categories""",
    "cvr_bands": f"""{_CATEGORIES}
        SELECT category, cvr_pct, CASE WHEN cvr_pct >= 3 THEN 'good'
               WHEN cvr_pct >= 1 THEN 'fair' ELSE 'poor' END AS band
        FROM categories""",
    "events_page_info": f"""{_page()}
        SELECT CAST(21 AS BIGINT) AS first_row, 20 + count(*) AS last_row,
               count(*) AS row_count, count(*) = 20 AS has_next
        FROM page""",
    "events_priced": f"""{_page()}
        SELECT event_id, event_type, {_ISO.format('ts')} AS timestamp,
               CASE WHEN event_type = 'purchase' THEN price END AS shown_price
        FROM page""",
    "last_minute_total": f"""{_LIVE}
        SELECT coalesce(arg_max(total, b), 0) AS last_minute_total FROM live""",
    "decode_normalize": _WHOLE_TABLE,
    "malformed_split": """
        SELECT 'valid' AS part, count(*) AS row_count, count(*) AS with_id,
               CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) AS price
        FROM events WHERE event_type NOT IN ('error', 'signup')
        UNION ALL
        SELECT 'malformed', count(*), count(*) FILTER (event_type = 'signup'),
               CAST(coalesce(sum(CAST(value AS DECIMAL(18,2)))
                    FILTER (event_type = 'signup'), 0) AS DOUBLE)
        FROM events WHERE event_type IN ('error', 'signup')""",
    "table_roundtrip_month": f"""{_EVENTS}
        SELECT count(*) AS event_count, {_MONEY} AS price,
               {_ISO.format('min(ts)')} AS first_seen, {_ISO.format('max(ts)')} AS last_seen
        FROM bound
        WHERE date_trunc('month', ts) = (SELECT date_trunc('month', as_of) FROM clock)""",
    "folded_month": _WHOLE_TABLE,
    "ingest_stream": _WHOLE_TABLE,
    "quarantine_stream": """
        SELECT CASE WHEN event_type IN ('error', 'signup', 'click') THEN 'malformed' ELSE 'stored' END AS part,
               event_type, CAST(event_id AS VARCHAR) AS event_id
        FROM events""",
    "recovery_stream": _WHOLE_TABLE,
    "batch_counts": """
        SELECT CASE WHEN value < 50 THEN 0 ELSE 1 END::BIGINT AS batch_id, count(*) AS row_count
        FROM events GROUP BY 1""",
    "rate_capped_ingest": """
        SELECT count(*) AS row_count, TRUE AS batches_as_capped, TRUE AS several_batches FROM events""",
    "dedup_stream": _WHOLE_TABLE,
    "unique_ingest": _WHOLE_TABLE,
    "table_by_name": _WHOLE_TABLE,
    "live_minutes": f"""{_EVENTS}
        SELECT {_ISO.format("date_trunc('minute', ts)")} AS bucket, {_STAGES}, count(*) AS total
        FROM bound GROUP BY 1""",
    "running_funnel": f"""{_EVENTS}, totals AS (SELECT {_STAGES} FROM bound)
        SELECT *, purchases / greatest(views, 1) * 100 AS cvr_pct FROM totals""",
}

# The same questions to the stored table of two months.
_STORED = _EVENTS.replace("WITH bound AS (", "WITH present AS (").replace(
    "clock AS (",
    "bound AS (SELECT * FROM present UNION ALL SELECT * REPLACE ("
    "'old-' || event_id AS event_id, ts - INTERVAL 30 DAY AS ts) FROM present),\nclock AS (",
)

for _report, _same in {
    "events": "events_page", "overview": "overview_30d", "funnel": "funnel_30d",
    "timeseries": "timeseries_hour_24h", "top_products": "top_products_revenue", "top_categories": "top_categories_30d",
    "user_summary": "user_summary_u42", "user_events": "user_events_u42", "users": "user_summaries_30d",
    "revenue": "revenue_hour_7d", "revenue_totals": "revenue_totals_30d", "realtime": "realtime",
}.items():
    ORACLE[f"report_{_report}"] = ORACLE[_same].replace(_EVENTS, _STORED)
ORACLE["report_health"] = f"{_STORED} SELECT count(*) AS total_events FROM bound"

# The same rows, from a table with a rollup.
ORACLE |= {f"rollup_{rolled}": ORACLE[plain] for rolled, plain in {
    "overview": "overview_30d", "overview_24h": "overview_24h", "timeseries": "timeseries_hour_24h",
    "funnel": "funnel_category_30d", "top_categories": "top_categories_30d", "revenue": "revenue_day_30d",
}.items()}
ORACLE |= {"user_layout_summaries": ORACLE["user_summaries_30d"], "user_layout_events": ORACLE["user_events_limited"]}
ORACLE["rollup_distinct"] = f"""{_EVENTS}, past AS (
        SELECT max(ts) AS moment FROM bound WHERE ts < (SELECT as_of - INTERVAL '7 hours 13 minutes' FROM clock)),
    windows("window", hours) AS (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168), ('30d', 720))
    SELECT "window", count(DISTINCT user_id) AS unique_users
    FROM past, windows LEFT JOIN bound ON ts >= (SELECT moment FROM past) - to_hours(hours) AND ts <= (SELECT moment FROM past)
    GROUP BY 1"""

_BATCHES = f"""{_EVENTS}, numbered AS (
        SELECT *, CASE WHEN event_id::BIGINT % 53 = 0 THEN 3
                       WHEN event_id::BIGINT % 11 = 0 THEN least((day(ts) - 1) // 8 + 1, 3)
                       ELSE (day(ts) - 1) // 8 END AS batch
        FROM bound)"""

ORACLE["final_minutes"] = f"""{_BATCHES}, passed AS (
        SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 60 MINUTE AS mark FROM numbered GROUP BY batch),
    judged AS (
        SELECT n.*, date_trunc('minute', ts) AS b, coalesce(date_trunc('minute', ts) + INTERVAL 1 MINUTE <= mark, false) AS late
        FROM numbered n LEFT JOIN passed p ON p.batch = n.batch - 1)
    SELECT CASE WHEN late THEN 'late' ELSE 'final' END AS part, {_ISO.format('b')} AS bucket, {_STAGES}, count(*) AS total
    FROM judged WHERE late OR b + INTERVAL 1 MINUTE <= (SELECT max(mark) FROM passed) GROUP BY 1, 2"""

_JOURNEY = ("signup", "view", "click", "purchase")
ORACLE["journey_funnel"] = f"""{_EVENTS}, scopes("when", upto) AS (
        SELECT 'at the end', as_of FROM clock UNION ALL SELECT 'before', as_of - INTERVAL 25 DAY FROM clock),
    steps AS (
        SELECT "when", user_id, ts, list_position({list(_JOURNEY)}, event_type) - 1 AS step
        FROM bound JOIN scopes ON ts <= upto WHERE event_type IN {_JOURNEY}),
    gaps AS (
        SELECT *, ts - lag(ts) OVER (PARTITION BY "when", user_id ORDER BY ts, step) > INTERVAL 72 HOUR AS anew FROM steps),
    walks AS (
        SELECT *, coalesce(sum(anew::INT) OVER (PARTITION BY "when", user_id ORDER BY ts, step ROWS UNBOUNDED PRECEDING), 0)
                  AS walk
        FROM gaps),
    s0 AS (SELECT "when", user_id, walk, min(ts) AS t FROM walks WHERE step = 0 GROUP BY ALL),
    {", ".join(f"""s{k} AS (
        SELECT "when", user_id, walk, min(w.ts) AS t FROM walks w JOIN s{k - 1} USING ("when", user_id, walk)
        WHERE step = {k} AND w.ts >= t GROUP BY ALL)""" for k in (1, 2, 3))},
    reached AS ({" UNION ALL ".join(f"""SELECT "when", '{stage}' AS stage, count(*) AS n FROM s{k} GROUP BY ALL"""
                                      for k, stage in enumerate(_JOURNEY))})
    SELECT "when", stage, coalesce(n, 0) AS reached
    FROM scopes CROSS JOIN (SELECT unnest({list(_JOURNEY)}) AS stage) LEFT JOIN reached USING ("when", stage)"""

ORACLE["events_keyset_pages"] = f"""{_EVENTS}, changed AS (
        SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN 'evt-2024-' || event_id END AS event_id, '' AS category,
                          CASE WHEN event_id::BIGINT % 2 = 0 THEN TIMESTAMP '2024-01-20 12:00:00' ELSE ts END AS ts)
        FROM bound),
    repeated AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE price < 5),
    placed AS (
        SELECT *, row_number() OVER (ORDER BY ts DESC, event_id NULLS FIRST, user_id, product_id, event_type, price) AS k
        FROM repeated WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND {_since('30 DAY')}),
    pages(page, low, high) AS (VALUES ('first', 1, 40), ('next', 41, 80), ('back', 1, 40))
    SELECT {_LOG}, page FROM placed JOIN pages ON k BETWEEN low AND high"""

ORACLE["progress_table"] = f"SELECT batch_id, row_count, true AS timed FROM ({ORACLE['batch_counts'].strip().rstrip(';')})"
ORACLE["offset_audit"] = """
    WITH sent AS (
        SELECT event_id AS number, (event_id % 3)::INT AS "partition", event_id // 3 AS place,
               CASE WHEN event_id % 1000 BETWEEN 415 AND 460 THEN 2 ELSE 1 END AS times
        FROM events WHERE NOT (event_id % 1000 BETWEEN 400 AND 420 OR event_id % 70 = 3)),
    spans AS (SELECT "partition", min(place) AS low, max(place) AS high FROM sent GROUP BY 1),
    places AS (SELECT "partition", unnest(range(low, high + 1)) AS place FROM spans),
    counted AS (
        SELECT p."partition", p.place, coalesce(s.times, 0) AS times
        FROM places p LEFT JOIN sent s ON s."partition" = p."partition" AND s.place = p.place),
    odd AS (
        SELECT *, place - row_number() OVER (PARTITION BY "partition", times ORDER BY place) AS island
        FROM counted WHERE times <> 1)
    SELECT 'events' AS topic, "partition", CASE times WHEN 0 THEN 'lost' ELSE 'doubled' END AS kind,
           min(place) AS first, max(place) AS last, times::BIGINT AS times
    FROM odd GROUP BY "partition", times, island"""
