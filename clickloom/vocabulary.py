"""Names and fixed values the rest of the package agrees on, and the checks for them."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# The event message and the stored row share these eight fields, in this order.
EVENT_DDL = (
    "event_id STRING, event_type STRING, user_id STRING, product_id STRING, "
    "price DOUBLE, timestamp TIMESTAMP, category STRING, ip_address STRING"
)
EVENT_COLUMNS = (
    "event_id", "event_type", "user_id", "product_id",
    "price", "timestamp", "category", "ip_address",
)

# Funnel order, and the column each stage is counted under.
STAGES = ("view", "click", "add_to_cart", "purchase")
STAGE_COLUMNS = {"views": "view", "clicks": "click", "carts": "add_to_cart", "purchases": "purchase"}
PURCHASE = "purchase"

# Relative windows, in hours.
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 7 * 24, "30d": 30 * 24}
LIVE_MINUTES = 2

BUCKETS = ("minute", "hour", "day")
RANK_BY = ("views", "purchases", "revenue")

LOG_LIMIT = (1, 1000)
TOP_LIMIT = (1, 100)
JOURNEY_LIMIT = 200


# --- argument checks --------------------------------------------------------

def one_of(name: str, value: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")
    return value


def in_range(name: str, value: int, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    if value < low or (high is not None and value > high):
        span = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{name} must be {span}, not {value}")
    return value
