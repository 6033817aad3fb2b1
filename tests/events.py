"""The event schema and time that the tests share."""

from datetime import datetime

AS_OF = datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = (
    "event_id STRING, event_type STRING, user_id STRING, product_id STRING, "
    "price DOUBLE, timestamp TIMESTAMP_NTZ, category STRING, ip_address STRING"
)
