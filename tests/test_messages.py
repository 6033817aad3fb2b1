"""Decoding, normalising and setting malformed messages aside."""

from datetime import datetime

import pytest
from events import AS_OF

from clickloom.sources.messages import decode, encode, normalize, split_malformed
from clickloom.vocabulary import EVENT_COLUMNS

FULL = (
    '{"event_id":"a","event_type":"view","user_id":"u_1","persona":"browser","product_id":"p_7",'
    '"category":"books","product_tier":"niche","price":129.99,'
    '"timestamp":"2024-01-01T02:00:01.987654+02:00","ip_address":"192.168.3.7"}'
)
MESSAGES = [
    FULL,
    "not json",
    None,
    '{"event_id":"b","price":"oops","timestamp":"bad"}',
    '{"event_id":7,"timestamp":"2024-01-01T00:00:00+00:00"}',
    '{"timestamp":"2024-01-01T00:00:00+00:00","price":2}',
    "{}",
    "[1]",
    "",
    '{"event_id":"cut',
]
EMPTY = ("", "", "", "", 0.0, datetime(1970, 1, 1), "", "")


@pytest.fixture(scope="module")
def decoded(spark):
    return decode(spark.createDataFrame([(m,) for m in MESSAGES], "value STRING"))


def test_columns_and_dropped_fields(decoded):
    assert tuple(decoded.columns) == EVENT_COLUMNS
    first = decoded.first()
    assert first.timestamp == datetime(2024, 1, 1, 0, 0, 1, 987654)
    assert (first.event_id, first.price, first.ip_address) == ("a", 129.99, "192.168.3.7")


def test_bytes_decode_like_text(spark, decoded):
    as_bytes = decode(spark.createDataFrame([(FULL.encode(),)], "value BINARY"))
    assert as_bytes.first() == decoded.first()


def test_normalised_rows_keep_every_message(decoded):
    rows = [tuple(r) for r in normalize(decoded).collect()]
    assert len(rows) == len(MESSAGES)
    assert rows[0] == ("a", "view", "u_1", "p_7", 129.99, datetime(2024, 1, 1, 0, 0, 1), "books", "192.168.3.7")
    assert rows[1] == rows[2] == rows[6] == rows[8] == EMPTY
    assert rows[3] == ("b", "", "", "", 0.0, datetime(1970, 1, 1), "", "")
    assert rows[4][0] == "7"
    assert rows[5][4:6] == (2.0, datetime(2024, 1, 1))


def test_split_loses_nothing(decoded):
    valid, malformed = split_malformed(decoded)
    assert [r.event_id for r in valid.collect()] == ["a", "7"]
    assert valid.count() + malformed.count() == len(MESSAGES)


def test_encode_then_decode_is_the_same(make_events):
    events = make_events([("a", "view", "u_1", "p_1", 0.1, 3, "bo\"oks"), ("b", "purchase", "", "p", -0.0, 0)], zoned=True)
    assert decode(encode(events)).collect() == events.collect()
    assert events.first().timestamp < AS_OF
