"""Deep pages against slices of the whole sorted log."""

import random
from datetime import timedelta

import pytest
from events import AS_OF, SCHEMA
from pyspark.sql import functions as F

from clickloom.operators import log


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the rows share one second; ids differ late, and some rows are equal."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        second = 500 if rng.random() < 0.34 else rng.randrange(1, 900)
        event_id = rng.choice(["", "abcd", "evt-", f"{rng.randrange(99999):05d}"]) + str(rng.randrange(2000)) if rng.random() < 0.7 else None
        rows.append((event_id, "view", f"u_{i}", "p", 1.0, AS_OF - timedelta(seconds=second), "c", "ip"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def keys(frame):
    return [(str(r.timestamp).replace("T", " "), r.event_id, r.user_id) for r in frame.collect()]


@pytest.mark.parametrize("offset,limit", [(0, 7), (480, 40), (505, 3), (700, 400), (999, 1), (1490, 50), (1500, 5), (9000, 5)])
def test_deep_page_is_a_slice(crowded, offset, limit):
    whole = keys(crowded.orderBy(F.desc("timestamp"), "event_id", "user_id"))
    assert keys(log.deep_page(crowded, limit, offset)) == whole[offset:offset + limit]


def test_limits_are_checked(crowded):
    for limit, offset in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            log.deep_page(crowded, limit, offset)


@pytest.mark.parametrize("make_id", ["concat('evt-2024-', lpad(id, 9, '0'))", "repeat('x', id % 3000)", "'same'", "NULL"])
def test_a_crowded_second_is_split_whatever_its_ids(spark, monkeypatch, make_id):
    monkeypatch.setattr(log, "RARELY", 16)
    frame = spark.range(3000).select(
        F.expr(make_id).cast("string").alias("event_id"), F.lit("view").alias("event_type"),
        F.expr("concat('u_', lpad(id % 2900, 5, '0'))").alias("user_id"), F.lit("p").alias("product_id"),
        F.lit(1.0).alias("price"), F.lit(AS_OF).cast("timestamp_ntz").alias("timestamp"), F.lit("c").alias("category"),
        F.lit("ip").alias("ip_address"),
    )
    whole = keys(frame.orderBy("event_id", "user_id"))
    assert keys(log.deep_page(frame, 10, 2500)) == whole[2500:2510]
    assert keys(log.deep_page(frame, 1000, 1700)) == whole[1700:2700]


def test_copies_of_one_event_fill_pages(spark):
    row = ("e", "view", "u", "p", 1.0, AS_OF, "c", "ip")
    frame = spark.createDataFrame([row] * 2000 + [(None, *row[1:])], SCHEMA)
    assert len(keys(log.deep_page(frame, 1000, 1500))) == 501
    assert keys(log.deep_page(frame, 2, 0)) == [(str(AS_OF), None, "u"), (str(AS_OF), "e", "u")]


def test_events_without_a_time_come_last(spark):
    rows = [(f"e{i}", "view", "u", "p", 1.0, AS_OF if i % 2 else None, "c", "ip") for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = keys(frame.orderBy(F.desc("timestamp"), "event_id"))
    assert keys(log.deep_page(frame, 40, 30)) == whole[30:70]


def test_list_events_switches_over(crowded, monkeypatch):
    plain = log.list_events(crowded, 30, 600, as_of=AS_OF).collect()
    monkeypatch.setattr(log, "TOP_LIST_ROWS", 100)
    deep = log.list_events(crowded, 30, 600, as_of=AS_OF)
    assert deep.collect() == plain
    assert deep.columns == log.list_events(crowded, as_of=AS_OF).columns
