"""The stored table: layout, replacement of batches, pruning."""

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from events import AS_OF, SCHEMA
from pyspark.sql import functions as F

from clickloom.operators import log, metrics
from clickloom.sources import table
from clickloom.sources.scratch import fresh_folder, shared_root
from clickloom.vocabulary import EVENT_COLUMNS


def months_of_events(spark, n=3000):
    rows = [
        (f"e{i}", "purchase" if i % 5 == 0 else "view", f"u_{i % 17}", f"p_{i % 7}", i / 100,
         AS_OF - timedelta(hours=i, seconds=i % 3), "c", "")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def stored(spark):
    path = fresh_folder(spark, "stored")
    table.write_events(months_of_events(spark), path, "load")
    return path


def files(path):
    return sorted(Path(path).glob("**/*.parquet"))


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, stored):
    events = table.read_events(spark, stored)
    assert tuple(events.columns) == EVENT_COLUMNS
    wanted = months_of_events(spark).orderBy("event_id").collect()
    assert events.orderBy("event_id").collect() == wanted


def test_files_are_in_table_order_and_carry_time_statistics(stored):
    assert {p.relative_to(stored).parts[0] for p in files(stored)} == {
        "event_month=202312", "event_month=202401", "event_month=202402", "event_month=202403",
        "event_month=202404", "event_month=202405",
    }
    for p in files(stored):
        parquet = pq.ParquetFile(p)
        rows = parquet.read(columns=["timestamp", "user_id"]).to_pylist()
        keys = [(r["timestamp"], r["user_id"]) for r in rows]
        assert keys == sorted(keys)
        at = parquet.schema_arrow.get_field_index("timestamp")
        assert parquet.metadata.row_group(0).column(at).statistics.has_min_max


def test_zoned_times_are_stored_as_utc(spark, make_events):
    path = fresh_folder(spark, "zoned")
    zoned = make_events([("a", "view", "u", "p", 1, 0)], zoned=True)
    table.write_events(zoned, path, "load")
    assert table.read_events(spark, path).first().timestamp == AS_OF
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            table.write_events(zoned, path, "load")
        assert table.read_events(spark, path).first().timestamp == AS_OF
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_batch_written_again_replaces_itself_only(spark):
    path = fresh_folder(spark, "again")
    events = months_of_events(spark, 800)
    for ingest, batch in (("one", 0), ("one", 1), ("two", 0)):
        table.write_events(events, path, ingest, batch)
    before = len(files(path))
    table.write_events(events, path, "one", 1)
    assert len(files(path)) == before
    counts = {(r.ingest_id, r.batch_id): r.row_count for r in table.batch_counts(spark, path).collect()}
    assert counts == {("one", 0): 800, ("one", 1): 800, ("two", 0): 800}


def test_an_empty_batch_writes_nothing(spark):
    path = fresh_folder(spark, "empty")
    table.write_events(months_of_events(spark, 50), path, "load", 0)
    before = files(path)
    table.write_events(months_of_events(spark, 50).where("false"), path, "load", 1)
    assert files(path) == before


def test_range_and_window_reads(spark, stored):
    whole = table.read_events(spark, stored)
    start, end = datetime(2024, 3, 3, 5), datetime(2024, 4, 1)
    wanted = whole.where((F.col("timestamp") >= F.lit("2024-03-03 05:00:00").cast("timestamp_ntz"))
                         & (F.col("timestamp") <= F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"))).count()
    assert table.read_events(spark, stored, start, end).count() == wanted > 0
    for window in ("1h", "24h", "30d"):
        pruned = table.read_window(spark, stored, window, AS_OF)
        assert metrics.overview(pruned, window, AS_OF).collect() == metrics.overview(whole, window, AS_OF).collect()


def test_month_and_row_groups_are_pruned(spark, stored):
    events = table.read_window(spark, stored, "7d", AS_OF)
    plan = executed(log.user_summary(events, "u_3", "7d", AS_OF))
    assert "PartitionFilters: [isnotnull(event_month" in plan and ">= 202404)" in plan
    assert "GreaterThanOrEqual(timestamp," in plan
    assert "EqualTo(user_id,u_3)" in plan
    assert "ip_address" not in plan.split("ReadSchema")[1]


def test_now_prunes_as_well(spark, stored):
    plan = executed(metrics.overview(table.read_window(spark, stored, "24h"), "24h"))
    assert "event_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(timestamp," in plan


def test_create_is_idempotent_and_finds_the_partitions(spark, stored):
    for _ in range(2):
        table.create_events_table(spark, "stored_events", stored)
    assert spark.table("stored_events").count() == 3000
    assert spark.table("stored_events").where("event_month = 202404").count() == table.read_events(
        spark, stored, datetime(2024, 4, 1), datetime(2024, 4, 30, 23, 59, 59)).count()


def test_reading_by_name_prunes_in_the_catalog(spark, stored):
    table.create_events_table(spark, "named_events", stored)
    by_name = table.read_window(spark, None, "7d", AS_OF, name="named_events")
    by_folder = table.read_window(spark, stored, "7d", AS_OF)
    assert sorted(by_name.collect()) == sorted(by_folder.collect())
    assert "PartitionFilters: [isnotnull(event_month" in executed(by_name)


def test_closed_months_can_be_folded_into_fewer_batches(spark):
    path, folded = fresh_folder(spark, "many"), fresh_folder(spark, "folded")
    events = months_of_events(spark, 1200)
    for batch in range(6):
        table.write_events(events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == batch), path, "stream", batch)
    table.write_events(table.read_events(spark, path), folded, "folded")
    assert len(files(folded)) < len(files(path))
    assert sorted(table.read_events(spark, folded).collect()) == sorted(events.collect())


def test_a_crowded_hour_is_split_over_files(spark):
    path = fresh_folder(spark, "crowded")
    crowd = spark.range(0, 8000, 1, numPartitions=8).selectExpr(
        "cast(id AS STRING) AS event_id", "'view' AS event_type", "'u_1' AS user_id", "'p_1' AS product_id",
        "1.0D AS price", "timestamp_ntz'2024-05-01 12:00:00' AS timestamp", "'c' AS category", "uuid() AS ip_address",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32KB")
    try:
        table.write_events(crowd, path, "load")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table.read_events(spark, path).count() == 8000
    assert len(files(path)) > 2


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root
    a, b = fresh_folder(spark, "x"), fresh_folder(spark, "x")
    assert a != b and a.startswith(root) and not Path(a).exists()
