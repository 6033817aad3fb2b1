"""What must not grow with the input: rows through one task, bitmaps from every task, broadcasts of users and parts."""

from datetime import datetime, timedelta

from events import SCHEMA
from pyspark.sql import functions as F

from clickloom.functions.times import month_key
from clickloom.operators.rolled import Stitched
from clickloom.plans import registered
from clickloom.sources import ids
from clickloom.sources.fixtures import fixture_events
from clickloom.sources.messages import encode
from clickloom.sources.rollup import roll_up
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.sources.table import read_table, write_events
from clickloom.streaming.pipeline import start_ingest

BEGIN = datetime(2024, 5, 1, 8)


def events_of(spark, n):
    rows = [(f"e{i}", "view", f"u{i % 50}", "p", 1.0, BEGIN + timedelta(minutes=i), "c", "") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def raw_tables(spark):
    folder = fresh_folder(spark, "raw")
    spark.range(4000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-05-01 08:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "1.0D AS value", """concat('{"k": ', id % 5, '}') AS props""",
    ).write.parquet(f"{folder}/events.parquet")
    spark.range(5).selectExpr("id AS p_partkey", "'A' AS p_type").write.parquet(f"{folder}/part.parquet")
    return folder


def test_messages_are_written_by_many_tasks(spark, monkeypatch):
    folder = raw_tables(spark)
    assert registered._files_a_batch(spark, folder) == 1
    monkeypatch.setattr(registered, "_BYTES_A_FILE", 4096)
    files = registered._files_a_batch(spark, folder)
    assert files > 2
    dealt = registered._dealt(fixture_events(spark, folder, with_category=False), files)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == files and sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 8000 / files


def test_state_partitions_are_rebalanced_when_written(spark):
    folder, told = fresh_folder(spark, "t"), []
    for _ in range(2):
        encode(events_of(spark, 500)).coalesce(1).write.mode("append").text(f"{folder}/in")
    start_ingest(
        read_message_files(spark, f"{folder}/in", max_files_per_trigger=1), f"{folder}/table", f"{folder}/checkpoint",
        every=None, unique_within="10 minutes", on_batch=lambda number, rows: told.append(rows),
    ).awaitTermination()
    stored = read_table(spark, f"{folder}/table")
    assert stored.count() == 500 and told[0] == 500 and sum(told) == 500
    # Not one for each partition of the state, whatever its size.
    assert stored.select("_metadata.file_path").distinct().count() == 1


def test_bitmaps_of_ids_are_made_after_the_shuffle(spark):
    months = events_of(spark, 300).select("event_id", month_key(F.col("timestamp")).alias("event_month"))
    steps = plan(ids._filters(months)).split("\n")
    final, partial = (i for i, line in enumerate(steps) if "bitmap_construct_agg" in line and "Aggregate" in line)
    assert not any("Exchange" in line for line in steps[final:partial]), steps


def test_users_and_parts_are_not_broadcast(spark):
    folder = fresh_folder(spark, "t")
    write_events(events_of(spark, 300), f"{folder}/table", "a")
    roll_up(events_of(spark, 300), f"{folder}/rollup", "a")
    users = Stitched(spark, f"{folder}/table", f"{folder}/rollup", "24h", as_of=BEGIN + timedelta(minutes=290)).users()
    assert "SortMergeJoin" in plan(users) and "Broadcast" not in plan(users)
    events = fixture_events(spark, raw_tables(spark), merged=True)
    assert "SortMergeJoin" in plan(events) and "Broadcast" not in plan(events)
