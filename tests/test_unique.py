"""Events stored once however far apart their copies arrive: filters, folds, replays, ids that are none."""

from datetime import datetime, timedelta

import pytest
from events import SCHEMA
from pyspark.sql import functions as F

from clickloom.sources import ids
from clickloom.sources.folding import drop_folded, fold_month
from clickloom.sources.messages import encode
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.sources.table import read_events, write_events
from clickloom.streaming.pipeline import start_ingest

BEGIN = datetime(2024, 4, 30, 20)


def events_of(spark, numbers, change=""):
    rows = [
        (None if n < 0 else f"e{n}{change}", "view", "u", "p", 1.0, BEGIN + timedelta(minutes=abs(n)), "c", "") for n in numbers
    ]
    return spark.createDataFrame(rows, SCHEMA)


def add(spark, folder, batch, events):
    with ids.without_copies(events, folder, "a", batch) as fresh:
        write_events(fresh, folder, "a", batch)
    ids.write_filter(ids.batch_rows(spark, folder, "a", batch), folder, "a", batch)


def stored(spark, folder):
    return sorted(r.event_id or "" for r in read_events(spark, folder).select("event_id").collect())


def test_copies_of_any_age(spark):
    folder = fresh_folder(spark, "unique")
    add(spark, folder, 0, events_of(spark, [*range(300), 5, 5, -1, -1]))
    add(spark, folder, 1, events_of(spark, [*range(250, 600), -2]))
    add(spark, folder, 1, events_of(spark, [*range(250, 600), -2]))
    wanted = sorted([f"e{n}" for n in range(600)] + [""] * 3)
    assert stored(spark, folder) == wanted
    for month in (202404, 202405):
        fold_month(spark, folder, month)
    assert drop_folded(spark, folder) == 4
    left = spark.read.parquet(ids.ids_folder(folder)).select("ingest_id").distinct().collect()
    assert len(left) == 2 and all(r.ingest_id.startswith("fold-") for r in left)
    # The copy has another time, and so another month, than the event stored.
    moved = events_of(spark, range(590, 610)).withColumn("timestamp", F.expr("timestamp - INTERVAL 50 DAY"))
    add(spark, folder, 2, moved)
    add(spark, folder, 3, events_of(spark, [1, 599, 605, -3]))
    assert stored(spark, folder) == sorted(wanted + [f"e{n}" for n in range(600, 610)] + [""])


def test_one_of_each_is_the_least_by_all_columns(spark):
    several = events_of(spark, [3, 3, -4, -4]).withColumn("price", F.expr("price + rand(1)"))
    kept = ids.one_of_each(several).collect()
    assert sorted(r.event_id or "" for r in kept) == ["", "", "e3"]
    assert [r.price for r in kept if r.event_id] == [several.where("event_id = 'e3'").agg(F.min("price")).first()[0]]


def test_filters_name_few_batches_and_miss_none(spark):
    folder = fresh_folder(spark, "unique")
    for batch in range(6):
        add(spark, folder, batch, events_of(spark, range(1000 * batch, 1000 * batch + 700)))
    filters = ids.read_filters(spark, folder)
    present = events_of(spark, range(2000, 2700)).select("event_id")
    maybe = ids.candidates(present, filters)
    assert maybe.select("event_id").distinct().count() == 700
    absent = ids.candidates(events_of(spark, range(10_000, 20_000)).select("event_id"), filters)
    assert absent.count() <= 6
    named = maybe.where("batch_id = 2").select(*ids.PARTITION_COLUMNS).distinct().collect()
    plan = ids.read_named(spark, folder, named)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "batch_id" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    files = {r[0] for r in ids.read_named(spark, folder, named).select("_metadata.file_path").distinct().collect()}
    assert files and all("batch_id=2" in file for file in files)


def test_what_a_filter_takes_for_another_is_stored(spark, monkeypatch):
    """A filter that says maybe to everything costs reads and loses nothing."""
    monkeypatch.setattr(ids, "_is_set", lambda bitmap, bit: F.lit(True))
    monkeypatch.setattr(ids, "_block", lambda blocks: F.pmod(F.lit(0), blocks))
    folder = fresh_folder(spark, "unique")
    add(spark, folder, 0, events_of(spark, range(40)))
    add(spark, folder, 1, events_of(spark, range(30, 90)))
    assert stored(spark, folder) == sorted(f"e{n}" for n in range(90))


def test_the_ingest_stores_each_event_once(spark):
    folder = fresh_folder(spark, "stream")

    def run(numbers, **settings):
        encode(events_of(spark, numbers)).coalesce(1).write.mode("append").text(f"{folder}/in")
        messages = read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)
        start_ingest(
            messages, f"{folder}/table", f"{folder}/checkpoint", every=None, unique=True, rollup=f"{folder}/rollup", **settings
        ).awaitTermination()

    def fail(batch_id, rows):
        raise RuntimeError("lost")

    run([*range(50), *range(20)])
    with pytest.raises(Exception, match="lost"):
        run(range(40, 80), on_batch=fail)
    run(range(100))
    assert stored(spark, f"{folder}/table") == sorted(f"e{n}" for n in range(100))
    hours = spark.read.parquet(f"{folder}/rollup/hours")
    assert hours.agg(F.sum("cnt")).first()[0] == 100
