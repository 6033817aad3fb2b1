"""Folding many batches of a month into one, while readers and an ingest go on."""

from datetime import timedelta
from pathlib import Path

import pytest
from events import AS_OF, SCHEMA
from pyspark.sql import functions as F

from clickloom.sources import folding, table
from clickloom.sources.scratch import fresh_folder

MAY, APRIL = 202405, 202404


@pytest.fixture
def batches(spark):
    """A table of five batches over two months, and its events."""
    path = fresh_folder(spark, "batches")
    rows = [(f"e{i:04d}", "view", "u", "p", 1.0, AS_OF - timedelta(hours=i), "c", "ip") for i in range(600)]
    events = spark.createDataFrame(rows, SCHEMA).cache()
    for number in range(5):
        table.write_events(events.where(F.crc32("event_id") % 5 == number), path, "stream", number)
    return path, events


def ids(spark, path):
    return sorted(r.event_id for r in table.read_events(spark, path).collect())


def files(path):
    return list(Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_a_fold_takes_the_place_of_its_batches(spark, batches):
    path, events = batches
    wanted = sorted(r.event_id for r in events.collect())
    before = len(files(path))
    fold_id = folding.fold_month(spark, path, MAY)
    assert ids(spark, path) == wanted
    assert {r.ingest_id for r in table.read_table(spark, path).where(F.col("event_month") == MAY).collect()} == {fold_id}
    assert {r.ingest_id for r in table.read_table(spark, path).where(F.col("event_month") == APRIL).collect()} == {"stream"}
    assert folding.drop_folded(spark, path) == 5 and folding.drop_folded(spark, path) == 0
    assert len(files(path)) < before and ids(spark, path) == wanted


def test_a_reader_that_began_earlier_keeps_its_rows(spark, batches):
    path, events = batches
    earlier = table.read_events(spark, path)
    folding.fold_month(spark, path, MAY)
    assert earlier.count() == table.read_events(spark, path).count() == 600


def test_a_fold_that_crashed_has_done_nothing(spark, batches, monkeypatch):
    path, events = batches
    wanted = ids(spark, path)
    with monkeypatch.context() as patched:
        patched.setattr(folding, "folds_folder", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            folding.fold_month(spark, path, MAY)
    assert ids(spark, path) == wanted and folding.drop_folded(spark, path) == 0
    folding.fold_month(spark, path, MAY)
    assert ids(spark, path) == wanted


def test_later_batches_and_batches_run_again(spark, batches):
    path, events = batches
    folding.fold_month(spark, path, MAY)
    # The last batch once more, as after a crash of the ingest, and a new one.
    table.write_events(events.where(F.crc32("event_id") % 5 == 4), path, "stream", 4)
    assert table.read_events(spark, path).count() == 600
    new = events.limit(1).withColumn("event_id", F.lit("new"))
    table.write_events(new, path, "stream", 5)
    table.write_events(new.withColumn("event_id", F.lit("other")), path, "another", 0)
    assert table.read_events(spark, path).count() == 602
    first = folding.read_folds(spark, path)[0].fold_id
    assert folding.fold_month(spark, path, MAY) != first
    assert table.read_events(spark, path).count() == 602
    assert folding.fold_month(spark, path, MAY) is None
    folding.drop_folded(spark, path)
    assert table.read_events(spark, path).count() == 602


def test_folds_under_a_registered_name(spark, batches):
    path, events = batches
    table.create_events_table(spark, "folding_events", path)
    folding.fold_month(spark, path, MAY, name="folding_events")
    folding.fold_month(spark, path, APRIL, name="folding_events")
    assert table.read_events(spark, name="folding_events").count() == 600
    folding.drop_folded(spark, path, name="folding_events")
    assert table.read_events(spark, name="folding_events").count() == 600


def test_folded_files_are_not_opened(spark, batches):
    path, _ = batches
    folding.fold_month(spark, path, MAY)
    rows = table.read_events(spark, path, since=AS_OF - timedelta(hours=6))
    read = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert read and all("ingest_id=fold-" in name for name in read)
    assert "fold-" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
