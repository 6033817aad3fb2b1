"""Streams against batch answers, and their behaviour on restart."""

from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clickloom.operators import metrics
from clickloom.sources.fixtures import fixture_events, latest_second
from clickloom.sources.messages import decode, encode, normalize
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import kafka_options, read_kafka, read_message_files
from clickloom.sources.table import batch_counts, read_events, read_table
from clickloom.streaming import job, live, pipeline
from clickloom.streaming.pipeline import start_ingest

SF_DIR = "/root/testdata/sf0.001"


def send(spark, folder, *lines):
    spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.mode("append").text(folder)


def message(event_id, time, event_type="view", price=1.0):
    return (
        f'{{"event_id":"{event_id}","event_type":"{event_type}","user_id":"u","product_id":"p",'
        f'"price":{price},"timestamp":"{time}+00:00","category":"c","ip_address":"i"}}'
    )


def ingest(spark, folder, **options):
    query = start_ingest(
        read_message_files(spark, f"{folder}/in", options.pop("cap", None)),
        f"{folder}/table", f"{folder}/checkpoint", every=None, **options,
    )
    query.awaitTermination()
    return query


def stored_ids(spark, folder):
    return sorted(r.event_id for r in read_events(spark, f"{folder}/table").collect())


def test_ingest_equals_batch(spark):
    folder = fresh_folder(spark, "t")
    events = fixture_events(spark, SF_DIR, whole_seconds=False)
    encode(events).repartition(3).write.text(f"{folder}/in")
    counts = {}
    ingest(spark, folder, cap=1, on_batch=counts.__setitem__)
    assert len(counts) == 3 and sum(counts.values()) == 1000
    by_table = {r.batch_id: r.row_count for r in batch_counts(spark, f"{folder}/table").collect()}
    assert by_table == counts
    as_of = latest_second(spark, SF_DIR)
    table = read_events(spark, f"{folder}/table")
    batch = fixture_events(spark, SF_DIR)
    for operator in (metrics.overview, metrics.top_categories, metrics.timeseries):
        assert operator(table, "30d", as_of=as_of).collect() == operator(batch, "30d", as_of=as_of).collect()


def test_malformed_messages_are_stored_as_defaults(spark):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", "not json", message("a", "2024-01-01T00:00:01.5"))
    ingest(spark, folder)
    rows = {r.event_id: r for r in read_table(spark, f"{folder}/table").collect()}
    assert set(rows) == {"", "a"}
    assert rows[""].event_month == 197001 and rows["a"].timestamp.microsecond == 0


def test_crash_between_write_and_commit(spark):
    """The batch is run again on restart and replaces its own rows."""
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", *[message(f"e{i}", f"2024-0{1 + i % 3}-01T00:00:00") for i in range(30)])

    def crash(batch_id, row_count):
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ingest(spark, folder, on_batch=crash)
    assert len(stored_ids(spark, folder)) == 30
    assert not list(Path(f"{folder}/checkpoint/commits").glob("[0-9]*"))
    ingest(spark, folder)
    assert stored_ids(spark, folder) == sorted(f"e{i}" for i in range(30))
    send(spark, f"{folder}/in", message("later", "2024-01-01T00:00:00"))
    ingest(spark, folder)
    ingest(spark, folder)
    assert stored_ids(spark, folder) == sorted([f"e{i}" for i in range(30)] + ["later"])


def test_crash_before_write_loses_nothing(spark, monkeypatch):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", message("a", "2024-01-01T00:00:00"))

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as broken:
        broken.setattr(pipeline, "write_events", fail)
        with pytest.raises(StreamingQueryException):
            ingest(spark, folder)
    ingest(spark, folder)
    assert stored_ids(spark, folder) == ["a"]


def test_a_new_checkpoint_does_not_overwrite(spark):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", message("a", "2024-01-01T00:00:00"))
    for run in ("first", "second"):
        messages = read_message_files(spark, f"{folder}/in")
        start_ingest(messages, f"{folder}/table", f"{folder}/{run}", every=None).awaitTermination()
    assert stored_ids(spark, folder) == ["a", "a"]


def test_events_with_an_empty_id_are_no_copies(spark):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", *[message("", f"2024-01-01T00:00:0{i}") for i in range(5)])
    ingest(spark, folder, unique_within="10 minutes")
    send(spark, f"{folder}/in", message("", "2024-01-01T00:00:00"), message("a", "2024-01-01T00:00:00"))
    ingest(spark, folder, unique_within="10 minutes")
    assert stored_ids(spark, folder) == [""] * 6 + ["a"]


def test_the_state_drops_copies_of_later_batches(spark):
    folder = fresh_folder(spark, "t")
    for _ in range(2):
        send(spark, f"{folder}/in", *[message(f"e{i}", "2024-01-01T00:00:00") for i in range(40)])
    query = ingest(spark, folder, cap=1, unique_within="10 minutes")
    dropped = sum(
        int(s["customMetrics"].get("numDroppedDuplicateRows", 0)) for p in query.recentProgress for s in p["stateOperators"]
    )
    assert dropped == 40 and len(stored_ids(spark, folder)) == 40


def test_duplicates_within_and_across_batches(spark):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", *[message("hot", "2024-01-01T00:00:00")] * 500, message("b", "2024-01-01T00:01:00"))
    ingest(spark, folder, unique_within="10 minutes")
    send(spark, f"{folder}/in", message("hot", "2024-01-01T00:00:00"), message("c", "2024-01-01T00:02:00"), "x", "x")
    ingest(spark, folder, unique_within="10 minutes")
    assert stored_ids(spark, folder) == ["", "", "b", "c", "hot"]


def test_events_sent_late_are_not_taken_for_duplicates(spark):
    folder = fresh_folder(spark, "t")
    for line in (message("new", "2024-06-01T00:00:00"), message("old", "2023-01-01T00:00:00"), '{"event_id":"no time"}'):
        send(spark, f"{folder}/in", line, line)
        ingest(spark, folder, unique_within="10 minutes")
    assert stored_ids(spark, folder) == ["new", "no time", "old"]


def test_duplicates_after_a_crash(spark):
    """The batch that failed after writing is run again: nothing twice, nothing lost."""
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", *[message(f"e{i % 10}", "2024-01-01T00:00:00") for i in range(40)], "x", "y")

    def crash(batch_id, row_count):
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ingest(spark, folder, unique_within="10 minutes", on_batch=crash)
    ingest(spark, folder, unique_within="10 minutes")
    send(spark, f"{folder}/in", message("e3", "2024-01-01T00:00:00"), "x")
    ingest(spark, folder, unique_within="10 minutes")
    assert stored_ids(spark, folder) == ["", "", ""] + [f"e{i}" for i in range(10)]


def count_live(spark, folder, checkpoint="checkpoint"):
    stream = normalize(decode(read_message_files(spark, f"{folder}/in", 1)))
    query = live.start_live_counts(stream, f"{folder}/counts", f"{folder}/{checkpoint}", every=None)
    query.awaitTermination()
    return f"{folder}/counts", str(query.id)


def test_live_minutes_count_late_rows(spark):
    folder = fresh_folder(spark, "t")
    batches = [
        [message("a", "2024-01-01T10:00:00"), message("b", "2024-01-01T10:20:30", "purchase")],
        [message("late", "2024-01-01T10:15:00"), message("b2", "2024-01-01T10:20:40")],
        [message("very late", "2023-12-30T09:00:00"), message("z", "2024-01-01T10:21:00", "other")],
    ]
    for lines in batches:
        send(spark, f"{folder}/in", *lines)
        counted = count_live(spark, folder)
    minutes = live.live_minutes(spark, *counted).orderBy("bucket").collect()
    assert [(r.bucket.strftime("%d %H:%M"), r.views, r.purchases, r.total) for r in minutes] == [
        ("30 09:00", 1, 0, 1), ("01 10:00", 1, 0, 1), ("01 10:15", 1, 0, 1), ("01 10:20", 1, 1, 2), ("01 10:21", 0, 0, 1),
    ]
    recent = live.live_minutes(spark, *counted, since="2024-01-01")
    assert recent.count() == 4
    assert "day" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_running_funnel_over_batches_and_checkpoints(spark):
    folder = fresh_folder(spark, "t")

    def run(*lines, checkpoint="c"):
        if lines:
            send(spark, f"{folder}/in", *lines)
        return tuple(live.running_funnel(spark, *count_live(spark, folder, checkpoint)).first())

    assert run(message("p", "2024-01-01T10:00:00", "purchase")) == (0, 0, 0, 1, 100.0)
    assert run(*[message(f"v{i}", "2024-01-01T10:00:00") for i in range(4)]) == (4, 0, 0, 1, 25.0)
    # A new checkpoint counts anew, from the first message on.
    assert run(message("w", "2024-01-01T10:00:00"), checkpoint="new") == (5, 0, 0, 1, 20.0)
    assert run() == (5, 0, 0, 1, 20.0)


def test_kafka_options(spark):
    assert kafka_options("broker:9092") == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "events",
        "startingOffsets": "earliest", "failOnDataLoss": "false",
    }
    capped = kafka_options("b", "clicks", max_offsets_per_trigger=10_000, min_partitions=64)
    assert (capped["subscribe"], capped["maxOffsetsPerTrigger"], capped["minPartitions"]) == ("clicks", "10000", "64")
    with pytest.raises(Exception, match="(?i)kafka"):
        read_kafka(spark, "broker:9092")


def test_default_trigger(spark):
    folder = fresh_folder(spark, "t")
    send(spark, f"{folder}/in", message("a", "2024-01-01T00:00:00"))
    query = start_ingest(read_message_files(spark, f"{folder}/in"), f"{folder}/table", f"{folder}/c", every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert stored_ids(spark, folder) == ["a"]
    assert pipeline.TRIGGER == "10 seconds"


def test_stream_plans_aggregate_before_the_shuffle(spark):
    events = fixture_events(spark, SF_DIR).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    plan = live.minute_counts(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_count")


def test_job_arguments():
    options = job.arguments(["--servers", "b:9092", "--table", "/t", "--checkpoint", "/c", "--max-offsets", "500"])
    assert (options.topic, options.every, options.max_offsets, options.unique_within) == (
        "events", "10 seconds", 500, None,
    )


def quarantined(spark, folder):
    return sorted(r.raw for r in pipeline.read_quarantine(spark, f"{folder}/malformed").collect())


def test_malformed_messages_are_set_aside_as_they_came(spark):
    folder = fresh_folder(spark, "q")
    good = [message("a", "2024-05-01T10:00:00"), message("b", "2024-05-01T10:00:01", price="null")]
    bad = ["not json", "{}", message("c", "?"), message("d", "2024-05-01T10:00:00", price='"dear"')]
    send(spark, f"{folder}/in", *good, *bad)
    counts = {}
    ingest(spark, folder, quarantine=f"{folder}/malformed", on_batch=counts.__setitem__)
    assert stored_ids(spark, folder) == ["a", "b"] and counts == {0: 2}
    assert quarantined(spark, folder) == sorted(bad)
    send(spark, f"{folder}/in", message("e", "2024-05-01T10:00:02"))
    ingest(spark, folder, quarantine=f"{folder}/malformed")
    assert stored_ids(spark, folder) == ["a", "b", "e"] and len(quarantined(spark, folder)) == 4


def test_a_batch_set_aside_and_run_again_replaces_itself(spark, monkeypatch):
    folder = fresh_folder(spark, "q")
    send(spark, f"{folder}/in", message("a", "2024-05-01T10:00:00"), "not json")

    def crash(*_):
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ingest(spark, folder, quarantine=f"{folder}/malformed", on_batch=crash)
    ingest(spark, folder, quarantine=f"{folder}/malformed")
    assert stored_ids(spark, folder) == ["a"] and quarantined(spark, folder) == ["not json"]


def test_a_malformed_message_hides_no_good_one(spark):
    folder = fresh_folder(spark, "q")
    broken, good = message("a", "?"), message("a", "2024-05-01T10:00:00")
    send(spark, f"{folder}/in", broken, good, good, broken)
    ingest(spark, folder, quarantine=f"{folder}/malformed", unique_within="10 minutes")
    assert stored_ids(spark, folder) == ["a"] and quarantined(spark, folder) == [broken, broken]
