"""Ingest: messages in, rows of the event table out."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clickloom.functions.times import month_key
from clickloom.sources.ids import batch_rows, without_copies, write_filter
from clickloom.sources.messages import decode, decode_flagged, normalize
from clickloom.sources.rollup import roll_up
from clickloom.sources.table import add_partitions, create_events_table, define_events_table, write_events
from clickloom.streaming.dedup import suppress_duplicates
from clickloom.streaming.offsets import file_ranges
from clickloom.streaming.state import planned_adaptively

log = logging.getLogger(__name__)

TRIGGER = "10 seconds"
SOURCE_COLUMNS = ("topic", "partition", "offset")
QUARANTINE_DDL = "raw STRING, ingest_id STRING, batch_id BIGINT"


def with_trigger(writer: DataStreamWriter, every: str | None = TRIGGER) -> DataStreamWriter:
    """Run every so often, or with ``None`` work off what is there and stop."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def _write_quarantine(malformed: DataFrame, path: str, ingest_id: str, batch_id: int) -> None:
    """File malformed messages under their batch; one that is run again replaces its own."""
    (
        malformed.select("raw", F.lit(ingest_id).alias("ingest_id"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        .hint("rebalance")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id", "batch_id").parquet(path)
    )


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Malformed messages as they came, with the ingest and batch that met them."""
    return spark.read.schema(QUARANTINE_DDL).parquet(path)


def start_table_sink(
    events: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = TRIGGER,
    on_batch: Callable[[int, int], None] | None = None,
    name: str | None = None,
    quarantine: str | None = None,
    rollup: str | None = None,
    unique: bool = False,
    offsets: str | None = None,
) -> StreamingQuery:
    """Write a normalised event stream into the table, one write job per micro-batch.

    The rows of a batch are filed under the query's id, which Spark keeps in
    the checkpoint, and the batch number. A batch that is run again after a
    crash replaces its own rows; a new checkpoint starts a new id and touches
    no older rows. Errors are not caught: they fail the batch, and it is run
    again on restart. ``on_batch`` is told the batch number and its row count,
    counted while the rows are written; should executors be lost meanwhile, rows
    read again may be counted again. With ``name``, the registered name of the
    table, each batch is added to the catalog before it counts as done. With
    ``quarantine``, a folder, the stream also has the columns ``raw`` and
    ``valid`` of ``decode_flagged``: rows that are not valid go there as text,
    not into the table. Such a batch is kept, on disk where memory is short,
    while it is written to both, so that it is read and parsed once. With
    ``rollup``, a folder, the batch's share of the hourly rollup is written after
    its rows, from a kept batch as well; see ``sources.rollup``. With ``unique``
    an event whose id any batch has stored is left out, however long ago that
    was; see ``sources.ids``. One such ingest at a time may extend a table. With
    ``offsets``, a folder, the stream also has the columns topic, partition and
    offset, whose ranges are kept there per batch; see ``streaming.offsets``.
    """
    if name is not None:
        define_events_table(events.sparkSession, name, path)
    started = threading.Event()
    ingest: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        with planned_adaptively(batch, events):
            if quarantine is None and rollup is None and offsets is None and not unique:
                store(batch, batch_id)
            else:
                write_kept(batch, batch_id)

    def write_kept(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = batch
            if offsets is not None:
                file_ranges(batch, offsets, ingest["id"], batch_id)
                events = events.drop(*SOURCE_COLUMNS)
            if quarantine is not None:
                _write_quarantine(batch.where("NOT valid"), quarantine, ingest["id"], batch_id)
                events = events.where("valid").drop("raw", "valid")
            if unique:
                with without_copies(events, path, ingest["id"], batch_id) as fresh:
                    fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
                    if fresh.isEmpty():
                        # Nothing to write, and nothing that could be counted on the way.
                        tell(batch_id, 0)
                    else:
                        store_all(fresh, batch_id)
                    fresh.unpersist()
            else:
                store_all(events, batch_id)
        finally:
            batch.unpersist()

    def store_all(events: DataFrame, batch_id: int) -> None:
        store(events, batch_id)
        if unique:
            spark = events.sparkSession
            write_filter(batch_rows(spark, path, ingest["id"], batch_id), path, ingest["id"], batch_id)
        if rollup is not None:
            roll_up(events, rollup, ingest["id"], batch_id)

    def store(batch: DataFrame, batch_id: int) -> None:
        counted = Observation()
        months = F.collect_set(month_key(F.col("timestamp"))).alias("months")
        rows = batch.observe(counted, F.count(F.lit(1)).alias("row_count"), months)
        write_events(rows, path, ingest["id"], batch_id)
        row_count = counted.get["row_count"]
        if name is not None and "seen" not in ingest:
            # Also what was written before the table had a name.
            create_events_table(batch.sparkSession, name, path)
            ingest["seen"] = "all"
        elif name is not None:
            add_partitions(batch.sparkSession, name, sorted(counted.get["months"]), ingest["id"], batch_id)
        tell(batch_id, row_count)

    def tell(batch_id: int, row_count: int) -> None:
        log.info("stored batch %d of about %d events", batch_id, row_count)
        if on_batch is not None:
            on_batch(batch_id, row_count)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = with_trigger(writer, every).start()
    ingest["id"] = str(query.id)
    started.set()
    return query


def start_ingest(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = TRIGGER,
    on_batch: Callable[[int, int], None] | None = None,
    unique_within: str | None = None,
    name: str | None = None,
    quarantine: str | None = None,
    rollup: str | None = None,
    unique: bool = False,
    offsets: str | None = None,
) -> StreamingQuery:
    """Decode, normalise and store a message stream.

    Malformed messages are kept, as rows of default values, or, with a folder
    given as ``quarantine``, set aside there as they came. With
    ``unique_within``, an interval such as "10 minutes", further copies of an
    event arriving within that time are left out; see ``suppress_duplicates``.
    ``name`` keeps the table complete under its registered name, ``rollup`` an
    hourly rollup beside it. ``unique`` leaves out copies of events stored at any
    time before; the two can be used together, as the interval spares the
    table's filters the copies that follow closely. ``offsets`` keeps the ranges
    of source offsets for an audit, of messages as they come; it cannot be used
    with ``unique_within``, which drops messages on the way.
    """
    if offsets is not None and unique_within is not None:
        raise ValueError("offsets cannot be audited behind unique_within; use unique")
    keep = SOURCE_COLUMNS if offsets is not None else ()
    events = decode(messages, keep) if quarantine is None else decode_flagged(messages, keep)
    if unique_within is not None:
        events = suppress_duplicates(events, unique_within)
    return start_table_sink(normalize(events), path, checkpoint, every, on_batch, name, quarantine, rollup, unique, offsets)
