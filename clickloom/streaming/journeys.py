"""A running funnel of users: how far each has come, in the order in which events happened.

A user reaches a stage with the first event of its kind at or after reaching
the stage before. Events wait in the state until the watermark has
passed them, and are then worked off in order of time, however they arrived.
Only advances leave the state, and running totals are changed by these alone.
A user idle for long enough is forgotten and starts anew, which bounds the
state to the users of that time.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.streaming.pipeline import TRIGGER, with_trigger
from clickloom.streaming.state import carry_record, file_batch, keyed_state_store, latest_record, planned_adaptively, read_filed
from clickloom.vocabulary import STAGES

ADVANCES_DDL = "user_id STRING, stage INT, at TIMESTAMP"
TOTALS_DDL = "stage INT, reached BIGINT"
# Of a group: its users, the stages each has reached, the time of each one's last event, and as bytes of 64-bit
# numbers the events not yet in order, each a user's place, a time and a stage.
_STATE_DDL = "users ARRAY<STRING>, reached ARRAY<INT>, last ARRAY<BIGINT>, waiting BINARY"
# Users are dealt to so many groups, whose state is one row each.
GROUPS = 2048


def _journeys(forget_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Works off the events of some users that the watermark has passed, and keeps the others with the stages reached.

    The state of these users is one row, read and written once a batch: what a
    call for each user costs would be far more than the work on the user's events.
    """

    # Defined in here so that it is sent to the executors as a whole, and they
    # need not have this package installed.
    def follow(_, parts, state):
        passed = state.getCurrentWatermarkMs()
        users, progress, waiting = [], {}, []
        if state.exists:
            names, reached, last, packed = state.get
            users = list(names)
            progress = dict(enumerate(zip(reached, last)))
            waiting.append(np.frombuffer(packed, "int64").reshape(-1, 3))
        number = {user: i for i, user in enumerate(users)}
        for part in () if state.hasTimedOut else parts:
            part = part[part["stage"] >= 0]
            owners = [number.setdefault(user, len(number)) for user in part["user_id"].tolist()]
            waiting.append(np.column_stack([owners, part["ms"], part["stage"]]).astype("int64").reshape(-1, 3))
        users = list(number)
        if not users:
            return
        events = np.concatenate(waiting)
        events = events[np.lexsort((events[:, 2], events[:, 1], events[:, 0]))]
        due = events[:, 1] <= passed
        advances = []
        for i, ms, stage in events[due].tolist():
            reached, last = progress.get(i, (0, None))
            if last is not None and ms - last > forget_ms:
                reached = 0
            if stage == reached:
                reached += 1
                advances.append((users[i], stage, pd.Timestamp(ms, unit="ms")))
            progress[i] = reached, ms
        rest = events[~due]
        # When each user is to be looked at again: at the first event that waits, or when idle for long enough.
        idle = {i: last + forget_ms for i, (_, last) in progress.items() if last is not None}
        look = {i: at for i, at in idle.items() if at >= passed}
        owners, first = np.unique(rest[:, 0], return_index=True)
        look |= zip(owners.tolist(), (rest[first, 1] - 1).tolist())
        if look:
            kept = sorted(look)
            rest = np.column_stack([np.searchsorted(kept, rest[:, 0]), rest[:, 1:]])
            reached, last = zip(*(progress.get(i, (0, None)) for i in kept))
            state.update(([users[i] for i in kept], list(reached), list(last), rest.astype("int64").tobytes()))
            state.setTimeoutTimestamp(max(1, min(look.values())))
        elif state.exists:
            state.remove()
        if advances:
            yield pd.DataFrame(advances, columns=["user_id", "stage", "at"])

    return follow


def start_running_funnel(
    events: DataFrame, path: str, checkpoint: str, stages: Sequence[str] = STAGES, delay: str = "10 minutes",
    forget_hours: int = 24 * 7, every: str | None = TRIGGER, partitions: int | None = None,
) -> StreamingQuery:
    """Follow every user of an event stream through the stages, and keep running totals.

    Events later than ``delay`` after the newest one are dropped. After
    ``forget_hours`` without an event of any stage a user starts anew. A
    user's events of a batch are one task's. Advances and totals are filed by
    query and batch, so a batch that is run again replaces its own.
    """
    started = threading.Event()
    ingest: dict[str, str] = {}
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        # Kept, as state must be worked through once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with planned_adaptively(batch, events):
                file_batch(batch, f"{path}/advances", ingest["id"], batch_id)
                more = batch.groupBy("stage").agg(F.count("*").alias("reached"))

                def add(totals: DataFrame) -> DataFrame:
                    return totals.unionByName(more).groupBy("stage").agg(F.sum("reached").alias("reached"))

                carry_record(batch.sparkSession, f"{path}/totals", TOTALS_DDL, ingest["id"], batch_id, add)
        finally:
            batch.unpersist()

    stage = F.array_position(F.array(*map(F.lit, stages)), F.col("event_type")) - 1
    # Events of no stage are left out by the processor only: a filter would be moved in front of the watermark,
    # which they are to advance.
    steps = (
        events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
        .select(
            "user_id", "timestamp", F.unix_millis("timestamp").alias("ms"),
            F.coalesce(stage, F.lit(-1)).cast("int").alias("stage"),
            F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("group"),
        )
    )
    advances = steps.groupBy("group").applyInPandasWithState(
        _journeys(forget_hours * 3_600_000), ADVANCES_DDL, _STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout
    )
    writer = advances.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with keyed_state_store(spark, partitions):
        query = with_trigger(writer, every).start()
    ingest["id"] = str(query.id)
    started.set()
    return query


def running_totals(spark: SparkSession, path: str, query_id: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """(stage, reached): how often each stage has been reached so far, from the last batch's record."""
    totals = latest_record(spark, f"{path}/totals", TOTALS_DDL, query_id)
    names = spark.createDataFrame(list(enumerate(stages)), "number INT, stage STRING")
    joined = names.join(totals.withColumnRenamed("stage", "of"), F.col("number") == F.col("of"), "left")
    return joined.select("stage", F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached"))


def advances(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """(user_id, stage, at): every stage that a user has reached, and when."""
    return read_filed(spark, f"{path}/advances", ADVANCES_DDL, query_id).drop("query_id", "batch_id")
