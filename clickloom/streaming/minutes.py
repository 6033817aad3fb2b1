"""Minutes by event time: each is counted in keyed state and given out once, when it is final.

A minute is final when an event has come that is later than its end by the
allowed delay. Events of final minutes are late: they are set aside as they
are, and counted. Spark itself would drop them without a trace. So its
watermark is held back by a further time, after which even late events are let
go, and the processor compares minutes with the watermark that the delay alone
would give. An hour's minutes are one key's matter, which makes few calls to the
state, and its events are spread over several such keys, so that the present
hour, to which nearly all events belong, is counted by several tasks.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from clickloom.streaming.pipeline import TRIGGER, with_trigger
from clickloom.streaming.state import file_batch, keyed_state_store, read_filed
from clickloom.vocabulary import EVENT_DDL, STAGE_COLUMNS

COUNTS = (*STAGE_COLUMNS, "total")
_COUNTS_DDL = ", ".join(f"{name} BIGINT" for name in COUNTS)
MINUTES_DDL = f"bucket TIMESTAMP, {_COUNTS_DDL}"
_OUT_DDL = f"late BOOLEAN, {MINUTES_DDL}, {EVENT_DDL}"
_MINUTE, _HOUR = 60_000, 3_600_000
# Keys that an hour's events are dealt to.
SPREAD = 8
# How much later than the delay an event may be and still be set aside.
KEEP_HOURS = 30 * 24


class _MinuteCounts(StatefulProcessor):
    """Counts of one share of an hour's minutes, each kept until the minute is final."""

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # The counts of the hour's minutes in a row, and the earliest timer set.
        self._state = handle.getValueState("counts", "counts ARRAY<BIGINT>, timer BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() + self._keep
        known = self._state.get()
        counts = _table(known)
        for part in rows:
            minute = (part["ms"].to_numpy() - key[0] * _HOUR) // _MINUTE
            late = key[0] * _HOUR + (minute + 1) * _MINUTE <= final
            np.add.at(counts[:, -1], minute[~late], 1)
            for i, stage in enumerate(STAGE_COLUMNS.values()):
                np.add.at(counts[:, i], minute[~late & (part["event_type"] == stage).to_numpy()], 1)
            if late.any():
                yield _frame(late=True, **part[late].drop(columns=["hour", "share", "ms"]))
        if counts[:, -1].any():
            self._keep_counts(key, counts, final, None if known is None else known[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() + self._keep
        counts = _table(self._state.get())
        ends = key[0] * _HOUR + (np.arange(len(counts)) + 1) * _MINUTE
        done = np.flatnonzero((counts[:, -1] > 0) & (ends <= final))
        if len(done):
            begins = pd.Series(pd.to_datetime(ends[done] - _MINUTE, unit="ms"))
            yield _frame(late=False, bucket=begins, **dict(zip(COUNTS, counts[done].T)))
            counts[done] = 0
        if counts[:, -1].any():
            self._keep_counts(key, counts, final, None)
        else:
            self._state.clear()

    def _keep_counts(self, key, counts: np.ndarray, final: int, timer: int | None) -> None:
        """Store the counts, and have the first of their minutes looked at when it may be final."""
        first = int(np.flatnonzero(counts[:, -1])[0])
        # Timers may go off just at or just after their time: set early once, and again if that was too early.
        due = key[0] * _HOUR + (first + 1) * _MINUTE - self._keep
        due -= due - 1 > final - self._keep
        if timer is None or due < timer:
            self._handle.registerTimer(due)
            timer = due
        self._state.update(([int(n) for n in counts.ravel()], timer))

    def close(self) -> None:
        pass


def _frame(late: bool, **columns) -> pd.DataFrame:
    """Rows of the output with the columns given and nulls in all others."""
    n = len(next(iter(columns.values())))
    out = {}
    for name in _NAMES:
        empty = np.full(n, np.datetime64("NaT", "ns")) if name in ("bucket", "timestamp") else np.full(n, None)
        values = columns.get(name, empty)
        # Texts as plain objects: of texts that pandas keeps in Arrow form Spark takes whole columns only.
        is_text = isinstance(values, pd.Series) and isinstance(values.dtype, pd.StringDtype)
        out[name] = np.array(values, object) if is_text else np.asarray(values)
    return pd.DataFrame(out | {"late": np.full(n, late)})


def _table(known: tuple | None) -> np.ndarray:
    """A row of counts for each minute of an hour."""
    counts = np.zeros((_HOUR // _MINUTE, len(COUNTS)), np.int64)
    if known is not None:
        counts.ravel()[:] = known[0]
    return counts


_NAMES = [column.split()[0] for column in _OUT_DDL.split(", ")]


def start_final_minutes(
    events: DataFrame, path: str, checkpoint: str, delay_minutes: int = 2, every: str | None = TRIGGER,
    keep_hours: int = KEEP_HOURS, spread: int = SPREAD, partitions: int | None = None,
) -> StreamingQuery:
    """Give out each minute of an event stream once, ``delay_minutes`` after its end by event time.

    Late events go aside; those over ``keep_hours`` later still are dropped,
    which only Spark's own count of dropped rows shows. Both outputs are filed
    by query and batch, so a batch that is run again replaces its own.
    """
    started = threading.Event()
    ingest: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        # Kept, as state must be worked through once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            minutes = batch.where("NOT late").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])
            file_batch(minutes, f"{path}/minutes", ingest["id"], batch_id)
            late = batch.where("late").select(*[c.split()[0] for c in EVENT_DDL.split(", ")])
            file_batch(late, f"{path}/late", ingest["id"], batch_id)
        finally:
            batch.unpersist()

    spark = events.sparkSession
    keyed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    keyed = keyed.withWatermark("timestamp", f"{delay_minutes + keep_hours * 60} minutes").withColumns({
        "hour": F.floor(F.unix_millis("timestamp") / _HOUR), "ms": F.unix_millis("timestamp"),
        "share": F.pmod(F.xxhash64("event_id", "user_id"), F.lit(spread)),
    })
    out = keyed.groupBy("hour", "share").transformWithStateInPandas(
        _MinuteCounts(keep_hours * 60 * _MINUTE), _OUT_DDL, "Append", "EventTime"
    )
    with keyed_state_store(spark, partitions):
        query = with_trigger(out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every).start()
    ingest["id"] = str(query.id)
    started.set()
    return query


def final_minutes(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """The minutes a query has given out, one row each."""
    return read_filed(spark, f"{path}/minutes", MINUTES_DDL, query_id).drop("query_id", "batch_id")


def late_events(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """Events that came when their minute was final, with the batch that met them."""
    return read_filed(spark, f"{path}/late", EVENT_DDL, query_id).drop("query_id")
