"""Duplicate suppression for event streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def suppress_duplicates(events: DataFrame, within: str) -> DataFrame:
    """One row per event_id among copies that arrive ``within`` an interval of each other.

    What counts is the time of the micro-batch, which Spark keeps with the
    offsets, so that a batch run again decides the same. By event time an event
    sent late would be older than the watermark and be dropped; by arrival no
    row is ever too late. Rows without an id, null or empty, are not compared
    and all stay.

    Copies that arrive together are dropped in the task that reads them, so an
    id delivered very often does not travel to the one task that keeps its
    state.
    """

    # Defined in here so that it is sent to the executors as a whole, and they
    # need not have this package installed.
    def first_copies(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("event_id")
            codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            keep = (codes == -1) | pc.equal(ids, "").fill_null(True).to_numpy(zero_copy_only=False)
            keep[np.unique(codes, return_index=True)[1]] = True
            kept = batch.filter(pa.array(keep))
            yield kept.append_column("row", pa.array(np.arange(row, row + kept.num_rows)))
            row += kept.num_rows

    # Makes rows without an id differ from each other, within and across batches.
    stray = F.expr("CASE WHEN coalesce(event_id, '') = '' THEN concat_ws('-', arrived, row) END")
    return (
        events.mapInArrow(first_copies, StructType([*events.schema, StructField("row", LongType())]))
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", within)
        .withColumn("stray", stray)
        .dropDuplicatesWithinWatermark(["event_id", "stray"])
        .select(*events.columns)
    )
