"""What each micro-batch took and left, kept as a table.

Spark reports every batch to listeners. This one files the report under the
query and the batch, as one small file, so that a batch that is run again
replaces its own report and a restarted query goes on where it was.
"""

from __future__ import annotations

import json
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_DDL = (
    "name STRING, run_id STRING, started STRING, watermark STRING, input_rows BIGINT, input_rows_per_second DOUBLE, "
    "processed_rows_per_second DOUBLE, milliseconds BIGINT, late_rows BIGINT, state_rows BIGINT, state_bytes BIGINT, "
    "sources STRING, query_id STRING, batch_id BIGINT"
)


class ProgressTable(StreamingQueryListener):
    """Stores the progress of all queries of a session in a folder while it is attached.

    ``late_rows`` are those that stateful operators dropped for being older than
    the watermark, counted as they reach these, perhaps already combined;
    ``sources`` has each source's first and last offsets as JSON. Reports come
    shortly after their batch; ``wait`` returns when all of a query that has
    ended are stored.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def attach(self) -> ProgressTable:
        self._spark.streams.addListener(self)
        return self

    def detach(self) -> None:
        self._spark.streams.removeListener(self)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"the reports of run {query.runId} have not all come")

    def _end_of(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def onQueryProgress(self, event) -> None:
        report = event.progress
        # A trigger that found nothing to do reports the batch to come, which has not run.
        if "addBatch" not in report.durationMs:
            return
        state = report.stateOperators
        row = {
            "name": report.name, "run_id": str(report.runId), "started": report.timestamp,
            "watermark": report.eventTime.get("watermark"), "input_rows": report.numInputRows,
            "input_rows_per_second": _finite(report.inputRowsPerSecond),
            "processed_rows_per_second": _finite(report.processedRowsPerSecond),
            "milliseconds": report.durationMs.get("triggerExecution"),
            "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
            "state_rows": sum(s.numRowsTotal for s in state), "state_bytes": sum(s.memoryUsedBytes for s in state),
            "sources": json.dumps([{"first": s.startOffset, "last": s.endOffset} for s in report.sources]),
        }
        self._write(f"query_id={report.id}/batch_id={report.batchId}", json.dumps(row))

    def _write(self, below: str, line: str) -> None:
        """One file of a fixed name, replaced if it is there; written without a job, as batches are running."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{below}/report.json")
        out = path.getFileSystem(self._spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray((line + "\n").encode()))
        finally:
            out.close()


def _finite(rate: float) -> float | None:
    """JSON has no infinities and no NaN."""
    return rate if rate == rate and abs(rate) != float("inf") else None


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """A row per query and batch."""
    try:
        rows = spark.read.schema(PROGRESS_DDL).json(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], PROGRESS_DDL)
    return rows.withColumn("started", F.to_timestamp("started")).withColumn("watermark", F.to_timestamp("watermark"))
