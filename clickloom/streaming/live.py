"""Live counts from a stream: minutes and the running funnel.

Counts are additive, so a micro-batch stores no more than its own, per minute,
under the query's id, the day and the batch number; readers add them up. There
is no state and no watermark, so no event is too late to be counted, and a
reader of a few days lists only these.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.aggregates import stage_counts
from clickloom.functions.times import utc_wall_clock
from clickloom.streaming.pipeline import TRIGGER, with_trigger
from clickloom.vocabulary import STAGE_COLUMNS

COUNTS = (*STAGE_COLUMNS, "total")
PARTIAL_DDL = (
    "bucket TIMESTAMP_NTZ, " + ", ".join(f"{name} BIGINT" for name in COUNTS)
    + ", query_id STRING, day DATE, batch_id BIGINT"
)


def minute_counts(events: DataFrame) -> DataFrame:
    """Stage counts per minute of a batch of events."""
    placed = utc_wall_clock(events).withColumn(
        "bucket", F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    )
    return placed.groupBy("bucket").agg(*stage_counts(), F.count("*").alias("total"))


def start_live_counts(events: DataFrame, path: str, checkpoint: str, every: str | None = TRIGGER) -> StreamingQuery:
    """Keep each micro-batch's counts per minute; a batch that runs again replaces its own."""
    started = threading.Event()
    ingest: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        (
            minute_counts(batch)
            .withColumns({
                "query_id": F.lit(ingest["id"]), "day": F.to_date("bucket"),
                "batch_id": F.lit(batch_id).cast("bigint"),
            })
            .hint("rebalance", "day")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("query_id", "day", "batch_id").parquet(path)
        )

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = with_trigger(writer, every).start()
    ingest["id"] = str(query.id)
    started.set()
    return query


def _counted(spark: SparkSession, path: str, query_id: str, since: str | None) -> DataFrame:
    rows = spark.read.schema(PARTIAL_DDL).parquet(path).where(F.col("query_id") == F.lit(str(query_id)))
    return rows if since is None else rows.where(F.col("day") >= F.lit(since).cast("date"))


def live_minutes(spark: SparkSession, path: str, query_id: str, since: str | None = None) -> DataFrame:
    """Stage counts per minute as one query (``StreamingQuery.id``) has counted them, from a day on."""
    rows = _counted(spark, path, query_id, since)
    return rows.groupBy("bucket").agg(*[F.sum(name).alias(name) for name in COUNTS])


def running_funnel(spark: SparkSession, path: str, query_id: str, since: str | None = None) -> DataFrame:
    """Stage counts of all that a query has counted, and purchases per view (no views count as one)."""
    rows = _counted(spark, path, query_id, since)
    counts = rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in STAGE_COLUMNS])
    return counts.withColumn("cvr_pct", F.col("purchases") / F.greatest("views", F.lit(1)) * 100)
