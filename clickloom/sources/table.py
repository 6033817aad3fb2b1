"""The stored event table: Parquet, partitioned by month, sorted by (timestamp, user_id).

Times are stored as TIMESTAMP_NTZ holding UTC: by default Spark writes the
zoned type as INT96, for which Parquet keeps no statistics, so that a time
range could not skip a single row group.

Below the month lie two more partition levels, ``ingest_id`` and ``batch_id``:
who wrote the rows and in which batch. Writing a batch again replaces exactly
the files it wrote before. Readers see the eight event columns only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.times import as_of_column, month_key, utc_wall_clock, window_start
from clickloom.vocabulary import EVENT_COLUMNS, EVENT_DDL

PARTITION_COLUMNS = ("event_month", "ingest_id", "batch_id")
TABLE_DDL = (
    EVENT_DDL.replace("timestamp TIMESTAMP", "timestamp TIMESTAMP_NTZ")
    + ", event_month INT, ingest_id STRING, batch_id BIGINT"
)
FOLD_PREFIX = "fold-"
FOLDS_DDL = "event_month INT, fold_id STRING, ingest_id STRING, through_batch BIGINT"


def define_events_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the table in the catalog unless it is there; the folder need not exist yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({TABLE_DDL}) USING parquet "
        f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{path}'"
    )


def create_events_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the table in the catalog unless it is there, and pick up its partitions.

    Reading a table of many batches by this name lets the catalog say which
    months to list; reading it by its folder lists them all first.
    """
    define_events_table(spark, name, path)
    spark.sql(f"MSCK REPAIR TABLE {name}")


def add_partitions(spark: SparkSession, name: str, months: list[int], ingest_id: str, batch_id: int) -> None:
    """Make one batch's rows visible under the table's registered name."""
    for month in months:
        spark.sql(
            f"ALTER TABLE {name} ADD IF NOT EXISTS "
            f"PARTITION (event_month = {month}, ingest_id = '{ingest_id}', batch_id = {batch_id})"
        )
    spark.catalog.refreshTable(name)


def _laid_out(events: DataFrame, ingest_id: str, batch_id: int) -> DataFrame:
    """Rows grouped by hour into files of even size, each file in table order.

    REBALANCE shuffles by hour, and the adaptive planner then joins small
    partitions and splits large ones, so neither many small source partitions
    nor one crowded hour decides the file sizes.
    """
    placed = utc_wall_clock(events).select(
        *EVENT_COLUMNS,
        month_key(F.col("timestamp")).alias("event_month"),
        F.lit(ingest_id).alias("ingest_id"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.date_trunc("hour", "timestamp").alias("event_hour"),
    )
    return (
        placed.hint("rebalance", "event_hour")
        .drop("event_hour")
        .sortWithinPartitions(*PARTITION_COLUMNS, "timestamp", "user_id")
    )


def write_events(events: DataFrame, path: str, ingest_id: str, batch_id: int = 0) -> None:
    """Write normalised events as one batch, replacing that batch if it was written before.

    An empty frame writes nothing. For a replay to replace everything, it must
    carry the same rows, as a micro-batch replayed from its checkpoint does.
    """
    (
        _laid_out(events, ingest_id, batch_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        # Lets a lookup of one user skip the row groups that user is not in, also
        # where the ids are too many for a dictionary.
        .option("parquet.bloom.filter.enabled#user_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(path)
    )


def table_folder(spark: SparkSession, name: str) -> str:
    """Where the table registered as ``name`` lies."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    return described.first()["data_type"]


def folds_folder(folder: str) -> str:
    """Beside the table, for the table's folder holds partitions only."""
    return folder.rstrip("/") + "-folds"


def read_folds(spark: SparkSession, folder: str) -> list[Row]:
    """What has been folded: in a month, an ingest's batches up to one now stand in ``fold_id``.

    There is one row per month, fold and ingest, however many batches were folded.
    """
    try:
        return spark.read.schema(FOLDS_DDL).parquet(folds_folder(folder)).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def superseded(folds: list[Row]) -> Column:
    """Rows of batches that stand in a fold, or of a fold that was not finished.

    The condition is on partition columns, so files of such rows are not opened.
    """
    # Null-safe, which spares the scan a check for null.
    gone = F.coalesce(F.col("ingest_id").startswith(FOLD_PREFIX), F.lit(False))
    for month, fold_id in {(f.event_month, f.fold_id) for f in folds}:
        gone = gone & ~((F.col("event_month") == month) & (F.col("ingest_id") == fold_id))
    for f in folds:
        gone = gone | (
            (F.col("event_month") == f.event_month) & (F.col("ingest_id") == f.ingest_id)
            & (F.col("batch_id") <= f.through_batch)
        )
    return gone


def read_table(spark: SparkSession, folder: str | None = None, name: str | None = None) -> DataFrame:
    """All columns, with the partition columns, of the table in a folder or of a registered name.

    A folder's schema is given, so no file is opened to infer it. Of folded
    batches the fold is read; see ``folding``.
    """
    if (folder is None) == (name is None):
        raise ValueError("give the table's folder or its registered name, and not both")
    # What is folded is looked up before the files are listed, so that a fold
    # finished in between adds nothing to this reader's rows.
    folds = read_folds(spark, table_folder(spark, name) if folder is None else folder)
    rows = spark.table(name) if folder is None else spark.read.schema(TABLE_DDL).parquet(folder)
    return rows.where(~superseded(folds))


def read_events(
    spark: SparkSession,
    folder: str | None = None,
    since: Column | datetime | None = None,
    until: Column | datetime | None = None,
    name: str | None = None,
) -> DataFrame:
    """Events of a time range, both ends included.

    The month predicate is derived from the range, because the planner does
    not know that the month follows from the timestamp.
    """
    rows = read_table(spark, folder, name)
    if since is not None:
        start = as_of_column(since, zoneless=True)
        rows = rows.where((F.col("event_month") >= month_key(start)) & (F.col("timestamp") >= start))
    if until is not None:
        end = as_of_column(until, zoneless=True)
        rows = rows.where((F.col("event_month") <= month_key(end)) & (F.col("timestamp") <= end))
    return rows.select(*EVENT_COLUMNS)


def read_window(
    spark: SparkSession,
    folder: str | None,
    window: str,
    as_of: Column | datetime | None = None,
    name: str | None = None,
) -> DataFrame:
    """Events that the operators' ``window`` before ``as_of`` can reach."""
    return read_events(spark, folder, since=window_start(window, as_of, zoneless=True), name=name)


def batch_counts(spark: SparkSession, folder: str | None = None, name: str | None = None) -> DataFrame:
    """Stored rows per batch, from the partition columns and the files' row counts alone.

    A fold of batches counts as one.
    """
    return read_table(spark, folder, name).groupBy("ingest_id", "batch_id").agg(F.count("*").alias("row_count"))
