"""An hourly rollup kept beside the event table, batch by batch.

It has three parts, each filed under the ingest and the batch that wrote it, so
that a batch run again replaces its own share and nothing else:

- ``hours``: per hour, event type and category the count and the parts of the
  price's exact sum, all of which add up over any hours and batches;
- ``codes``: a dense number for each user id, given by the first batch that
  meets the user and never changed;
- ``users``: per hour, bitmaps of the codes of its users, 32,768 to a bitmap,
  which OR together over any hours and batches.

One ingest at a time may extend a rollup, for codes must not be given twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.aggregates import money_parts
from clickloom.functions.times import month_key, utc_wall_clock
from clickloom.sources.folding import drop_folded, fold_batches
from clickloom.sources.scratch import scratch_folder
from clickloom.sources.table import PARTITION_COLUMNS, read_folds, superseded

MONEY_DDL = "cents_high BIGINT, cents_low BIGINT, rest_high BIGINT, rest_low BIGINT, large DECIMAL(38, 2), huge DOUBLE"
MONEY = tuple(column.split()[0] for column in MONEY_DDL.replace("(38, 2)", "").split(", "))
_FILED = ", event_month INT, ingest_id STRING, batch_id BIGINT"
HOURS_DDL = f"hour TIMESTAMP_NTZ, event_type STRING, category STRING, cnt BIGINT, {MONEY_DDL}{_FILED}"
USERS_DDL = f"hour TIMESTAMP_NTZ, bucket BIGINT, bitmap BINARY{_FILED}"
CODES_DDL = "user_id STRING, code BIGINT, ingest_id STRING, batch_id BIGINT"
# Of monotonically_increasing_id, the bits that number a partition's rows.
_ROW_BITS = 33


def hour_of(timestamp: str) -> Column:
    return F.date_trunc("hour", timestamp).cast("timestamp_ntz")


def hour_sums(events: DataFrame) -> DataFrame:
    """(hour, event_type, category, cnt and the money parts) of events, by what they share."""
    sums = [F.expr(f"{sql} AS {name}") for name, sql in money_parts("price").items()]
    return events.groupBy(hour_of("timestamp").alias("hour"), "event_type", "category").agg(
        F.count("*").alias("cnt"), *sums
    )


def bitmaps(coded: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bitmap) of the codes in a frame."""
    bits = coded.select(
        *keys, F.bitmap_bucket_number("code").alias("bucket"), F.bitmap_bit_position("code").alias("bit")
    )
    return bits.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _read(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def _visible(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    folds = read_folds(spark, folder)
    return _read(spark, folder, ddl).where(~superseded(folds))


def read_hours(spark: SparkSession, rollup: str) -> DataFrame:
    return _visible(spark, f"{rollup}/hours", HOURS_DDL)


def read_users(spark: SparkSession, rollup: str) -> DataFrame:
    return _visible(spark, f"{rollup}/users", USERS_DDL)


def read_codes(spark: SparkSession, rollup: str) -> DataFrame:
    return _read(spark, f"{rollup}/codes", CODES_DDL)


def _writer(rows: DataFrame, *partitions: str) -> DataFrameWriter:
    rows = rows.hint("rebalance", *[c for c in partitions if c == "event_month"])
    return rows.write.option("compression", "zstd").partitionBy(*partitions)


def _file(rows: DataFrame, folder: str) -> None:
    writer = _writer(rows, *PARTITION_COLUMNS).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(folder)


def _filed(rows: DataFrame, ingest_id: str, batch_id: int) -> DataFrame:
    return rows.withColumns({"ingest_id": F.lit(ingest_id), "batch_id": F.lit(batch_id).cast("bigint")})


def _numbered(users: DataFrame, first: int, scratch: str) -> DataFrame:
    """(user_id, code): consecutive codes from ``first`` in order of the ids, given by many tasks.

    The order fixes the codes, wherever the ranges of the tasks begin and end.
    """
    placed = users.repartitionByRange("user_id").sortWithinPartitions("user_id")
    placed = placed.withColumn("place", F.monotonically_increasing_id()).select(
        "user_id", F.shiftright("place", _ROW_BITS).alias("part"),
        F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("at"),
    )
    placed.write.parquet(scratch)
    spark = users.sparkSession
    placed = spark.read.schema(placed.schema).parquet(scratch)
    # One row per task, which the driver adds up.
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    starts, start = [], first
    for part, size in sizes:
        starts.append((part, start))
        start += size
    ranges = spark.createDataFrame(starts, "of BIGINT, start BIGINT")
    return placed.join(ranges, F.col("part") == F.col("of")).select("user_id", (F.col("start") + F.col("at")).alias("code"))


def _give_codes(events: DataFrame, rollup: str, ingest_id: str, batch_id: int) -> None:
    """Number the users that have no code yet; codes are only ever added, so a batch run again changes none."""
    known = read_codes(events.sparkSession, rollup)
    users = events.where("user_id IS NOT NULL").select("user_id").distinct()
    # Merged, here and wherever codes are joined: there are as many as users, too many to pass through the driver.
    new = users.join(known.select("user_id").hint("merge"), "user_id", "left_anti")
    last = known.agg(F.max("code")).first()[0] or 0
    with scratch_folder(events.sparkSession, "codes") as scratch:
        codes = _filed(_numbered(new, last + 1, scratch), ingest_id, batch_id)
        _writer(codes, "ingest_id", "batch_id").mode("append").parquet(f"{rollup}/codes")


def roll_up(events: DataFrame, rollup: str, ingest_id: str, batch_id: int = 0) -> None:
    """Add one batch of normalised events to the rollup, or replace its share if it was added before.

    As with ``write_events``, a batch that is run again must carry the same
    rows; it is then given the codes it had. An empty batch adds nothing. Null
    user ids are no users, empty ones are one.
    """
    events = utc_wall_clock(events)
    spark = events.sparkSession
    _give_codes(events, rollup, ingest_id, batch_id)
    seen = events.where("user_id IS NOT NULL").select(hour_of("timestamp").alias("hour"), "user_id").distinct()
    users = bitmaps(seen.join(read_codes(spark, rollup).select("user_id", "code").hint("merge"), "user_id"), "hour")
    for part, rows in (("users", users), ("hours", hour_sums(events))):
        month = rows.withColumn("event_month", month_key(F.col("hour")))
        _file(_filed(month, ingest_id, batch_id), f"{rollup}/{part}")


def merged_hours(hours: DataFrame) -> DataFrame:
    """One row per hour, event type and category."""
    sums = [F.sum(c).cast("decimal(38, 2)" if c == "large" else hours.schema[c].dataType).alias(c) for c in ("cnt", *MONEY)]
    return hours.groupBy("hour", "event_type", "category").agg(*sums)


def merged_users(users: DataFrame, *keys: str) -> DataFrame:
    """One bitmap per bucket, and per hour if that is a key."""
    return users.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def fold_rollup(spark: SparkSession, rollup: str, month: int) -> None:
    """Merge all batches that a month of the rollup has now, as ``fold_month`` does for the table."""

    def fold(part: str, rows: DataFrame, merge) -> None:
        def write(found: DataFrame, fold_id: str) -> None:
            merged = merge(found).withColumn("event_month", F.lit(month))
            _file(_filed(merged, fold_id, 0), f"{rollup}/{part}")

        fold_batches(spark, f"{rollup}/{part}", month, rows, write)

    fold("users", read_users(spark, rollup), lambda rows: merged_users(rows, "hour"))
    fold("hours", read_hours(spark, rollup), merged_hours)


def drop_folded_rollup(spark: SparkSession, rollup: str) -> int:
    """Delete the folders of folded batches, when no reader that began before the fold is left; how many there were."""
    return sum(drop_folded(spark, f"{rollup}/{part}") for part in ("users", "hours"))
