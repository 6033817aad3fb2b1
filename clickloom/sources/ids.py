"""Filters of the event ids in the table, so that no event is stored twice, whenever its copies arrive.

For each batch, in each month it has rows of, a filter tells whether an id may
be among them. It consists of blocks, bitmaps of 32,768 bits; a hash of the id
chooses the block, others the bits in it. A new batch asks all filters. Only
batches of which some filter says maybe are opened, and their ids compared.
Filters lie beside the table under the same partitions, so a batch run again
replaces its own, and the record of folds holds for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.scratch import scratch_folder
from clickloom.sources.table import PARTITION_COLUMNS, read_folds, read_table, superseded
from clickloom.vocabulary import EVENT_COLUMNS

PARTITIONS_DDL = "event_month INT, ingest_id STRING, batch_id BIGINT"
FILTER_DDL = f"blocks BIGINT, block BIGINT, bitmap BINARY, {PARTITIONS_DDL}"
BLOCK_BITS = 1 << 15
# Bits set for an id, and bits of the filter per id at least: less than one in 100,000 other ids passes.
HASHES, BITS_PER_ID = 8, 32


def ids_folder(folder: str) -> str:
    """Beside the table, for the table's folder holds partitions only."""
    return folder.rstrip("/") + "-ids"


def has_id() -> Column:
    """An id that is null or empty is none: such events are never copies of each other."""
    return F.coalesce(F.col("event_id"), F.lit("")) != ""


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "event_id")


def _block(blocks: Column) -> Column:
    return F.pmod(_hash(0), blocks)


def _bit(number: int) -> Column:
    # An odd step reaches all bits of a block.
    step = _hash(2).bitwiseOR(F.lit(1))
    return F.pmod(_hash(1).bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(number) * step.bitwiseAND(F.lit((1 << 40) - 1)), F.lit(BLOCK_BITS))


def _is_set(bitmap: str, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1


def read_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The filters of all batches and folds that readers of the table see."""
    folds = read_folds(spark, folder)
    try:
        filters = spark.read.schema(FILTER_DDL).parquet(ids_folder(folder))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        filters = spark.createDataFrame([], FILTER_DDL)
    return filters.where(~superseded(folds))


def _filters(ids: DataFrame) -> DataFrame:
    """(event_month, blocks, block, bitmap) of ids and their months."""
    sizes = ids.groupBy("event_month").agg(F.count("*").alias("n"))
    # A power of two, so that ids are placed for few different sizes when they ask.
    needed = F.greatest(F.ceil(F.col("n") * BITS_PER_ID / BLOCK_BITS), F.lit(1))
    sizes = sizes.select("event_month", F.pow(F.lit(2), F.ceil(F.log2(needed))).cast("bigint").alias("blocks"))
    # Shuffled as ids, before there are bitmaps: each task would have its own of nearly every block.
    blocked = ids.join(sizes, "event_month").withColumn("block", _block(F.col("blocks")))
    placed = blocked.repartition("event_month", "blocks", "block").select(
        "event_month", "blocks", "block", F.explode(F.array(*[_bit(i) for i in range(HASHES)])).alias("bit"),
    )
    return placed.groupBy("event_month", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def write_filter(stored: DataFrame, folder: str, ingest_id: str, batch_id: int = 0) -> None:
    """File the filters of one batch's stored rows, (event_id, event_month), one per month."""
    filters = _filters(stored.where(has_id()).select("event_id", "event_month"))
    (
        filters.withColumns({"ingest_id": F.lit(ingest_id), "batch_id": F.lit(batch_id).cast("bigint")})
        .hint("rebalance", "event_month")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(*PARTITION_COLUMNS).parquet(ids_folder(folder))
    )


def batch_rows(spark: SparkSession, folder: str, ingest_id: str, batch_id: int) -> DataFrame:
    """(event_id, event_month) of what a batch has stored."""
    own = (F.col("ingest_id") == ingest_id) & (F.col("batch_id") == batch_id)
    return read_table(spark, folder).where(own).select("event_id", "event_month")


def candidates(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """(event_id and partition columns): ids, and batches that may hold them."""
    # Powers of two, so a few dozen at most.
    sizes = [r.blocks for r in filters.select("blocks").distinct().collect()]
    asked = ids.withColumn("blocks", F.explode(F.array(*map(F.lit, sizes)).cast("array<bigint>")))
    joined = asked.withColumn("block", _block(F.col("blocks"))).join(filters, ["blocks", "block"])
    for number in range(HASHES):
        joined = joined.where(_is_set("bitmap", _bit(number)))
    return joined.select("event_id", *PARTITION_COLUMNS)


@contextmanager
def without_copies(events: DataFrame, folder: str, ingest_id: str, batch_id: int) -> Iterator[DataFrame]:
    """A batch's events, one of each id, without those whose id another batch has stored.

    Only batches that a filter names are read, and of these only the ids, so
    what a filter takes for another does no harm. The frame is good inside
    the ``with`` block.
    """
    spark = events.sparkSession
    once = one_of_each(events)
    other = ~((F.col("ingest_id") == ingest_id) & (F.col("batch_id") == batch_id))
    with scratch_folder(spark, "candidates") as scratch:
        # Written, as the batches are looked up first and the ids compared then.
        filters = read_filters(spark, folder).where(other)
        candidates(once.where(has_id()).select("event_id"), filters).write.parquet(scratch)
        maybe = spark.read.schema(f"event_id STRING, {PARTITIONS_DDL}").parquet(scratch)
        # At most one row per month and batch not yet folded.
        named = maybe.select(*PARTITION_COLUMNS).distinct().collect()
        if named:
            stored = read_named(spark, folder, named).select("event_id")
            found = stored.join(maybe.select("event_id"), "event_id", "left_semi").distinct()
            once = once.join(found, "event_id", "left_anti").select(*EVENT_COLUMNS)
        yield once


def read_named(spark: SparkSession, folder: str, batches: list) -> DataFrame:
    """The table's rows of some batches in some months, by a condition on partition columns alone."""
    named = F.lit(False)
    for batch in batches:
        named = named | (
            (F.col("event_month") == batch.event_month) & (F.col("ingest_id") == batch.ingest_id)
            & (F.col("batch_id") == batch.batch_id)
        )
    return read_table(spark, folder).where(named)


def one_of_each(events: DataFrame) -> DataFrame:
    """Of events sharing an id the least by all columns; events without one all stay."""
    kept = events.select(*EVENT_COLUMNS)
    least = kept.where(has_id()).groupBy("event_id").agg(F.min(F.struct(*EVENT_COLUMNS)).alias("least"))
    return kept.where(~has_id()).unionByName(least.select("least.*"))
