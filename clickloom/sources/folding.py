"""Folding: the many small batches of a month become one batch of few files.

A fold is written as one more batch, whose rows readers do not see yet. A record
of what it holds, one small file beside the table, is what finishes it: from
then on readers see the fold and not the batches. So no reader meets rows twice
or misses them, and a fold that crashed has done nothing. The batches' folders
stay, for readers that began earlier, until ``drop_folded``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.ids import ids_folder, read_filters, write_filter
from clickloom.sources.scratch import delete_folder
from clickloom.sources.table import (
    FOLD_PREFIX, FOLDS_DDL, add_partitions, folds_folder, read_folds, read_table, write_events,
)
from clickloom.vocabulary import EVENT_COLUMNS

# Partitions named in one statement, and folders deleted at a time.
_AT_ONCE, _THREADS = 500, 16


def fold_batches(
    spark: SparkSession, folder: str, month: int, rows: DataFrame, write: Callable[[DataFrame, str], None]
) -> str | None:
    """Fold the batches that ``rows``, a table's visible rows with partition columns, has of a month; the fold's id.

    ``write`` files the folded rows under the ingest id it is given. The record
    that makes them count is written last. None if there are fewer than two batches.
    """
    rows = rows.where(F.col("event_month") == month)
    # Partition values only; one row per ingest.
    seen = rows.groupBy("ingest_id").agg(
        F.max("batch_id").alias("through_batch"), F.count_distinct("batch_id").alias("batches")
    ).collect()
    if sum(s.batches for s in seen) < 2:
        return None
    fold_id = FOLD_PREFIX + uuid.uuid4().hex
    known = F.lit(False)
    for s in seen:
        known = known | ((F.col("ingest_id") == s.ingest_id) & (F.col("batch_id") <= s.through_batch))
    write(rows.where(known), fold_id)
    records = [(month, fold_id, s.ingest_id, s.through_batch) for s in seen]
    # One file, which appears as a whole when the write is committed.
    spark.createDataFrame(records, FOLDS_DDL).coalesce(1).write.mode("append").parquet(folds_folder(folder))
    return fold_id


def fold_month(spark: SparkSession, folder: str, month: int, name: str | None = None) -> str | None:
    """Fold all batches that ``month``, such as 202401, has now; the fold's ingest id, or None.

    An ingest may go on meanwhile: it writes its batches in order, so all up to
    the last one seen are whole, and later ones stay as they are, for the next
    fold. A folded batch that is run again after a crash stays folded. One fold
    of a month must run at a time. Nothing is written for a month with fewer
    than two batches. ``name`` is the registered name, if the table has one.
    """

    def write(rows: DataFrame, fold_id: str) -> None:
        write_events(rows.select(*EVENT_COLUMNS), folder, fold_id)
        if not read_filters(spark, folder).isEmpty():
            write_filter(rows.select("event_id", "event_month"), folder, fold_id)
        if name is not None:
            add_partitions(spark, name, [month], fold_id, 0)

    return fold_batches(spark, folder, month, read_table(spark, folder), write)


def drop_folded(spark: SparkSession, folder: str, name: str | None = None) -> int:
    """Delete the folders of batches that stand in a finished fold; how many there were.

    To be called when no reader that began before the fold is left. Unfinished
    folds are left alone, as one may be under way. Deleting again what is left
    after a crash is harmless.
    """
    folds = read_folds(spark, folder)
    dropped = 0
    for month, ingest in sorted({(f.event_month, f.ingest_id) for f in folds}):
        through = max(f.through_batch for f in folds if (f.event_month, f.ingest_id) == (month, ingest))
        below = f"event_month={month}/ingest_id={ingest}"
        batches = _batches(spark, f"{folder.rstrip('/')}/{below}", through)
        if name is not None:
            _drop_partitions(spark, name, month, ingest, batches)
        for root in (folder.rstrip("/"), ids_folder(folder)):
            _delete_all(spark, [f"{root}/{below}/batch_id={batch}" for batch in batches])
        dropped += len(batches)
    if name is not None:
        spark.catalog.refreshTable(name)
    return dropped


def _batches(spark: SparkSession, root: str, through: int) -> list[int]:
    """The batches up to one that have a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [int(status.getPath().getName().removeprefix("batch_id=")) for status in files.listStatus(path)]
    return sorted(batch for batch in found if batch <= through)


def _drop_partitions(spark: SparkSession, name: str, month: int, ingest: str, batches: list[int]) -> None:
    """Take partitions out of the catalog, many to a statement."""
    for at in range(0, len(batches), _AT_ONCE):
        listed = ", ".join(
            f"PARTITION (event_month = {month}, ingest_id = '{ingest}', batch_id = {batch})"
            for batch in batches[at:at + _AT_ONCE]
        )
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {listed}")


def _delete_all(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders several at a time: it is the store's answers that take the time."""
    with ThreadPoolExecutor(_THREADS) as pool:
        list(pool.map(lambda folder: delete_folder(spark, folder), folders))
