"""A second copy of folded months, laid out by user.

A month's fold is copied into a table bucketed by user, so that one user's
events lie in one bucket and all users can be summed up without a shuffle.
Users with more than a bucket's share of a month would make their bucket too
large; they go to a table of their own, which is not bucketed. Readers take the
copy of a month as long as it is of the fold that readers of the event table
see, and everything else from the event table itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.predicates import in_window
from clickloom.operators import log
from clickloom.sources.scratch import folder_exists
from clickloom.sources.table import FOLD_PREFIX, PARTITION_COLUMNS, read_folds, read_table
from clickloom.vocabulary import EVENT_COLUMNS, EVENT_DDL

BUCKETS = 64
_DDL = EVENT_DDL.replace("timestamp TIMESTAMP", "timestamp TIMESTAMP_NTZ") + ", event_month INT, fold_id STRING"


class UserLayout:
    """The copy by user of the event table in ``folder``, as two tables in the catalog named after ``name``.

    The number of buckets is fixed when the tables are first made. More buckets
    mean more tasks for a summary of all users, and smaller ones for a lookup.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS):
        self._spark, self._folder, self._buckets = spark, folder.rstrip("/"), buckets
        self._cold, self._hot = f"{name}_by_user", f"{name}_hot_users"
        bucketed = f"CLUSTERED BY (user_id) SORTED BY (user_id, timestamp) INTO {buckets} BUCKETS"
        for table, kind, beside in ((self._cold, bucketed, "by-user"), (self._hot, "", "hot-users")):
            location = f"{self._folder}-{beside}"
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({_DDL}) USING parquet PARTITIONED BY (event_month, fold_id) "
                f"{kind} LOCATION '{location}'"
            )
            if folder_exists(spark, location):
                spark.sql(f"MSCK REPAIR TABLE {table}")

    def write_month(self, month: int) -> str | None:
        """Copy the fold that a month has now; its id, or None if the month is not folded.

        Copying again replaces the copy. The fold must not be dropped meanwhile.
        """
        fold = self._folds().get(month)
        if fold is None:
            return None
        rows = read_table(self._spark, self._folder).where((F.col("event_month") == month) & (F.col("ingest_id") == fold))
        users = rows.groupBy("user_id").agg(F.count("*").alias("n"))
        total = rows.count()
        # Fewer than there are buckets.
        hot = [r.user_id for r in users.where(F.col("n") * self._buckets > total).select("user_id").collect()]
        is_hot = F.coalesce(F.col("user_id").isin(hot), F.lit(False)) if hot else F.lit(False)
        placed = rows.select(*EVENT_COLUMNS, "event_month", F.col("ingest_id").alias("fold_id"))
        # One task writes a bucket.
        self._replace(placed.where(~is_hot).repartition(self._buckets, "user_id"), self._cold)
        self._replace(placed.where(is_hot).hint("rebalance").sortWithinPartitions("event_month", "fold_id", "user_id"), self._hot)
        return fold

    def _replace(self, rows: DataFrame, table: str) -> None:
        before = self._spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self._spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.write.insertInto(table, overwrite=True)
        finally:
            self._spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        self._spark.catalog.refreshTable(table)

    def drop_old(self) -> None:
        """Take copies of folds that no reader sees any more out of the tables, with their files."""
        current = self._copied()
        for table in (self._cold, self._hot):
            for month, fold in self._partitions(table) - current:
                self._spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_month = {month}, fold_id = '{fold}')")

    def _folds(self) -> dict[int, str]:
        """The fold of each month that readers see: the one that no later fold holds."""
        folds = read_folds(self._spark, self._folder)
        held = {(f.event_month, f.ingest_id) for f in folds if f.ingest_id.startswith(FOLD_PREFIX)}
        return {f.event_month: f.fold_id for f in folds if (f.event_month, f.fold_id) not in held}

    def _partitions(self, table: str) -> set[tuple[int, str]]:
        rows = self._spark.sql(f"SHOW PARTITIONS {table}").collect()
        parts = [dict(part.split("=", 1) for part in r.partition.split("/")) for r in rows]
        return {(int(p["event_month"]), p["fold_id"]) for p in parts}

    def _copied(self) -> set[tuple[int, str]]:
        """Months that are read from the copy, and the folds they are copies of."""
        stored = self._partitions(self._cold) | self._partitions(self._hot)
        return {(month, fold) for month, fold in self._folds().items() if (month, fold) in stored}

    @staticmethod
    def _among(copied: set[tuple[int, str]], fold: str) -> Column:
        found = F.lit(False)
        for month, name in sorted(copied):
            found = found | ((F.col("event_month") == month) & (F.col(fold) == name))
        return found

    def _parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(bucketed rows, rows of hot users, rows that are in no copy), each with the event columns."""
        copied = self._copied()
        cold, hot = (self._spark.table(t).where(self._among(copied, "fold_id")) for t in (self._cold, self._hot))
        rest = read_table(self._spark, self._folder).where(~self._among(copied, PARTITION_COLUMNS[1]))
        return tuple(part.select(*EVENT_COLUMNS) for part in (cold, hot, rest))

    def of_user(self, user_id: str) -> DataFrame:
        """One user's events, from one bucket, the hot users' table, and what is not copied yet."""
        cold, hot, rest = (part.where(F.col("user_id") == F.lit(user_id)) for part in self._parts())
        return cold.unionByName(hot).unionByName(rest)

    def summaries(self, window: str = "7d", as_of: Column | datetime | None = None, bounded: bool = False) -> DataFrame:
        """The rows of ``log.user_summaries``.

        Users all of whose events are in the buckets are summed up where these
        lie; only the events of the others are shuffled.
        """
        cold, hot, rest = (in_window(part, window, as_of, bounded) for part in self._parts())
        others = hot.select("user_id").unionByName(rest.select("user_id")).distinct()
        same = cold["user_id"].eqNullSafe(others["user_id"])
        calm = log.user_summaries(cold.join(others, same, "left_anti"), window, as_of, bounded)
        moved = cold.join(others, same, "left_semi").unionByName(hot).unionByName(rest)
        return calm.unionByName(log.user_summaries(moved, window, as_of, bounded))
