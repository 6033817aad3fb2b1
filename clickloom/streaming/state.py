"""What queries with keyed state share: the state store, and records that each batch replaces or adds to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ADAPTIVE = "spark.sql.adaptive.enabled"
_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"
_EMPTY_RULE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Batches whose record is kept: the one before the running one, and one to spare.
_RECORDS = 3


@contextmanager
def keyed_state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, as keyed state needs; the session's settings come back.

    ``partitions`` of the state are fixed when a query first starts; without it
    they are the session's shuffle partitions.
    """
    wanted = {_PROVIDER: _ROCKSDB}
    if partitions is not None:
        wanted[_PARTITIONS] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def planned_adaptively(batch: DataFrame, events: DataFrame) -> Iterator[None]:
    """What is meanwhile done with a micro-batch of a stream is planned adaptively if the stream's session wants that.

    Spark switches it off in the session of a query with state, for the state's
    sake; the batch has been planned by then. Without it, rebalancing is left out,
    and each partition of the state is written whole by one task.
    """
    conf = batch.sparkSession.conf
    # An empty batch must not be planned away: its rows are counted on their way.
    excluded = ",".join(filter(None, (conf.get(_EXCLUDED, None), _EMPTY_RULE)))
    wanted = {_ADAPTIVE: events.sparkSession.conf.get(_ADAPTIVE), _EXCLUDED: excluded}
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def file_batch(rows: DataFrame, folder: str, query_id: str, batch_id: int) -> None:
    """File rows under their query and batch; a batch that is run again replaces its own."""
    (
        rows.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("bigint")})
        .hint("rebalance")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("query_id", "batch_id").parquet(folder)
    )


def read_filed(spark: SparkSession, folder: str, ddl: str, query_id: str) -> DataFrame:
    """All rows a query has filed; none if it has filed nothing yet."""
    try:
        rows = spark.read.schema(f"{ddl}, query_id STRING, batch_id BIGINT").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{ddl}, query_id STRING, batch_id BIGINT")
    return rows.where(F.col("query_id") == F.lit(str(query_id)))


def latest_record(spark: SparkSession, folder: str, ddl: str, query_id: str, before: int | None = None) -> DataFrame:
    """What the last batch, or the last one before a batch, has recorded."""
    rows = read_filed(spark, folder, ddl, query_id)
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == F.lit(-1 if last is None else last)).drop("query_id", "batch_id")


def carry_record(
    spark: SparkSession, folder: str, ddl: str, query_id: str, batch_id: int, add: Callable[[DataFrame], DataFrame]
) -> None:
    """Record for a batch what ``add`` makes of the record before it; older records go.

    A batch that is run again starts from the same record, which still stands.
    """
    file_batch(add(latest_record(spark, folder, ddl, query_id, batch_id)), folder, query_id, batch_id)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{folder}/query_id={query_id}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # As long as there is nothing to record, there is no folder either.
    for status in files.listStatus(root) if files.exists(root) else []:
        if int(status.getPath().getName().removeprefix("batch_id=")) <= batch_id - _RECORDS:
            files.delete(status.getPath(), True)
