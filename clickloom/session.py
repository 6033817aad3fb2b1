"""Session settings the package is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Bucket, month and text forms of times are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Sizes shuffle partitions, switches joins and splits skewed ones at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keeps large streaming state on local disk, with changes logged to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "clickloom", **settings: str) -> SparkSession:
    """A session with these settings and any given as ``**{key: value}``, which win."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
