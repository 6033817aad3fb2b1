from __future__ import annotations

import sys
from datetime import timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from events import AS_OF, SCHEMA  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """A frame from (event_id, event_type, user_id, product_id, price, seconds before AS_OF[, category])."""

    def make(rows, zoned=False):
        full = [
            (r[0], r[1], r[2], r[3], float(r[4]), AS_OF - timedelta(seconds=r[5]), r[6] if len(r) > 6 else "c", "ip")
            for r in rows
        ]
        frame = spark.createDataFrame(full, SCHEMA)
        if zoned:
            frame = frame.withColumn("timestamp", frame["timestamp"].cast("timestamp"))
        return frame

    return make
