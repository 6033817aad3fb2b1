"""Folders for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    It is ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one process, may do without and uses the warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """The path of a folder nobody has used yet; Spark creates it when writing."""
    return f"{shared_root(spark).rstrip('/')}/clickloom-{purpose}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; it need not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_folder(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A fresh folder that is deleted at the end of the ``with`` block."""
    path = fresh_folder(spark, purpose)
    try:
        yield path
    finally:
        delete_folder(spark, path)
