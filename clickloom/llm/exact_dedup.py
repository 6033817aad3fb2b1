"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch of
documents is reduced to one row per digest before any shuffle ends, joined to
the index by a sort-merge anti-join that needs no shuffle of the index, and
the digests that were not there are appended. All of it is built-in functions.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import numbered, pick, restore, row_hash, settle
from clickloom.sources.scratch import fresh_folder

# A bucket is one sort unit of a task: an index made for a table has one per so many rows, and at least BUCKETS.
BUCKETS, ROWS_PER_BUCKET = 64, 1 << 20


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    hashed = F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))
    # Never null, and declared so: joins then need no filter and can share a shuffle of the rows.
    return F.coalesce(hashed, F.lit(b""))


def _beside(folder: str) -> str:
    return folder.rstrip("/") + "-buckets"


def _kept_buckets(spark: SparkSession, folder: str) -> int | None:
    try:
        return spark.read.schema("buckets INT").parquet(_beside(folder)).first()["buckets"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class DigestIndex:
    """Digests seen so far, each with the id of the document that stays.

    ``folder`` holds the table and outlives the session; opening it again goes
    on where the last one ended. Of one batch's equal texts the largest id
    stays; a text that the index already has stays with its first batch. The
    number of buckets is fixed when a folder is first used and kept beside it;
    opening it with another number raises, without one takes it from there.
    ``close`` takes the table out of the session's catalog; its files stay.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self._spark = spark
        kept = _kept_buckets(spark, folder)
        if kept is None:
            kept = BUCKETS if buckets is None else buckets
            beside = spark.range(1).select(F.lit(kept).alias("buckets"))
            beside.coalesce(1).write.parquet(_beside(folder))
        elif buckets not in (None, kept):
            raise ValueError(f"the index in {folder} has {kept} buckets, not {buckets}")
        self._buckets = buckets = kept
        self._table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self._table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def read(self) -> DataFrame:
        return self._spark.table(self._table)

    def close(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._table}")

    def unseen(self, digests: DataFrame) -> DataFrame:
        """One row (digest, keep_id) per digest that the index does not have."""
        batch = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return batch.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        """Add what is unseen of rows (doc_id, digest): one sorted file per bucket."""
        fresh = self.unseen(digests).select("digest", F.col("keep_id").cast("long"))
        # Settled first: a table cannot be read and extended by the same query.
        # Dealt by bucket, so that a bucket is written by one task whatever the number of partitions.
        bucket = F.pmod(F.hash("digest"), F.lit(self._buckets))
        fresh = settle(fresh, "unseen").repartition(self._buckets, bucket)
        (
            fresh.write.bucketBy(self._buckets, "digest").sortBy("digest")
            .format("parquet").mode("append").saveAsTable(self._table)
        )
        self._spark.catalog.refreshTable(self._table)


def index_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Put a whole table into the index, larger ids first, and return its rows (doc_id, digest).

    The larger half of the ids arrives before the smaller one, so that the
    largest id of equal texts is the one in the index.
    """
    return _indexed(_digests(docs), index)


def _digests(docs: DataFrame) -> DataFrame:
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", digest(F.col("text")).alias("digest"))
    return settle(rows, "digests")


def _indexed(rows: DataFrame, index: DigestIndex) -> DataFrame:
    middle = rows.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first()["m"]
    early = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    index.append(rows.where(early))
    index.append(rows.where(~early))
    return rows


def verdicts(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    Equal texts form a group; null text is empty text. The row with the largest
    doc_id stays; null ids count as smaller than any. Of fully repeated rows
    (same id, same text) exactly one stays. Without documents the result is
    empty. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = _digests(docs)
    own = index is None
    if own:
        # A bucket is a task's share of the joins with the index, so there are as many as shuffles have at least.
        buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_BUCKET))
        index = DigestIndex(spark, fresh_folder(spark, "digest-index"), buckets)
    _indexed(rows, index)
    ids = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("repeats"))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    # Settled, so that a digest with very many ids can be split over tasks.
    groups = settle(sizes.join(index.read().hint("merge"), "digest"), "groups")
    if own:
        index.close()
    judged = ids.join(groups, "digest")
    return judged.select(
        "doc_id", "digest", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).drop("copy")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; cases as in ``verdicts``.

    Texts are not shuffled unless the list of rows to drop is too large for a
    broadcast, which Spark decides by its size.
    """
    judged = settle(verdicts(docs), "exact-verdicts")
    repeated = judged.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    rows, names = numbered(docs, doc_id="doc_id", text="text")
    rows = rows.withColumn("digest", digest(F.col("text"))).drop("text")

    def against(frame: DataFrame, other: DataFrame, how: str) -> DataFrame:
        same = frame["doc_id"].eqNullSafe(other["doc_id"]) & (frame["digest"] == other["digest"])
        return frame.join(other, same, how)

    sole = against(rows, repeated.where(~F.col("kept") | (F.col("n") > 1)), "left_anti")
    several = against(rows, repeated.where(F.col("kept") & (F.col("n") > 1)), "left_semi")
    alike = W.partitionBy("digest", "doc_id").orderBy(row_hash(rows, [f"_{i}" for i in range(len(names))]))
    one = several.withColumn("rank", F.row_number().over(alike)).where("rank = 1").drop("rank")
    return restore(sole.unionByName(one), names)
