"""The pipeline: every stage on awkward rows, and the whole on the table."""

import pytest
from awkward import AWKWARD
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, awkward, nothing, name, stage):
    out = stage(spark, awkward, SF_DIR)
    assert out.columns == awkward.columns
    kept = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert kept <= {r[:2] for r in AWKWARD}
    assert stage(spark, nothing, SF_DIR).count() == 0


def test_every_decision_takes_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    mixed = driver.queries()["pipeline"](spark, SF_DIR)
    assert mixed.columns == docs.columns
    once = mixed.dropDuplicates(["doc_id"])
    assert once.join(docs, docs.columns, "left_anti").count() == 0
    assert once.groupBy("text").count().where("count > 1").count() == 0
    texts = [r.text for r in once.collect()]
    assert not any(item in text for item in benchmark for text in texts)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = once.join(labels, "doc_id").agg(F.avg("quality"), F.count("*")).first()
    assert judged[0] > 0.95 and judged[1] > 20
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0


def test_registered(spark):
    names = set(driver.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
