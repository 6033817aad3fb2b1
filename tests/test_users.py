"""The copy by user: buckets read, shuffles spared, hot users, months not copied, folds done again."""

from datetime import timedelta

import pytest
from compare import spark_rows
from events import AS_OF, SCHEMA
from pyspark.sql import functions as F

from clickloom.operators import log
from clickloom.sources.folding import drop_folded, fold_month
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.table import read_events, write_events
from clickloom.sources.users import UserLayout


def events_of(spark, numbers):
    """Over a month's end; every second event is one user's, who has more than a bucket's share."""
    rows = [
        (f"e{n}", ("view", "purchase", "click")[n % 3], "hot" if n % 2 else f"u{n % 37}", f"p{n % 5}", n * 0.1,
         AS_OF - timedelta(minutes=11 * n), "c", "") for n in numbers
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def store(spark):
    folder = fresh_folder(spark, "users")
    for batch in range(3):
        write_events(events_of(spark, range(batch, 6_000, 4)), folder, "a", batch)
    for month in (202403, 202404, 202405):
        fold_month(spark, folder, month)
    layout = UserLayout(spark, "events_" + folder.rpartition("-")[2], folder, buckets=8)
    assert layout.write_month(202404) and layout.write_month(202405) and layout.write_month(202001) is None
    write_events(events_of(spark, range(3, 6_000, 400)), folder, "a", 3)
    return folder, layout


def same(spark, folder, layout):
    events = read_events(spark, folder)
    wanted = spark_rows(log.user_summaries(events, "30d", AS_OF))
    assert spark_rows(layout.summaries("30d", AS_OF)) == wanted
    for user in ("hot", "u4", "nobody"):
        assert spark_rows(log.user_summary(layout.of_user(user), user, "30d", AS_OF)) == spark_rows(
            log.user_summary(events, user, "30d", AS_OF))
        assert log.user_events(layout.of_user(user), user, "30d", AS_OF).collect() == log.user_events(
            events, user, "30d", AS_OF).collect()
    return wanted[1]


def test_same_rows_as_the_table(spark, store):
    folder, layout = store
    assert len(same(spark, folder, layout)) == 38


def test_hot_users_are_apart(spark, store):
    folder, layout = store
    cold, hot, rest = layout._parts()
    assert [r[0] for r in hot.select("user_id").distinct().collect()] == ["hot"] and hot.count() > 900
    assert cold.where("user_id = 'hot'").count() == 0 and rest.where("timestamp < '2024-04-01'").count() > 0


def test_a_lookup_reads_one_bucket(store):
    found = store[1]._parts()[0].where("user_id = 'u4'")
    parts = found._jdf.queryExecution().toRdd().partitions()
    files = [file.filePath().toString() for part in parts for file in part.files()]
    # One file of each of two months, of the same bucket.
    assert len(files) == 2 and len({file.rsplit("_", 1)[1] for file in files}) == 1
    assert len({row[0] for row in store[1]._parts()[0].select("_metadata.file_path").distinct().collect()}) > 8


def test_sums_of_all_users_need_no_shuffle(spark, store):
    folder, layout = store
    plan = log.user_summaries(layout._parts()[0], "30d", AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "count(distinct" in plan


def test_folds_done_again(spark, store):
    folder, layout = store
    old = layout._copied()
    fold_month(spark, folder, 202404)
    drop_folded(spark, folder)
    assert len(layout._copied()) == len(old) - 1
    same(spark, folder, layout)
    assert layout.write_month(202404)
    layout.drop_old()
    assert layout._partitions(layout._cold) == layout._copied()
    same(spark, folder, layout)
