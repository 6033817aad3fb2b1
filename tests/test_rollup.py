"""The rollup against the operators on rows: replay, late rows, folds, cut edges, codes that stay."""

from datetime import datetime, timedelta

import pytest
from compare import spark_rows
from events import AS_OF, SCHEMA
from pyspark.sql import functions as F

from clickloom.operators import metrics, rolled
from clickloom.sources.folding import drop_folded, fold_month
from clickloom.sources.messages import encode
from clickloom.sources.rollup import (
    drop_folded_rollup, fold_rollup, read_codes, read_hours, read_users, roll_up,
)
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.sources.table import read_events, write_events
from clickloom.streaming.pipeline import start_ingest

KINDS = ("view", "click", "add_to_cart", "purchase", "search")
MOMENT = datetime(2024, 5, 1, 12, 20, 30)


def events_of(spark, numbers):
    """One event every 97 s back from MOMENT + 5 min, over a month's end; a user has a third of them, one is empty."""
    rows = []
    for n in numbers:
        user = "u_hot" if n % 3 == 0 else "" if n % 50 == 1 else f"u_{n * 7 % 800}"
        rows.append((f"e{n}", KINDS[n % 5], user, f"p{n % 9}", n * 0.37, MOMENT + timedelta(minutes=5, seconds=-97 * n), f"c{n % 4}", ""))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def store(spark):
    folder = fresh_folder(spark, "rolled")
    table, rollup = f"{folder}/table", f"{folder}/rollup"

    def add(batch, numbers):
        write_events(events_of(spark, numbers), table, "a", batch)
        roll_up(events_of(spark, numbers), rollup, "a", batch)

    add(0, range(0, 1500, 2))
    add(1, range(1, 900, 2))
    add(2, range(901, 2000, 2))
    codes = {r.user_id: r.code for r in read_codes(spark, rollup).collect()}
    add(1, range(1, 900, 2))
    assert {r.user_id: r.code for r in read_codes(spark, rollup).collect()} == codes
    for month in (202404, 202405):
        fold_month(spark, table, month)
        fold_rollup(spark, rollup, month)
    drop_folded(spark, table)
    assert drop_folded_rollup(spark, rollup) == 10
    add(3, range(1500, 2600, 2))
    assert codes.items() <= {r.user_id: r.code for r in read_codes(spark, rollup).collect()}.items()
    return table, rollup


def same(store, spark, name, window, **arguments):
    events = read_events(spark, store[0])
    plain = spark_rows(getattr(metrics, name)(events, window=window, as_of=MOMENT, **arguments))
    assert spark_rows(getattr(rolled, name)(spark, *store, window, as_of=MOMENT, **arguments)) == plain
    return plain


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("window", ["1h", "24h", "30d"])
def test_overview(store, spark, window, bounded):
    rows = same(store, spark, "overview", window, bounded=bounded)[1]
    assert rows[0][5] > 0


@pytest.mark.parametrize("name,arguments", [
    ("funnel", {}), ("funnel", {"category": "c2"}), ("timeseries", {"bucket": "day"}), ("timeseries", {"event_type": "search"}),
    ("top_categories", {}), ("revenue", {}), ("revenue", {"bucket": "day", "bounded": True}), ("revenue_totals", {}),
])
def test_other_operators(store, spark, name, arguments):
    assert same(store, spark, name, "7d", **arguments)[1]


def test_whole_hours_have_no_edge(store, spark):
    moment = datetime(2024, 5, 1, 12)
    stitched = rolled.Stitched(spark, *store, "6h", moment, bounded=True)
    assert stitched.edges().where("timestamp <> TIMESTAMP_NTZ '2024-05-01 12:00:00'").count() == 0
    plain = metrics.overview(read_events(spark, store[0]), "6h", moment, bounded=True)
    assert spark_rows(rolled.overview(spark, *store, "6h", as_of=moment, bounded=True)) == spark_rows(plain)


def test_codes_are_dense_and_bitmaps_merge(store, spark):
    codes = sorted(r.code for r in read_codes(spark, store[1]).collect())
    users = read_events(spark, store[0]).select("user_id").distinct().count()
    assert codes == list(range(1, users + 1))
    hours = read_users(spark, store[1]).groupBy("hour", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    seen = read_events(spark, store[0]).select(F.date_trunc("hour", "timestamp"), "user_id").distinct()
    assert hours.agg(F.sum("n")).first()[0] == seen.count()


def test_codes_of_more_than_one_bitmap(spark):
    folder = fresh_folder(spark, "wide")
    events = spark.range(0, 100_000, 1, 4).selectExpr(
        "CAST(id AS STRING) event_id", "'view' event_type", "concat('u', id % 70000) user_id", "'p' product_id", "1D price",
        "TIMESTAMP_NTZ '2024-05-01 10:00:00' + make_dt_interval(0, 0, 0, id % 7200) AS timestamp", "'c' category", "'' ip_address",
    )
    write_events(events, f"{folder}/table", "a")
    roll_up(events, f"{folder}/rollup", "a")
    assert read_users(spark, f"{folder}/rollup").select("bucket").distinct().count() == 3
    assert rolled.unique_users(spark, f"{folder}/table", f"{folder}/rollup", "24h", as_of=AS_OF).first()[0] == 70_000
    some = rolled.unique_users(spark, f"{folder}/table", f"{folder}/rollup", "1h", as_of=datetime(2024, 5, 1, 11, 30), bounded=True)
    hour = events.where("timestamp >= TIMESTAMP_NTZ '2024-05-01 10:30:00' AND timestamp <= TIMESTAMP_NTZ '2024-05-01 11:30:00'")
    assert some.first()[0] == hour.select("user_id").distinct().count()


def test_nothing_stored(spark):
    folder = fresh_folder(spark, "empty")
    write_events(events_of(spark, [3]), f"{folder}/table", "a")
    roll_up(events_of(spark, []), f"{folder}/rollup", "a")
    old = datetime(2020, 1, 1)
    rows = rolled.overview(spark, f"{folder}/table", f"{folder}/rollup", as_of=datetime(2030, 1, 1))
    assert spark_rows(rows) == spark_rows(metrics.overview(read_events(spark, f"{folder}/table"), "24h", datetime(2030, 1, 1)))
    assert rolled.unique_users(spark, f"{folder}/table", f"{folder}/rollup", as_of=old, bounded=True).first()[0] == 0


def test_minutes_are_not_kept(store, spark):
    with pytest.raises(ValueError):
        rolled.timeseries(spark, *store, bucket="minute")


def test_only_the_cut_hours_of_the_table_are_read(store, spark):
    """The scan of the table is bounded on both sides of each edge; sums of other hours come from the rollup."""
    frame = rolled.revenue_totals(spark, *store, "7d", as_of=MOMENT, bounded=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "user_id" not in line.split("]")[0]]
    raw = [s for s in scans if "cents_high" not in s.split("]")[0]]
    assert len(raw) == 2 and len(scans) == 3
    for scan, low, high in zip(raw, ("2024-04-24T12:20:30", "2024-05-01T12:00"), ("2024-04-24T13:00", "2024-05-01T12:20:30")):
        pushed = scan[scan.index("PushedFilters"):]
        assert f"GreaterThanOrEqual(timestamp,{low}" in pushed and f"timestamp,{high}" in pushed and "LessThan" in pushed
        assert "event_month" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]


def test_the_ingest_keeps_a_rollup(spark):
    """Several batches, a restart, and a batch that fails after its rows were written and runs again."""
    folder = fresh_folder(spark, "stream")
    table, rollup = f"{folder}/table", f"{folder}/rollup"

    def run(numbers, **settings):
        encode(events_of(spark, numbers)).coalesce(1).write.mode("append").text(f"{folder}/in")
        messages = read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)
        query = start_ingest(messages, table, f"{folder}/checkpoint", every=None, rollup=rollup, **settings)
        query.awaitTermination()

    run(range(0, 300))

    def fail(batch_id, rows):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(range(300, 500), on_batch=fail)
    assert read_events(spark, table).count() == 500 and read_hours(spark, rollup).agg(F.sum("cnt")).first()[0] == 300
    run(range(500, 600))
    plain = metrics.overview(read_events(spark, table), "24h", MOMENT)
    assert read_hours(spark, rollup).agg(F.sum("cnt")).first()[0] == 600
    assert spark_rows(rolled.overview(spark, table, rollup, as_of=MOMENT)) == spark_rows(plain)
