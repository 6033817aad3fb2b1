"""Every operator as a named query over the driver's tables.

``as_of`` is the time of the newest event. Streaming queries run to the end of
their input when called, each with a checkpoint and an output folder of its
own, and return what they stored.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.aggregates import money_sum
from clickloom.functions.predicates import in_window
from clickloom.functions.times import iso_text, live_start, window_start
from clickloom.operators import keyset, log, metrics, rolled, shaping
from clickloom.plans.reports import Reports
from clickloom.sources.fixtures import fixture_events, latest_second
from clickloom.sources.folding import drop_folded, fold_month
from clickloom.sources.messages import decode, encode, is_valid, normalize
from clickloom.sources.rollup import drop_folded_rollup, fold_rollup, roll_up
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.sources.table import batch_counts, read_events, read_table, write_events
from clickloom.sources.users import UserLayout
from clickloom.streaming import journeys, live, minutes
from clickloom.streaming.offsets import audit
from clickloom.streaming.pipeline import read_quarantine, start_ingest
from clickloom.streaming.progress import ProgressTable, read_progress
from clickloom.vocabulary import PURCHASE, WINDOWS

Query = Callable[[SparkSession, str], DataFrame]

FIXTURE_STAGES = ("view", "click", "signup", "purchase")
JOURNEY_STAGES = ("signup", "view", "click", "purchase")


def _windowed(
    operator: Callable[..., DataFrame],
    window: str,
    with_category: bool = False,
    raw_user: int | None = None,
    **arguments,
) -> Query:
    """``operator`` over the fixture events, at the time of the newest event.

    ``raw_user`` is the fixture's number of the one user asked for.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_of = latest_second(spark, sf_dir)
        reachable = F.col("ts") >= window_start(window, as_of, zoneless=True)
        if raw_user is not None:
            reachable = reachable & (F.col("user_id") == raw_user)
        events = fixture_events(spark, sf_dir, reachable, with_category)
        return operator(events, window=window, as_of=as_of, **arguments)

    return run


def _live(operator: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_of = latest_second(spark, sf_dir)
        reachable = F.col("ts") >= live_start(as_of, zoneless=True)
        return operator(fixture_events(spark, sf_dir, reachable, with_category=False), as_of=as_of)

    return run


def _realtime_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live minutes as of an event an hour or more ago, to which all later ones lie in the future."""
    as_of = latest_second(spark, sf_dir, before=latest_second(spark, sf_dir) - timedelta(hours=1))
    return metrics.realtime(fixture_events(spark, sf_dir, with_category=False), as_of=as_of, bounded=True)


def _then(query: Query, shape: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: shape(query(spark, sf_dir))


# --- batch ------------------------------------------------------------------

def _window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all windows, from one pass over the longest."""
    as_of = latest_second(spark, sf_dir)
    longest = max(WINDOWS, key=WINDOWS.get)
    reachable = F.col("ts") >= window_start(longest, as_of, zoneless=True)
    events = in_window(fixture_events(spark, sf_dir, reachable, with_category=False), longest, as_of)
    totals = []
    for name in WINDOWS:
        inside = f"timestamp >= TIMESTAMP_NTZ '{as_of}' - INTERVAL '{WINDOWS[name]}' HOUR"
        totals.append(F.struct(
            F.lit(name).alias("window"),
            F.expr(f"count_if({inside}) AS total_events"),
            money_sum(f"CASE WHEN {inside} AND event_type = '{PURCHASE}' THEN price END").alias("revenue"),
        ))
    return events.agg(F.array(*totals).alias("totals")).select(F.inline("totals"))


def _event_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.event_total(fixture_events(spark, sf_dir, with_category=False))


_CATEGORIES = _windowed(metrics.top_categories, "30d", with_category=True)
_TOP_EIGHT = _windowed(metrics.top_products, "30d", with_category=True, limit=8)
_PAGE = _windowed(log.list_events, "30d", with_category=True, limit=20, offset=20)


def _of_all(operator: Callable[..., DataFrame], change: Callable[[DataFrame], DataFrame], **arguments) -> Query:
    """``operator`` over changed fixture events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_of = latest_second(spark, sf_dir)
        return operator(change(fixture_events(spark, sf_dir)), window="30d", as_of=as_of, **arguments)

    return run


def _some_null_ids(events: DataFrame) -> DataFrame:
    """A third of the events lose their id."""
    return events.withColumn("event_id", F.expr("CASE WHEN CAST(event_id AS BIGINT) % 3 <> 0 THEN event_id END"))


def _one_hot_second(events: DataFrame) -> DataFrame:
    """Half of the events happen in one second, and all ids begin alike."""
    moved = "CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN TIMESTAMP_NTZ '2024-01-20 12:00:00' ELSE timestamp END"
    return events.withColumn("timestamp", F.expr(moved)).withColumn("event_id", F.expr("concat('evt-2024-', event_id)"))


def _large_amounts(events: DataFrame) -> DataFrame:
    return events.withColumn("price", F.expr("rint(price * 100) * 10000D"))


def _page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.page_info(_PAGE(spark, sf_dir), limit=20, offset=20)


def _cvr_bands(categories: DataFrame) -> DataFrame:
    return categories.select("category", "cvr_pct", shaping.cvr_band(F.col("cvr_pct")).alias("band"))


def _priced(page: DataFrame) -> DataFrame:
    return page.select(
        "event_id", "event_type", "timestamp",
        shaping.shown_price(F.col("event_type"), F.col("price")).alias("shown_price"),
    )


def _keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a moment in mid-window, the next one, and from there back again; ids are missing, rows repeated."""
    as_of = latest_second(spark, sf_dir)
    events = _one_hot_second(fixture_events(spark, sf_dir, with_category=False))
    events = events.withColumn("event_id", F.expr("CASE WHEN event_type <> 'error' THEN event_id END"))
    events = events.unionByName(events.where("price < 5"))
    pages, cursor = [], keyset.cursor_at(as_of.replace(day=20, hour=12, minute=0, second=0))
    for name, backwards in (("first", False), ("next", False), ("back", True)):
        page = keyset.page_after(events, cursor, 40, backwards, window="30d", as_of=as_of)
        pages.append(page.drop("cursor").withColumn("page", F.lit(name)))
        if name != "back":
            ends = [r.cursor for r in page.select("cursor").collect()]
            # The next page goes on from the last row; from its first row one goes back.
            cursor = ends[-1]
            if name == "next":
                cursor = ends[0]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


# --- messages and table -----------------------------------------------------

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(fixture_events(spark, sf_dir, whole_seconds=False))


def _as_text(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", iso_text(F.col("timestamp")))


def _decode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(normalize(decode(_messages(spark, sf_dir))))


def _damaged(events: DataFrame) -> DataFrame:
    """Messages: those of errors lose their first character, those of sign-ups their time."""
    on_error = F.col("value").contains('"event_type":"error"')
    on_signup = F.col("value").contains('"event_type":"signup"')
    return encode(events).select(
        F.when(on_error, F.expr("substring(value, 2)"))
        .when(on_signup, F.replace("value", F.lit('"timestamp":"'), F.lit('"timestamp":"?')))
        .otherwise(F.col("value"))
        .alias("value")
    )


def _malformed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = _damaged(fixture_events(spark, sf_dir, with_category=False))
    flagged = decode(damaged).withColumn("valid", is_valid())

    def summed(name: str, inside: str) -> Column:
        return F.struct(
            F.lit(name).alias("part"),
            F.expr(f"count_if({inside}) AS row_count"),
            F.expr(f"count_if({inside} AND event_id IS NOT NULL) AS with_id"),
            money_sum(f"CASE WHEN {inside} THEN price END").alias("price"),
        )

    # Both parts from one pass over the messages.
    parts = F.array(summed("valid", "valid"), summed("malformed", "NOT valid"))
    return flagged.agg(parts.alias("parts")).select(F.inline("parts"))


def _table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "table")
    write_events(fixture_events(spark, sf_dir), path, ingest_id="roundtrip")
    as_of = latest_second(spark, sf_dir)
    month = as_of.replace(day=1, hour=0, minute=0, second=0)
    return read_events(spark, path, since=month, until=as_of).agg(
        F.count("*").alias("event_count"),
        money_sum("price").alias("price"),
        iso_text(F.min("timestamp")).alias("first_seen"),
        iso_text(F.max("timestamp")).alias("last_seen"),
    )


def _folded_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of seven batches, of which six are folded and their folders dropped, and the last comes later."""
    path = fresh_folder(spark, "folded")
    events = fixture_events(spark, sf_dir)
    batch = F.pmod(F.xxhash64("event_id"), F.lit(7))
    for number in range(6):
        write_events(events.where(batch == number), path, "batches", number)
    for month in read_table(spark, path).select("event_month").distinct().collect():
        fold_month(spark, path, month.event_month)
    drop_folded(spark, path)
    write_events(events.where(batch == 6), path, "batches", 6)
    return _as_text(read_events(spark, path))


_REPORTED: dict[tuple[str, str], str] = {}


def _reported_table(spark: SparkSession, sf_dir: str) -> str:
    """A stored table of two months, made once a session: the fixture, and once more 30 days earlier."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _REPORTED:
        folder = fresh_folder(spark, "report")
        events = fixture_events(spark, sf_dir)
        earlier = events.withColumns({
            "event_id": F.concat(F.lit("old-"), "event_id"),
            "timestamp": F.expr("timestamp - INTERVAL '30' DAY"),
        })
        write_events(events.unionByName(earlier), folder, ingest_id="report")
        _REPORTED[made] = folder
    return _REPORTED[made]


def _report(ask: Callable[[Reports], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ask(Reports(spark, _reported_table(spark, sf_dir), as_of=latest_second(spark, sf_dir)))

    return run


# --- table with a rollup -----------------------------------------------------

_ROLLED: dict[tuple[str, str], tuple[str, str]] = {}


def _rolled_store(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(table, rollup), made once a session: six batches of the fixture, of which one was run twice.

    Batch 1 holds rows from everywhere, so later batches bring older rows. Four
    batches are folded, in the table and in the rollup, before the last two come.
    """
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _ROLLED:
        folder = fresh_folder(spark, "rolled")
        table, rollup = f"{folder}/table", f"{folder}/rollup"
        events = fixture_events(spark, sf_dir, merged=True)
        # Joined to its categories once, for all batches and their sums.
        events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(6))).write.partitionBy("part").parquet(f"{folder}/in")
        kept = spark.read.schema(f"{events.schema.simpleString()[7:-1].replace(':', ' ')}, part BIGINT").parquet(f"{folder}/in")

        def store(number: int) -> None:
            batch = kept.where(F.col("part") == number).drop("part")
            write_events(batch, table, "batches", number)
            roll_up(batch, rollup, "batches", number)

        for number in (0, 1, 2, 2, 3):
            store(number)
        for month in [r.event_month for r in read_table(spark, table).select("event_month").distinct().collect()]:
            fold_month(spark, table, month)
            fold_rollup(spark, rollup, month)
        drop_folded(spark, table)
        drop_folded_rollup(spark, rollup)
        store(4)
        store(5)
        _ROLLED[made] = table, rollup
    return _ROLLED[made]


def _rolled(operator: Callable[..., DataFrame], window: str, **arguments) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_of = latest_second(spark, sf_dir)
        return operator(spark, *_rolled_store(spark, sf_dir), window, as_of=as_of, **arguments)

    return run


def _rolled_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different users of every window, bounded by a moment that later events lie behind."""
    as_of = latest_second(spark, sf_dir, before=latest_second(spark, sf_dir) - timedelta(hours=7, minutes=13))
    store = _rolled_store(spark, sf_dir)
    out = None
    for window in WINDOWS:
        one = rolled.unique_users(spark, *store, window, as_of=as_of, bounded=True)
        one = one.select(F.lit(window).alias("window"), "unique_users")
        out = one if out is None else out.unionByName(one)
    return out


def _user_layout(ask: Callable[[UserLayout, datetime], DataFrame]) -> Query:
    """Over the store's folded months copied by user, and two batches that came since."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, _ = _rolled_store(spark, sf_dir)
        name = "events_" + table.rstrip("/").split("/")[-2].rpartition("-")[2]
        layout = UserLayout(spark, name, table, buckets=8)
        for month in [r.event_month for r in read_table(spark, table).select("event_month").distinct().collect()]:
            layout.write_month(month)
        return ask(layout, latest_second(spark, sf_dir))

    return run


# --- streams ----------------------------------------------------------------

# Of the events table, what becomes one file of messages: some twenty times as many bytes.
_BYTES_A_FILE = 4 << 20


def _files_a_batch(spark: SparkSession, sf_dir: str) -> int:
    """How many files of messages make a batch, by the size of the events table: one if it is small."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(1, -(-size // _BYTES_A_FILE))


def _dealt(rows: DataFrame, files: int) -> DataFrame:
    """Rows to be written by as many tasks, each a file: dealt out in turn, so that none is empty."""
    return rows.coalesce(1) if files == 1 else rows.repartition(files)

def _ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "ingest")
    _messages(spark, sf_dir).write.text(f"{folder}/in")
    messages = read_message_files(spark, f"{folder}/in")
    start_ingest(messages, f"{folder}/table", f"{folder}/checkpoint", every=None).awaitTermination()
    return _as_text(read_events(spark, f"{folder}/table"))


def _quarantine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged messages, and clicks whose price is no number, are set aside; the rest is stored."""
    folder = fresh_folder(spark, "quarantine")
    messages = _damaged(fixture_events(spark, sf_dir, whole_seconds=False)).withColumn("value", F.when(
        F.col("value").contains('"event_type":"click"'), F.replace("value", F.lit('"price":'), F.lit('"price":"?",":":')),
    ).otherwise(F.col("value")))
    messages.repartition(2).write.text(f"{folder}/in")
    start_ingest(
        read_message_files(spark, f"{folder}/in", max_files_per_trigger=1), f"{folder}/table",
        f"{folder}/checkpoint", every=None, quarantine=f"{folder}/malformed",
    ).awaitTermination()
    aside = read_quarantine(spark, f"{folder}/malformed").select(
        F.lit("malformed").alias("part"), F.regexp_extract("raw", '"event_type":"([a-z]+)"', 1).alias("event_type"),
        F.regexp_extract("raw", '"event_id":"([0-9]+)"', 1).alias("event_id"),
    )
    stored = read_events(spark, f"{folder}/table").select(F.lit("stored").alias("part"), "event_type", "event_id")
    return stored.unionByName(aside)


def _in_two_runs(spark: SparkSession, sf_dir: str, folder: str, name: str | None = None) -> None:
    """Ingest cheap events, then the others from the same checkpoint, then find nothing new."""
    events = fixture_events(spark, sf_dir, whole_seconds=False)
    for part in (F.col("price") < 50, F.col("price") >= 50, None):
        if part is not None:
            encode(events.where(part)).write.mode("append").text(f"{folder}/in")
        messages = read_message_files(spark, f"{folder}/in")
        start_ingest(messages, f"{folder}/table", f"{folder}/checkpoint", every=None, name=name).awaitTermination()


def _table_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read by its registered name after several batches, without a repair."""
    folder = fresh_folder(spark, "named")
    name = "events_" + folder.rpartition("-")[2]
    _in_two_runs(spark, sf_dir, folder, name)
    return _as_text(read_events(spark, name=name))


def _recovery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "recovery")
    _in_two_runs(spark, sf_dir, folder)
    return _as_text(read_events(spark, f"{folder}/table"))


def _batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "counts")
    _in_two_runs(spark, sf_dir, folder)
    return batch_counts(spark, f"{folder}/table").select("batch_id", "row_count")


def _rate_capped_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream capped at a third of its files per batch stores every row in as many batches as that takes."""
    folder = fresh_folder(spark, "capped")
    messages = _messages(spark, sf_dir).withColumn("kind", F.get_json_object("value", "$.event_type"))
    messages.write.partitionBy("kind").text(f"{folder}/in")
    files = spark.read.text(f"{folder}/in").select("_metadata.file_path").distinct().count()
    cap = -(-files // 3)
    start_ingest(
        read_message_files(spark, f"{folder}/in", max_files_per_trigger=cap),
        f"{folder}/table", f"{folder}/checkpoint", every=None,
    ).awaitTermination()
    return batch_counts(spark, f"{folder}/table").agg(
        F.sum("row_count").alias("row_count"),
        (F.count("*") == -(-files // cap)).alias("batches_as_capped"),
        (F.count("*") > 1).alias("several_batches"),
    )


def _dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delivered one to three times, later copies in later batches, are stored once."""
    folder = fresh_folder(spark, "dedup")
    files = _files_a_batch(spark, sf_dir)
    events = fixture_events(spark, sf_dir, whole_seconds=False)
    for copy in range(3):
        again = events.where(F.length("event_type") % 3 >= copy)
        encode(_dealt(again, files)).write.mode("append").text(f"{folder}/in")
    start_ingest(
        read_message_files(spark, f"{folder}/in", max_files_per_trigger=files), f"{folder}/table",
        f"{folder}/checkpoint", every=None, unique_within="10 minutes",
    ).awaitTermination()
    return _as_text(read_events(spark, f"{folder}/table"))


def _progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per batch as the progress table has them, over a restart."""
    folder = fresh_folder(spark, "progress")
    reports = ProgressTable(spark, f"{folder}/reports").attach()
    try:
        events = fixture_events(spark, sf_dir, whole_seconds=False)
        for part in ("price < 50", "price >= 50"):
            encode(events.where(part)).write.mode("append").text(f"{folder}/in")
            messages = read_message_files(spark, f"{folder}/in")
            reports.wait(start_ingest(messages, f"{folder}/table", f"{folder}/checkpoint", every=None))
    finally:
        reports.detach()
    ran = read_progress(spark, f"{folder}/reports").where("input_rows > 0")
    return ran.select("batch_id", F.col("input_rows").alias("row_count"), (F.col("milliseconds") > 0).alias("timed"))


def _offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of offsets lost and doubled: a partition per remainder of the id, some ids missing, some sent again."""
    folder = fresh_folder(spark, "offsets")
    events = fixture_events(spark, sf_dir, with_category=False)
    files = _files_a_batch(spark, sf_dir)
    # The number from the row, not from the message, which would be written and parsed anew for each condition on it.
    sent = events.withColumn("number", F.col("event_id").cast("bigint"))
    missing = (F.col("number") % 1000).between(400, 420) | (F.col("number") % 70 == 3)
    sent = sent.where(~missing)
    again = sent.where((F.col("number") % 1000).between(415, 460))
    for part in (sent.where("number % 2000 < 1200"), sent.where("number % 2000 >= 1200").unionByName(again)):
        numbered = encode(_dealt(part, files), ["number"]).select(
            "value", F.lit("events").alias("topic"), (F.col("number") % 3).cast("int").alias("partition"),
            F.floor(F.col("number") / 3).alias("offset"),
        )
        numbered.write.mode("append").parquet(f"{folder}/in")
    messages = spark.readStream.schema("value STRING, topic STRING, partition INT, offset BIGINT").option(
        "maxFilesPerTrigger", files
    ).parquet(f"{folder}/in")
    query = start_ingest(messages, f"{folder}/table", f"{folder}/checkpoint", every=None, offsets=f"{folder}/offsets")
    query.awaitTermination()
    return audit(spark, f"{folder}/offsets", str(query.id))


def _unique_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delivered again and again, in one batch and in later ones, before and after a fold, are stored once."""
    folder = fresh_folder(spark, "unique")
    files = _files_a_batch(spark, sf_dir)
    events = fixture_events(spark, sf_dir, whole_seconds=False)
    some = events.where(F.length("event_type") % 3 > 0)
    for parts in ((some.where("price < 60").unionByName(some.where("price < 20")), some), (events, some)):
        for part in parts:
            encode(_dealt(part, files)).write.mode("append").text(f"{folder}/in")
        start_ingest(
            read_message_files(spark, f"{folder}/in", max_files_per_trigger=files), f"{folder}/table",
            f"{folder}/checkpoint", every=None, unique=True,
        ).awaitTermination()
        for month in read_table(spark, f"{folder}/table").select("event_month").distinct().collect():
            fold_month(spark, f"{folder}/table", month.event_month)
    return _as_text(read_events(spark, f"{folder}/table"))


def _live_counts(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Count over several batches and a restart, older events after newer ones; (folder, query id)."""
    folder = fresh_folder(spark, "live")
    events = fixture_events(spark, sf_dir, with_category=False, whole_seconds=False)
    query_id = ""
    for parts in ((F.col("price") >= 70, (F.col("price") >= 40) & (F.col("price") < 70)), (F.col("price") < 40,)):
        for part in parts:
            encode(events.where(part)).write.mode("append").text(f"{folder}/in")
        stream = normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)))
        query = live.start_live_counts(stream, f"{folder}/counts", f"{folder}/checkpoint", every=None)
        query.awaitTermination()
        query_id = str(query.id)
    return f"{folder}/counts", query_id


def _in_four_batches(spark: SparkSession, sf_dir: str, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> str:
    """Stream the fixture, eight days to a batch, some events a batch or more too late; restart halfway; the query's id."""
    events = fixture_events(spark, sf_dir, with_category=False, whole_seconds=False)
    files = _files_a_batch(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    due = F.floor((F.dayofmonth("timestamp") - 1) / 8)
    batch = F.when(number % 53 == 0, 3).when(number % 11 == 0, F.least(due + 1, F.lit(3))).otherwise(due)
    query_id = ""
    for parts in ((0, 1), (2, 3)):
        for part in parts:
            encode(_dealt(events.where(batch == part), files)).write.mode("append").text(f"{folder}/in")
        query = start(normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=files))))
        query.awaitTermination()
        query_id = str(query.id)
    return query_id


def _final_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes given out when final, and late events by the minute they belong to."""
    folder = fresh_folder(spark, "final")
    query_id = _in_four_batches(spark, sf_dir, folder, lambda events: minutes.start_final_minutes(
        events, f"{folder}/out", f"{folder}/checkpoint", delay_minutes=60, every=None, spread=1, partitions=4,
    ))
    final = minutes.final_minutes(spark, f"{folder}/out", query_id).withColumn("part", F.lit("final"))
    late = minutes.late_events(spark, f"{folder}/out", query_id)
    late = live.minute_counts(late.drop("batch_id")).withColumn("part", F.lit("late"))
    both = final.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).unionByName(late)
    return both.withColumn("bucket", iso_text(F.col("bucket")))


def _journey_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often users came to each stage in order of time, idle ones starting anew after three days."""
    folder = fresh_folder(spark, "journeys")
    query_id = _in_four_batches(spark, sf_dir, folder, lambda events: journeys.start_running_funnel(
        events, f"{folder}/out", f"{folder}/checkpoint", stages=JOURNEY_STAGES, delay="25 days", forget_hours=72, every=None,
    ))
    first = _journey_totals(spark, folder, query_id)
    # One more batch with an event far ahead, before which all others can be put in order.
    ahead = fixture_events(spark, sf_dir, with_category=False).limit(1).withColumns({
        "event_type": F.lit("end"), "timestamp": F.expr("timestamp + INTERVAL 1000 DAY"),
    })
    encode(ahead).coalesce(1).write.mode("append").text(f"{folder}/in")
    journeys.start_running_funnel(
        normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=1))),
        f"{folder}/out", f"{folder}/checkpoint", stages=JOURNEY_STAGES, delay="25 days", forget_hours=72, every=None,
    ).awaitTermination()
    last = _journey_totals(spark, folder, query_id).withColumn("when", F.lit("at the end"))
    return last.unionByName(first.withColumn("when", F.lit("before")))


def _journey_totals(spark: SparkSession, folder: str, query_id: str) -> DataFrame:
    return journeys.running_totals(spark, f"{folder}/out", query_id, JOURNEY_STAGES)


def _live_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = live.live_minutes(spark, *_live_counts(spark, sf_dir))
    return minutes.withColumn("bucket", iso_text(F.col("bucket")))


def _running_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.running_funnel(spark, *_live_counts(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "overview_24h": _windowed(metrics.overview, "24h"),
    "overview_30d": _windowed(metrics.overview, "30d"),
    "window_counts": _window_counts,
    "funnel_30d": _windowed(metrics.funnel, "30d"),
    "funnel_custom_7d": _windowed(metrics.funnel, "7d", stages=FIXTURE_STAGES),
    "funnel_category_30d": _windowed(metrics.funnel, "30d", with_category=True, category="promo"),
    "timeseries_hour_24h": _windowed(metrics.timeseries, "24h", bucket="hour"),
    "timeseries_day_30d": _windowed(metrics.timeseries, "30d", bucket="day"),
    "timeseries_click_minute_6h": _windowed(metrics.timeseries, "6h", bucket="minute", event_type="click"),
    "top_products_revenue": _windowed(metrics.top_products, "30d", with_category=True, by="revenue"),
    "top_products_views": _windowed(metrics.top_products, "30d", with_category=True, by="views"),
    "top_products_purchases": _windowed(metrics.top_products, "30d", with_category=True, by="purchases"),
    "top_categories_30d": _CATEGORIES,
    "user_summary_u42": _windowed(log.user_summary, "7d", user_id="u_42", raw_user=42),
    "user_events_u42": _windowed(log.user_events, "7d", with_category=True, user_id="u_42", raw_user=42),
    "user_events_limited": _windowed(
        log.user_events, "30d", with_category=True, user_id="u_42", raw_user=42, limit=5,
    ),
    "user_summaries_30d": _windowed(log.user_summaries, "30d"),
    "revenue_hour_7d": _windowed(metrics.revenue, "7d", bucket="hour"),
    "revenue_day_30d": _windowed(metrics.revenue, "30d", bucket="day"),
    "revenue_totals_30d": _windowed(metrics.revenue_totals, "30d"),
    "realtime": _live(metrics.realtime),
    "events_per_sec": _live(metrics.events_per_sec),
    "realtime_bounded": _realtime_bounded,
    "events_page": _PAGE,
    "events_deep_page": _windowed(log.list_events, "30d", with_category=True, limit=50, offset=5000),
    "events_deep_page_null_ids": _of_all(log.list_events, _some_null_ids, limit=50, offset=5000),
    "events_hot_second": _of_all(log.list_events, _one_hot_second, limit=50, offset=4000),
    "revenue_large_amounts": _of_all(metrics.top_categories, _large_amounts),
    "events_keyset_pages": _keyset_pages,
    "events_filtered": _windowed(
        log.list_events, "30d", with_category=True, raw_user=42,
        limit=50, event_type="purchase", user_id="u_42", category="",
    ),
    "event_total": _event_total,
    "timeseries_pivot": _windowed(metrics.timeseries_pivot, "7d", bucket="hour"),
    "funnel_share": _windowed(metrics.funnel_share, "30d", stages=FIXTURE_STAGES),
    "product_share": _then(_TOP_EIGHT, shaping.product_share),
    "category_share": _then(_CATEGORIES, shaping.category_share),
    "category_profile": _then(_CATEGORIES, shaping.category_profile),
    "cvr_bands": _then(_CATEGORIES, _cvr_bands),
    "events_page_info": _page_info,
    "events_priced": _then(_PAGE, _priced),
    "last_minute_total": _live(metrics.last_minute_total),
    "decode_normalize": _decode_normalize,
    "malformed_split": _malformed_split,
    "table_roundtrip_month": _table_roundtrip,
    "folded_month": _folded_month,
    "report_health": _report(lambda r: r.health()),
    "report_events": _report(lambda r: r.events("30d", limit=20, offset=20)),
    "report_overview": _report(lambda r: r.overview("30d")),
    "report_funnel": _report(lambda r: r.funnel("30d")),
    "report_timeseries": _report(lambda r: r.timeseries("24h")),
    "report_top_products": _report(lambda r: r.top_products("30d")),
    "report_top_categories": _report(lambda r: r.top_categories("30d")),
    "report_user_summary": _report(lambda r: r.user("u_42")[0]),
    "report_user_events": _report(lambda r: r.user("u_42")[1]),
    "report_users": _report(lambda r: r.users("30d")),
    "report_revenue": _report(lambda r: r.revenue("7d")[1]),
    "report_revenue_totals": _report(lambda r: r.revenue("30d")[0]),
    "report_realtime": _report(lambda r: r.realtime()[1]),
    "rollup_overview": _rolled(rolled.overview, "30d"),
    "rollup_overview_24h": _rolled(rolled.overview, "24h"),
    "rollup_timeseries": _rolled(rolled.timeseries, "24h", bucket="hour"),
    "rollup_funnel": _rolled(rolled.funnel, "30d", category="promo"),
    "rollup_top_categories": _rolled(rolled.top_categories, "30d"),
    "rollup_revenue": _rolled(rolled.revenue, "30d", bucket="day"),
    "rollup_distinct": _rolled_distinct,
    "user_layout_summaries": _user_layout(lambda layout, as_of: layout.summaries("30d", as_of)),
    "user_layout_events": _user_layout(
        lambda layout, as_of: log.user_events(layout.of_user("u_42"), "u_42", "30d", as_of, limit=5)
    ),
    "ingest_stream": _ingest_stream,
    "quarantine_stream": _quarantine_stream,
    "recovery_stream": _recovery_stream,
    "table_by_name": _table_by_name,
    "batch_counts": _batch_counts,
    "rate_capped_ingest": _rate_capped_ingest,
    "dedup_stream": _dedup_stream,
    "unique_ingest": _unique_ingest,
    "progress_table": _progress_table,
    "offset_audit": _offset_audit,
    "live_minutes": _live_minutes,
    "running_funnel": _running_funnel,
    "final_minutes": _final_minutes,
    "journey_funnel": _journey_funnel,
}
