"""All reports over one stored table.

Every report reads the table through ``read_window``, so that its window prunes
months and row groups, and a report of several parts uses the same moment for
all of them.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.times import as_of_column, window_start
from clickloom.operators import keyset, log, metrics
from clickloom.sources.table import read_events, read_window
from clickloom.vocabulary import WINDOWS


class Reports:
    """Reports over the event table in ``folder``, or over the one registered as ``name``.

    They are as of a fixed moment or, by default, of each call.
    """

    def __init__(
        self, spark: SparkSession, folder: str | None = None, as_of: datetime | None = None, name: str | None = None
    ):
        if (folder is None) == (name is None):
            raise ValueError("give the table's folder or its registered name, and not both")
        self._spark = spark
        self._folder = folder
        self._name = name
        self._as_of = as_of

    def _moment(self) -> datetime:
        return self._as_of or datetime.now(timezone.utc)

    def _window(self, window: str, as_of: datetime) -> DataFrame:
        return read_window(self._spark, self._folder, window, as_of, self._name)

    def health(self) -> DataFrame:
        return log.event_total(read_events(self._spark, self._folder, name=self._name))

    def events(self, window: str = "24h", **page) -> DataFrame:
        """A log page; takes the limit, offset and filters of ``list_events``."""
        as_of = self._moment()
        return log.list_events(self._window(window, as_of), window=window, as_of=as_of, **page)

    def events_after(
        self, cursor: str | None = None, window: str = "24h", backwards: bool = False, **page
    ) -> DataFrame:
        """The log page behind a cursor, or before it; only months on its side of the cursor are read."""
        as_of = self._moment()
        since, until = window_start(window, as_of, zoneless=True), None
        if cursor is not None:
            moment = keyset.read_cursor(cursor)[1]
            since, until = (F.greatest(since, as_of_column(moment, zoneless=True)), None) if backwards else (since, moment)
        events = read_events(self._spark, self._folder, since, until, self._name)
        return keyset.page_after(events, cursor, backwards=backwards, window=window, as_of=as_of, **page)

    def overview(self, window: str = "24h") -> DataFrame:
        as_of = self._moment()
        return metrics.overview(self._window(window, as_of), window, as_of)

    def funnel(self, window: str = "24h", category: str | None = None) -> DataFrame:
        as_of = self._moment()
        return metrics.funnel(self._window(window, as_of), window, category, as_of)

    def timeseries(self, window: str = "24h", bucket: str = "hour", event_type: str | None = None) -> DataFrame:
        as_of = self._moment()
        return metrics.timeseries(self._window(window, as_of), window, bucket, event_type, as_of)

    def top_products(self, window: str = "24h", by: str = "revenue", limit: int = 10) -> DataFrame:
        as_of = self._moment()
        return metrics.top_products(self._window(window, as_of), window, by, limit, as_of)

    def top_categories(self, window: str = "24h") -> DataFrame:
        as_of = self._moment()
        return metrics.top_categories(self._window(window, as_of), window, as_of)

    def user(self, user_id: str, window: str = "7d") -> tuple[DataFrame, DataFrame]:
        """(summary, events) of one user; both empty for a user without events."""
        as_of = self._moment()
        rows = self._window(window, as_of)
        return log.user_summary(rows, user_id, window, as_of), log.user_events(rows, user_id, window, as_of)

    def revenue(self, window: str = "24h", bucket: str = "hour") -> tuple[DataFrame, DataFrame]:
        """(totals, time series)."""
        as_of = self._moment()
        rows = self._window(window, as_of)
        return metrics.revenue_totals(rows, window, as_of), metrics.revenue(rows, window, bucket, as_of)

    def users(self, window: str = "7d") -> DataFrame:
        """The summary of every user."""
        as_of = self._moment()
        return log.user_summaries(self._window(window, as_of), window, as_of)

    def realtime(self, bounded: bool = False) -> tuple[DataFrame, DataFrame]:
        """(events per second, minutes)."""
        as_of = self._moment()
        rows = self._window(min(WINDOWS, key=WINDOWS.get), as_of)
        return metrics.events_per_sec(rows, as_of, bounded), metrics.realtime(rows, as_of, bounded)
