"""JSON event messages: decode, normalise, set malformed ones aside, encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.vocabulary import EVENT_COLUMNS, EVENT_DDL

# Without these an event can be neither told from its copies nor placed in time.
REQUIRED = ("event_id", "timestamp")


def decode(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Event columns from the JSON text (or bytes) in column ``value``, and columns to ``keep`` before them.

    Fields outside the schema are dropped. A field that cannot be read is null,
    and so is every field of a message that is not JSON.
    """
    event = F.from_json(F.col("value").cast("string"), EVENT_DDL)
    # Unnested with inline rather than "event.*": a filter on an event column
    # would otherwise be pushed below and parse every message once more.
    return messages.select(*keep, F.inline(F.array(event)))


def decode_flagged(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Event columns, ``raw``, the message's text, and ``valid``, whether it is a usable event.

    It is if it has an id and a time and all its fields can be read: unlike in
    ``decode``, a price that is there but no number makes it malformed, whereas
    a missing one does not. A malformed message has no event_id, so that it is
    never taken for a copy of a good one.
    """
    text = F.col("value").cast("string")
    decoded = messages.select(*keep, text.alias("raw"), F.inline(F.array(F.from_json(text, EVENT_DDL))))
    # Looked up in the text only where there is no price.
    unreadable = F.col("price").isNull() & F.get_json_object("raw", "$.price").isNotNull()
    valid = is_valid() & ~unreadable
    flagged = decoded.withColumn("valid", valid).withColumn("event_id", F.when(F.col("valid"), F.col("event_id")))
    return flagged.select(*keep, *EVENT_COLUMNS, "raw", "valid")


def normalize(events: DataFrame) -> DataFrame:
    """Stored form: whole seconds, and defaults in place of nulls."""
    stored = {name: F.coalesce(name, F.lit("")) for name in EVENT_COLUMNS}
    stored["price"] = F.coalesce("price", F.lit(0.0))
    stored["timestamp"] = F.date_trunc("second", F.coalesce("timestamp", F.timestamp_seconds(F.lit(0))))
    return events.withColumns(stored)


def is_valid() -> Column:
    """Whether a decoded row has what an event cannot do without; usable as a flag in one pass."""
    valid = F.lit(True)
    for name in REQUIRED:
        valid = valid & F.col(name).isNotNull()
    return valid


def split_malformed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, malformed) parts of a decoded, not yet normalised frame."""
    return events.where(is_valid()), events.where(~is_valid())


def encode(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events as JSON messages in column ``value``, times as ISO text with UTC offset, and columns to ``keep`` before them."""
    fields = [F.col(name) for name in EVENT_COLUMNS if name != "timestamp"]
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp")
    return events.select(*keep, F.to_json(F.struct(*fields, time)).alias("value"))
