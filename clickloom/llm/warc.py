"""WARC archives of web pages, and a globally ordered index of what they hold.

Archives are written by Spark's text writer, whose line separator is the blank
line pair that ends a WARC record; they are gzipped, committed like any other
output and thus safe against lost executors and in any store. Reading them
back yields one locally sorted run of captures per archive. The runs are dealt
by ranges of (URL key, time, page), and each range merges its pieces of all
runs with a tree of losers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle
from clickloom.sources.scratch import fresh_folder

RECORDS_PER_FILE = 2_000
MIN_BYTES = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Captures of pages without a time of their own are spread over a year from here.
EPOCH, YEAR_SECONDS = 1_704_067_200, 31_536_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexadecimal = F.sha1(F.encode(payload, "UTF-8"))
    groups = [
        F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def record_id(page_id: Column) -> Column:
    """A URN that the page id can be read back from; a null id has one of its own."""
    digits = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0))), 16, "0"))
    kind = F.when(page_id.isNull(), "00000001").otherwise("00000000")
    return F.concat(
        F.lit("<urn:uuid:"), kind, F.lit("-0000-4000-"), F.substring(digits, 1, 4), F.lit("-"),
        F.substring(digits, 5, 12), F.lit(">"),
    )


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record per page in column ``value``, without the blank lines at its end.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the
    smallest page_id are responses and the others revisit it, holding the HTTP
    header only. Null html is an empty payload; a null page_id is larger than
    any other. Blanks and control characters in a URL are percent-encoded.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    first = (
        rows.where(F.col("bytes") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    # Settled, so that the pages of a payload with very many copies can be split over tasks.
    judged = rows.join(settle(first, "repeated-payloads"), "digest", "left").withColumn(
        "revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    seconds = F.lit(EPOCH) + F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(-1))), F.lit(YEAR_SECONDS))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.col("bytes"), F.lit("\r\n\r\n"),
    )
    block = F.when(F.col("revisit"), header).otherwise(F.concat(header, "html"))
    refers = F.concat(
        F.lit(f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To: "), record_id(F.col("first_id")), F.lit("\r\n")
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("revisit"), refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    return judged.select(record.alias("value"))


def write_archives(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, **settings) -> None:
    (
        records(pages, **settings).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(folder)
    )


def parse_records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields in lower case, block) of each record of an unpacked archive."""
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record at {offset}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at {offset} does not end as it should")
        yield offset, fields, block


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the top, then path and query, without scheme and fragment."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    tail = parts.path or "/"
    return ",".join(reversed(host.split("."))) + port + ")" + tail + (f"?{parts.query}" if parts.query else "")


def _page_of(urn: str) -> int | None:
    digits = urn.strip("<>").removeprefix("urn:uuid:").split("-")
    if digits[0] != "00000000":
        return None
    return int.from_bytes(bytes.fromhex(digits[3] + digits[4]), "big", signed=True)


CAPTURE = pa.schema([
    ("url_key", pa.string()), ("captured", pa.timestamp("us", "UTC")), ("page_id", pa.int64()),
    ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("archive", pa.string()), ("offset", pa.int64()),
])
_DDL = (
    "url_key string, captured timestamp, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, offset long"
)


def _order(row: Sequence) -> tuple:
    """URL key, time, page; a null page is the last."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def captures_of(name: str, content: bytes) -> list[tuple]:
    """The run of one archive, in order. Payloads are checked against their digests."""
    run = []
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as packed:
        for offset, fields, block in parse_records(io.BufferedReader(packed)):
            head, _, payload = block.partition(b"\r\n\r\n")
            lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
            length = int({k.strip().lower(): v for k, _, v in lines}[b"content-length"])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            kind = fields["warc-type"]
            if kind == "response" and (
                len(payload) != length or b32encode(hashlib.sha1(payload).digest()).decode() != digest
            ):
                raise ValueError(f"{name} at {offset}: the payload is not what its record says")
            refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
            date = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
            url = fields["warc-target-uri"]
            run.append((
                url_key(url), date, _page_of(fields["warc-record-id"]), url, kind, refers, length, digest, name, offset,
            ))
    run.sort(key=_order)
    return run


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives in a folder; those of one archive are a sorted run."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                run = captures_of(path.as_py().rpartition("/")[2], content.as_py())
                yield pa.RecordBatch.from_pylist([dict(zip(CAPTURE.names, row)) for row in run], schema=CAPTURE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(parse, _DDL)


class LoserTree:
    """Merges sorted runs. Inner nodes hold losers, so each row taken costs log2(runs) comparisons."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self._runs = runs
        self._at = [0] * len(runs)
        self._size = max(1, len(runs))
        self._losers = [-1] * self._size
        for run in range(len(runs)):
            self._rise(run)

    def _key(self, run: int) -> tuple | None:
        rows = self._runs[run]
        return _order(rows[self._at[run]]) if self._at[run] < len(rows) else None

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self._key(a), self._key(b)
        return kb is None or (ka is not None and ka <= kb)

    def _rise(self, run: int) -> None:
        """Let a run play its way up; while the tree fills, it waits at the first free node."""
        winner, node = run, (run + self._size) // 2
        while node:
            other = self._losers[node]
            if other < 0:
                self._losers[node] = winner
                return
            if not self._beats(winner, other):
                self._losers[node], winner = winner, other
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self._runs:
            run = self._losers[0]
            if self._at[run] >= len(self._runs[run]):
                return
            row = self._runs[run][self._at[run]]
            self._at[run] += 1
            yield row
            self._rise(run)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures with ``part`` and ``place``: ordered by both, the whole index is in order.

    Ranges are cut by (URL key, time, page), so one URL with very many captures
    is cut as well. A task holds the index entries of its range, no payloads.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                pieces.setdefault(row[8], []).append(row)
        for piece in pieces.values():
            # Blocks of a shuffle keep their order; this costs nothing then.
            piece.sort(key=_order)
        part, place, out = TaskContext.get().partitionId(), 0, []
        for row in LoserTree(list(pieces.values())):
            out.append((*row, part, place))
            place += 1
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    dealt = runs.repartitionByRange("url_key", "captured", F.asc_nulls_last("page_id"))
    return dealt.mapInArrow(merge, _DDL + ", part int, place long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = CAPTURE.append(pa.field("part", pa.int32())).append(pa.field("place", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def capture_histories(pages: DataFrame, **settings) -> DataFrame:
    """Archive pages, read the archives back and return the merged index, one row per page.

    Without pages the index is empty. Extra columns are not read; repeated rows
    are archived as often as they come.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "archives")
    write_archives(pages, folder, **settings)
    return merge_runs(settle(read_runs(spark, folder), "runs"))
