"""Lines that several documents share, found by probing a sharded minimal perfect hash.

Every line of at least some length has a key and a 128-bit hash of it. The
distinct hashes are dealt to shards; a shard is a minimal perfect hash, which
gives each of its lines a slot of its own, and three arrays in slot order: a
compact fingerprint, the number of documents that hold the line, and the hash
of the smallest of their ids. Lines are not joined with lines: each asks the
arrays of its shard what its slot says. A shard asked very often is copied, and
its askers are dealt over the copies, so a line that most documents hold is no
task's burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle
from clickloom.llm.wordhash import mixed

# Code points a key must have for its line to be dropped, and documents that must hold it.
LEAST_CHARS, LEAST_DOCUMENTS = 10, 2
# Distinct lines of a shard, and lines that ask one copy of it, on average.
SHARD_LINES, SHARD_PROBES = 1 << 16, 1 << 18
# Bits of a level per line not yet placed.
_ROOM = 2
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SHARD = "shard int, lines long, asked long, sizes binary, bits binary, prints binary, kind string, counts binary, owners binary"
_ANSWER = "k1 long, k2 long, at int, documents long, owned boolean"


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct pairs of 64-bit hashes, in about three bits a pair.

    A level is a row of bits. Pairs that fall on a bit alone own it; the others
    go to the next level, until all are placed. A slot is the number of owned
    bits before a pair's own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        owned = np.unpackbits(bits, bitorder="little")
        self._owned = owned.astype(bool)
        self._before = np.cumsum(owned, dtype=np.int64) - owned
        self._starts = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, rows = [], []
        while len(first):
            size = -(-_ROOM * len(first) // 8) * 8
            at = cls._place(first, second, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            rows.append(np.packbits(alone, bitorder="little"))
            rest = ~alone[at]
            first, second = first[rest], second[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(rows) if rows else np.empty(0, np.uint8))

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = mixed(second + np.uint64(_STEP * (level + 1) & _MASK))
        return (mixed(first ^ salted) % np.uint64(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each pair. A pair that was not built in gets any slot, or -1."""
        out = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self._starts[level] + self._place(first[open_], second[open_], level, int(size))
            owned = self._owned[bit]
            out[open_[owned]] = self._before[bit[owned]]
            open_ = open_[~owned]
        return out


def _uint(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _fingerprints(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mixed(first + np.uint64(_STEP) * second) >> np.uint64(32)).astype(np.uint32)


def _build_shard(key: tuple, lines: pa.Table) -> pa.Table:
    first, second = _uint(lines["h1"]), _uint(lines["h2"])
    index = PerfectHash.build(first, second)
    slots = index.slots(first, second)
    counts, owners = lines["documents"].to_numpy(), lines["owner"].to_numpy()
    kind = np.min_scalar_type(int(counts.max()))
    prints, placed, owned = np.empty(len(slots), np.uint32), np.empty(len(slots), kind), np.empty(len(slots), np.int64)
    prints[slots], placed[slots], owned[slots] = _fingerprints(first, second), counts, owners
    row = {
        "shard": key[0].as_py(), "lines": len(slots), "asked": int(lines["asked"].to_numpy().sum()),
        "sizes": index.sizes.tobytes(), "bits": index.bits.tobytes(), "prints": prints.tobytes(), "kind": kind.str,
        "counts": placed.tobytes(), "owners": owned.tobytes(),
    }
    return pa.Table.from_pylist([row], pa.schema([
        ("shard", pa.int32()), ("lines", pa.int64()), ("asked", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()),
        ("prints", pa.binary()), ("kind", pa.string()), ("counts", pa.binary()), ("owners", pa.binary()),
    ]))


def _probe(probes: pa.Table, shard: pa.Table) -> pa.Table:
    """What a shard says of the lines that ask it; lines it does not have are left out."""
    schema = pa.schema([
        ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("documents", pa.int64()), ("owned", pa.bool_()),
    ])
    if not probes.num_rows or not shard.num_rows:
        return schema.empty_table()
    row = shard.to_pylist()[0]
    index = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
    first, second = _uint(probes["h1"]), _uint(probes["h2"])
    slots = index.slots(first, second)
    known = np.flatnonzero(slots >= 0)
    known = known[np.frombuffer(row["prints"], np.uint32)[slots[known]] == _fingerprints(first[known], second[known])]
    slots = slots[known]
    asked = probes.take(pa.array(known))
    owned = np.frombuffer(row["owners"], np.int64)[slots] == asked["owner"].to_numpy()
    counts = np.frombuffer(row["counts"], np.dtype(row["kind"]))[slots].astype(np.int64)
    return pa.Table.from_arrays(
        [asked["k1"], asked["k2"], asked["at"], pa.array(counts), pa.array(owned)], schema=schema
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): texts never null, and two hashes that name a row by its id and text."""
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def hashed_lines(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, doc_id, owner, at, h1, h2): one row per line long enough, numbered from 0 in its text."""
    lines = rows.select("k1", "k2", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("k1", "k2", "doc_id", "at", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= least_chars).select(
        "k1", "k2", "doc_id", F.xxhash64("doc_id").alias("owner"), "at",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
    )


def build_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """One row per shard of the distinct lines, and the number of shards that hashes are dealt to.

    ``documents`` of a line counts different ids, ``owner`` is the hash of the
    smallest; null is an id and the largest of all.
    """
    pairs = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("asked"))
    distinct = pairs.groupBy("h1", "h2").agg(
        F.count("*").alias("documents"), F.xxhash64(F.min("doc_id")).alias("owner"), F.sum("asked").alias("asked")
    )
    distinct = settle(distinct, "distinct-lines")
    shards = max(1, -(-distinct.count() // shard_lines))
    dealt = distinct.withColumn("shard", shard_of(shards))
    return settle(dealt.groupBy("shard").applyInArrow(_build_shard, _SHARD), "line-shards"), shards


def shard_of(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


def ask(lines: DataFrame, index: DataFrame, shards: int, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """(k1, k2, at, documents, owned) of each line that the index has.

    The index knows how often each shard will be asked, if it was built from
    the same lines, and is copied accordingly; the copies a shard has are
    joined to the lines, which Spark does by broadcast if that table is small
    enough and else by a join that can be split.
    """
    copies = F.ceil(F.col("asked") / shard_probes).cast("int")
    plan = settle(index.select("shard", copies.alias("copies")).where("copies > 1"), "line-copies")
    probes = lines.withColumn("shard", shard_of(shards)).join(plan, "shard", "left")
    probes = probes.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("k1", "at"), F.col("copies")).cast("int"), F.lit(0)))
    probes = probes.select("shard", "copy", "k1", "k2", "at", "owner", "h1", "h2")
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    return probes.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(_probe, _ANSWER)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose numbers are listed."""
    for batch in batches:
        ids, texts, gone = (batch.column(i) for i in range(3))
        total, dropped, kept = [], [], []
        for i in range(batch.num_rows):
            lines = texts[i].as_py().split("\n")
            drop = set(gone[i].as_py() or ())
            total.append(len(lines))
            dropped.append(len(drop))
            kept.append("\n".join(line for at, line in enumerate(lines) if at not in drop) if drop else texts[i])
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, texts.type)],
            names=["doc_id", "n_lines", "n_dropped", "kept"],
        )


def remove_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
    shard_lines: int = SHARD_LINES, shard_probes: int = SHARD_PROBES,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept.

    Texts are split at line feeds only; null and empty texts are one empty
    line. A line's key is the line without blanks at its ends, A-Z in lower
    case. Keys of at least ``least_chars`` code points found in at least
    ``least_documents`` documents lose all their lines but those in the
    document of the smallest id. Rows with one id are one document; null is an
    id, larger than all others. Repeated rows come out as often as they came
    in. No documents, no rows. Columns other than doc_id and text are not read.
    """
    rows = keyed_rows(docs)
    lines = settle(hashed_lines(rows, least_chars), "lines")
    index, shards = build_index(lines, shard_lines)
    answers = ask(lines, index, shards, shard_probes)
    lost = answers.where((F.col("documents") >= least_documents) & ~F.col("owned"))
    # A set, as repeated rows ask alike. Settled, so that a row repeated very often can be split over tasks.
    gone = settle(lost.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")), "lost-lines")
    kind = docs.schema[docs.columns.index("doc_id")].dataType.simpleString()
    joined = rows.join(gone, ["k1", "k2"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_without, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
