"""Near-duplicates by SimHash, searched with tables of distances to reference fingerprints.

Hamming distance is a metric: for any reference r, fingerprints x and y are at
least |d(x, r) - d(y, r)| apart. References are chosen so that this bound can
be joined on. The 64 bits form four blocks of 16, and the 16 references of a
block are the Walsh functions on its bits. Distances to these, less the
distance to the zero reference, depend on that block only and differ as soon
as a bit of it does. Two fingerprints at most two bits apart agree in at least
two whole blocks, thus in 32 coordinates of the table, and meet under one of
six keys made of two blocks' coordinates. Of the pairs that meet, those with
any coordinate more than the allowed distance apart are discarded, and what
survives is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import numbered, pick, restore, row_hash, settle, word_blocks
from clickloom.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
# Keys with more fingerprints than this are split by finer keys.
CROWDED = 4096
_MIX = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included.

    A-Z is lower-cased. With fewer words than a shingle has, the whole sequence
    is the only one; without words, and for null, the fingerprint is zero.
    """
    ones, total = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    first = True
    for words in word_blocks((text or "").encode("utf-8", "replace").lower()):
        words = tail + words
        tail = words[-(shingle - 1):] if shingle > 1 else []
        hashes = _shingle_hashes(words, shingle)
        if len(hashes):
            first = False
            total += len(hashes)
            for at in range(0, len(hashes), 1 << 16):
                part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if first and tail:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)
        ones, total = np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64), 1
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    n = len(words) - shingle + 1
    if n < 1:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())), np.uint64, n
    )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of each document as a signed long."""
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"doc_id {kind}, text_hash long, fp long")


def _references() -> np.ndarray:
    """64 references, 16 for each 16-bit block: its Walsh functions (all ones in place of none)."""
    masks = []
    for walsh in range(16):
        mask = sum(1 << bit for bit in range(16) if bin(walsh & bit).count("1") % 2)
        masks.append(mask or 0xFFFF)
    return np.array([mask << (16 * block) for block in range(4) for mask in masks], np.uint64)


REFERENCES = _references()


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (row) to the references (columns)."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _block_keys(prints: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """One 64-bit key per part: the coordinates of its columns, less the distance to zero."""
    table = (distance_table(prints) - np.bitwise_count(prints)[:, None].astype(np.int8)).astype(np.uint64)
    keys = []
    for number, columns in enumerate(parts):
        key = np.full(len(prints), number + 1, np.uint64)
        for column in columns:
            key = (key ^ table[:, column]) * np.uint64(_MIX)
            key ^= key >> np.uint64(29)
        keys.append(key)
    return keys


def _blocks_kept(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of blocks, one of which is free of differences whenever at most max_bits differ."""
    if max_bits > 3:
        raise ValueError("four blocks find pairs up to three bits apart")
    return list(combinations(range(4), 4 - max_bits))


def keyed(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp) for each fingerprint and each set of blocks that must agree."""
    parts = [np.concatenate([np.arange(16) + 16 * b for b in blocks]) for blocks in _blocks_kept(max_bits)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 1 << 14):
                some = values[at:at + (1 << 14)]
                yield _pairs("key", np.concatenate(_block_keys(some, parts)), "fp", np.tile(some, len(parts)))

    return prints.select("fp").mapInArrow(index, "key long, fp long")


def _pairs(left: str, a: np.ndarray, right: str, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=[left, right])


def refined(crowded: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of crowded keys under finer keys: of eight half blocks, all but max_bits must agree.

    With two bits 48 of 64 bits are then equal, so no key has more than 65,536
    different fingerprints, however many documents there are.
    """
    halves = list(combinations(range(8), 8 - max_bits))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, kept in enumerate(halves):
                mask = np.uint64(sum(0xFF << (8 * half) for half in kept))
                fine = ((values & mask) ^ keys) * np.uint64(_MIX) + np.uint64(number)
                yield _pairs("key", fine ^ (fine >> np.uint64(31)), "fp", values)

    return crowded.mapInArrow(index, "key long, fp long")


def _tie(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; a label is the smallest member's position."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


def links_of(values: np.ndarray, max_bits: int, cells: int = 1 << 20) -> np.ndarray:
    """For the fingerprints of one key, each one's smallest in its class (by position)."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, table = values[order], distance_table(values[order])
    weight = np.bitwise_count(values).astype(np.int16)
    last = np.searchsorted(weight, weight + max_bits, side="right")
    labels = np.arange(len(values))
    rows = max(1, cells // len(values))
    for at in range(0, len(values), rows):
        to = min(at + rows, len(values))
        # The distance to the zero reference is sorted: only a stretch of rows is within reach.
        j = np.arange(at + 1, last[to - 1])
        if not len(j):
            continue
        a, b = np.nonzero((j[None, :] > np.arange(at, to)[:, None]) & (j[None, :] < last[at:to, None]))
        a, b = a + at, b + at + 1
        for column in range(0, table.shape[1], 4):
            if not len(a):
                break
            apart = np.abs(table[a, column:column + 4] - table[b, column:column + 4]).max(axis=1)
            near = apart <= max_bits
            a, b = a[near], b[near]
        near = np.bitwise_count(values[a] ^ values[b]) <= max_bits
        _tie(labels, a[near], b[near])
    smallest = np.empty(len(values), np.int64)
    smallest[order] = order[labels]
    return smallest


def links(prints: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of different fingerprints that tie together all that are at most max_bits apart.

    Within a key not every pair is emitted, only what connects the same classes.
    """
    rows = keyed(prints, max_bits)
    large = rows.groupBy("key").count().where(F.col("count") > crowded).select("key")
    usual = rows.join(large, "key", "left_anti")
    fine = refined(rows.join(large, "key", "left_semi"), max_bits)
    met = usual.unionByName(fine).repartition("key").sortWithinPartitions("key", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.append(starts[1:], len(keys))
            several = ends - starts > 1
            for start, end in zip(starts[several].tolist(), ends[several].tolist()):
                own = np.unique(values[start:end])
                root = links_of(own, max_bits)
                tied = np.flatnonzero(root != np.arange(len(own)))
                if len(tied):
                    yield _pairs("a", own[tied], "b", own[root[tied]])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            # The last key of a batch may go on in the next one.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                keys_so_far = np.concatenate([k for k, _ in held] + [keys[:cut]])
                yield from done(keys_so_far, np.concatenate([v for _, v in held] + [values[:cut]]))
                held = []
            held.append((keys[cut:], values[cut:]))
        if held:
            yield from done(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, crowded: int = CROWDED
) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, root, component_id.

    Documents whose fingerprints are at most ``max_bits`` apart are linked, and
    ``component_id`` is the smallest doc_id reachable, the document's own
    included; ``root`` names the component also where ids repeat. Equal
    fingerprints are reduced to one before anything is compared. Null text and
    text without words have fingerprint zero and link like any other. A null id
    is a component's id only if it has no other. Repeated rows come out as often
    as they came in. No documents, no rows. Columns other than doc_id and text
    are not read.
    """
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    unique = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique-fingerprints")
    roots = components(links(unique, max_bits, crowded))
    rooted = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Settled, so that a component with very many fingerprints can be split over tasks.
    classes = rooted.join(settle(named, "components"), "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, one with the smallest id, with all its columns.

    Of several rows with that id, and of fully repeated rows, one stays.
    """
    found = near_duplicates(docs, **settings)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alike = first.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    chosen = alike.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), "text_hash").alias("x"))
    chosen = settle(chosen.select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_hash").alias("kept_hash"), "x.n"),
                    "representatives")
    rows, names = numbered(docs, doc_id="doc_id", text="text")
    rows = rows.withColumn("text_hash", F.xxhash64(F.col("text").cast("string"))).drop("text")

    def among(ids: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(ids["kept_id"]) & (rows["text_hash"] == ids["kept_hash"])
        return rows.join(ids, same, "left_semi")

    repeated = W.partitionBy("doc_id", "text_hash").orderBy(row_hash(rows, [f"_{i}" for i in range(len(names))]))
    several = among(chosen.where("n > 1")).withColumn("rank", F.row_number().over(repeated))
    return restore(among(chosen.where("n = 1")).unionByName(several.where("rank = 1").drop("rank")), names)
