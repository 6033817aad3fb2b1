"""Removal of passages that occur more than once, located by sharded phrase automata.

1. Every window of ``WINDOW`` words has an anchor, its shorter word sequence of
   smallest hash. Equal windows have equal anchors, so only windows whose
   anchor occurs twice can recur. Anchors are counted with partial counts.
2. The stretches of text around recurring anchors are dealt to shards by
   anchor, equal stretches of a task only once, with their number.
3. A shard counts its windows word by word, which confirms the recurring
   passages, compiles these into an Aho-Corasick automaton and streams its
   stretches through it, which locates every occurrence.
4. What was located goes back to the documents it came from.

Texts are shuffled once; both joins with them use the same exchange.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle, word_blocks
from clickloom.llm.wordhash import anchors, text_chunks, word_hashes, word_spans

WINDOW = 35
SHINGLE = 8
# An anchor with more occurrences than this does not have its shard to itself:
# its windows are dealt one by one, each by its own words.
CROWDED = 200_000
# Distinct stretches a shard works on at a time, whole anchors.
STRETCHES = 8_192
_LONGEST = 1 << 8


def _anchor_rows(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """(anchor, k1, at): at holds the first window's number and, in the last byte, the number of windows less one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1)):
                starts, ends, firsts = word_spans(data, offsets)
                first, number, anchor = anchors(word_hashes(data, starts, ends), firsts, window, shingle)
                text = np.searchsorted(firsts, first, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(keys[row + text]),
                        pa.array((first - firsts[text]) * _LONGEST + number - 1),
                    ],
                    names=["anchor", "k1", "at"],
                )

    return docs.select("k1", "text").mapInArrow(find, "anchor long, k1 long, at long")


def _recurring(docs: DataFrame, window: int, shingle: int, crowded: int) -> DataFrame:
    """(k1, marks): for each text, where its recurring anchors are."""
    rows = _anchor_rows(docs, window, shingle)
    counted = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # Settled, so that an anchor with very many occurrences can be split over tasks.
    counted = settle(counted.select(F.col("anchor"), (F.col("n") > crowded).alias("crowded")), "recurring-anchors")
    marks = F.collect_set(F.struct("at", "anchor", "crowded")).alias("marks")
    return rows.join(counted, "anchor").groupBy("k1").agg(marks)


def _stretches(text: str, marks: list[dict], window: int) -> Iterator[tuple[int, bytes, int]]:
    """(shard key, words joined by a space, first word) around each marked anchor."""
    words = text.encode("utf-8", "replace").split()
    for mark in marks:
        first, number = divmod(mark["at"], _LONGEST)
        if first + number + window > len(words):
            # A mark of another text with the same key.
            continue
        if mark["crowded"]:
            for at in range(first, first + number + 1):
                passage = b" ".join(words[at:at + window])
                yield xxhash.xxh64_intdigest(passage) - (1 << 63), passage, at
        else:
            yield mark["anchor"], b" ".join(words[first:first + number + window]), first


def _identity(stretch: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(stretch)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _long_columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _occurrences(marked: DataFrame, window: int) -> DataFrame:
    """(s1, s2, k1, k2, first): which stretch stands where."""
    names = ["s1", "s2", "k1", "k2", "first"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, marks in zip(*(batch.column(n) for n in ("k1", "k2", "text", "marks"))):
                k1, k2 = k1.as_py(), k2.as_py()
                for _, stretch, first in _stretches(text.as_py(), marks.as_py(), window):
                    out.append((*_identity(stretch), k1, k2, first))
                if len(out) > 50_000:
                    yield _long_columns(out, names)
                    out = []
            yield _long_columns(out, names)

    return marked.mapInArrow(find, ", ".join(f"{n} long" for n in names))


def _counted_stretches(marked: DataFrame, window: int, held_bytes: int = 1 << 25) -> DataFrame:
    """(shard, stretch, n): equal stretches of a task are counted before they are dealt."""
    schema = pa.schema([("shard", pa.int64()), ("stretch", pa.binary()), ("n", pa.int64())])

    def batch_of(counts: dict) -> pa.RecordBatch:
        shards, stretches = zip(*counts) if counts else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((shards, stretches, list(counts.values())), schema)], schema=schema
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bytes], int] = defaultdict(int)
        held = 0
        for batch in batches:
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                for shard, stretch, _ in _stretches(text.as_py(), marks.as_py(), window):
                    counts[shard, stretch] += 1
                    held += len(stretch)
                if held > held_bytes:
                    yield batch_of(counts)
                    counts.clear()
                    held = 0
        yield batch_of(counts)

    return marked.mapInArrow(count, "shard long, stretch binary, n long")


def _letters(words: list[list[bytes]]) -> tuple[list[str], int]:
    """Word sequences as strings, one letter a word, or two if there are too many different words."""
    codes: dict[bytes, int] = {}
    numbers = [[codes.setdefault(word, len(codes)) for word in sequence] for sequence in words]
    if len(codes) < 0x100000:
        # Beyond the surrogates' plane: every code is a letter of its own.
        return ["".join([chr(0x10000 + c) for c in sequence]) for sequence in numbers], 1
    # First and second letters come from different ranges, so no match starts within a word.
    return ["".join([chr(1 + (c >> 15)) + chr(0x10000 + (c & 0x7FFF)) for c in sequence]) for sequence in numbers], 2


def locate(stretches: list[tuple[bytes, int]], window: int) -> Iterator[tuple[bytes, list[int]]]:
    """Of distinct stretches with their numbers, those with recurring passages and where these are.

    Positions are words, as a flat list from, to, from, to, …
    """
    texts, width = _letters([stretch.split(b" ") for stretch, _ in stretches])
    reach = window * width
    counts: dict[str, int] = defaultdict(int)
    for text, (_, n) in zip(texts, stretches):
        for at in range(0, len(text) - reach + 1, width):
            counts[text[at:at + reach]] += n
    automaton = ahocorasick.Automaton()
    for text in texts:
        start = None
        for at in range(0, len(text) - reach + 1, width):
            if counts[text[at:at + reach]] > 1:
                start = at if start is None else start
                end = at + reach
            elif start is not None:
                automaton.add_word(text[start:end], end - start)
                start = None
        if start is not None:
            automaton.add_word(text[start:end], end - start)
    if not len(automaton):
        return
    automaton.make_automaton()
    for text, (stretch, _) in zip(texts, stretches):
        spans: list[list[int]] = []
        for last, length in automaton.iter(text):
            start, end = last + 1 - length, last + 1
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])
        if spans:
            yield stretch, [position // width for span in spans for position in span]


def _located(marked: DataFrame, window: int) -> DataFrame:
    """(s1, s2, spans): the words of a stretch that recur."""
    dealt = _counted_stretches(marked, window).repartition("shard").sortWithinPartitions("shard")
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        last = None

        def found() -> pa.RecordBatch:
            rows = [(*_identity(stretch), spans) for stretch, spans in locate(list(held.items()), window)]
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for shard, stretch, n in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= STRETCHES and shard != last:
                    yield found()
                    held.clear()
                held[stretch] += n
                last = shard
        yield found()

    return dealt.mapInArrow(search, "s1 long, s2 long, spans array<int>")


def _kept(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by a space)."""
    out, n, removed = [], 0, 0
    spans = sorted(spans)
    nearest = 0
    for words in word_blocks(text.encode("utf-8", "replace")):
        at = n
        n += len(words)
        kept = []
        while nearest < len(spans) and spans[nearest][0] < n:
            start, end = spans[nearest]
            kept.extend(words[at - n + len(words):max(start, at) - n + len(words)])
            removed += max(0, min(end, n) - max(start, at))
            at = max(at, min(end, n))
            if end > n:
                break
            nearest += 1
        kept.extend(words[at - n + len(words):])
        if kept:
            out.append(b" ".join(kept))
    return n, removed, b" ".join(out)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, crowded: int = CROWDED
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept.

    A word goes if a window of ``window`` consecutive words over it, in one
    document, has the same words as a window that starts anywhere else, in the
    same document or another. All windows are judged on the input. ``kept`` are
    the other words joined by one space. Null text has no words; texts shorter
    than a window keep all; fully repeated rows are copies of each other and
    lose all that a window covers. Null ids are kept as they are. No documents,
    no rows. Columns other than doc_id and text are not read.
    """
    if not shingle < window <= _LONGEST:
        raise ValueError(f"shingle < window <= {_LONGEST} is needed")
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows with both keys equal have the same id and text, and so the same result.
    rows = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))
    marked = rows.join(_recurring(rows, window, shingle, crowded), "k1")
    located = _occurrences(marked, window).join(_located(marked, window), ["s1", "s2"])
    spans = located.groupBy("k1").agg(F.collect_set(F.struct("k2", "first", "spans")).alias("found"))
    joined = rows.join(spans, "k1", "left").select("doc_id", "text", "k2", "found")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for text, k2, found in zip(*(batch.column(n) for n in ("text", "k2", "found"))):
                own = [f for f in (found.as_py() or ()) if f["k2"] == k2.as_py()]
                spans = [
                    (f["first"] + start, f["first"] + end)
                    for f in own for start, end in zip(f["spans"][::2], f["spans"][1::2])
                ]
                results.append(_kept(text.as_py(), spans))
            columns = list(zip(*results)) if results else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")
